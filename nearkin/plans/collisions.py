"""Near-duplicates of new items among all that arrived before, and the reports on them.

An item is searched before it is stored and stored whatever is found, so searching and storing one after another equals
one join of query frames and stored frames with `stored.seq < query.seq`; an index that was there before has seq -1.
Query frames may be mirrored or phantom, stored ones are not, so the order of arrival matters and pairs are not
made symmetric.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearkin.functions.hashing import to_base64
from nearkin.functions.measures import clock
from nearkin.operators.dealing import settled
from nearkin.operators.numbering import numbered
from nearkin.operators.rangejoin import find_within


def catalogue_changes(files: DataFrame, stored: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Paths that are new and paths that vanished, each once; `limit` of the new ones, in order of path."""
    a, b = files.select("path").distinct(), stored.select("path").distinct()
    new = a.join(b, "path", "left_anti")
    return (new if limit is None else new.orderBy("path").limit(limit)), b.join(a, "path", "left_anti")


def collisions(query: DataFrame, stored: DataFrame, within: int = 23) -> DataFrame:
    """One row for each query frame and earlier stored frame within the distance: structs `reference` and `other` of all
    columns, and the distance. Both tables have seq, hi and lo."""
    pairs = find_within(query, stored, within)
    q = query.select(F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo"), F.struct(*query.columns).alias("reference"))
    s = stored.select(F.col("hi").alias("s_hi"), F.col("lo").alias("s_lo"), F.struct(*stored.columns).alias("other"))
    met = pairs.join(q, ["q_hi", "q_lo"]).join(s, ["s_hi", "s_lo"]).where("other.seq < reference.seq")
    return met.select("reference", "other", F.col("distance").cast("int").alias("distance"))


#: Items in a stretch of the arrival order, and stretches at most.
STRETCH, STRETCHES = 100_000, 10_000


def earlier_matches(items: DataFrame, within: int = 23) -> DataFrame:
    """(seq, n_earlier, first_earlier, nearest) for each item with an earlier one within the distance: how many, the first
    of them, and the smallest distance. items: seq, hi, lo, one row for each item.

    Pairs of items are not made. The order of arrival is cut into stretches of like numbers of items. For each pair of similar
    hashes, whole earlier stretches are added up from the hash's count in each stretch, and only items of one stretch are
    put on one line; so a hash that very many items share is worked on by as many tasks as there are stretches."""
    items = settled(items.select("seq", "hi", "lo"))
    parts = min(STRETCHES, max(1, -(-items.count() // STRETCH)))
    cuts = items.approxQuantile("seq", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    stretch = F.array_position(F.transform(F.array(*map(F.lit, cuts)), lambda c: F.col("seq") < c), F.lit(True)) if cuts else F.lit(1)
    items = items.withColumn("stretch", F.when(stretch == 0, F.lit(len(cuts) + 1)).otherwise(stretch).cast("int"))
    pairs = settled(find_within(items, None, within))
    at = ("q_hi", "q_lo", "s_hi", "s_lo")
    counts = settled(items.groupBy("hi", "lo", "stretch").agg(F.count("*").alias("n"), F.min("seq").alias("first")))
    asked = pairs.join(counts.select(F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo"), "stretch"), ["q_hi", "q_lo"])
    held = pairs.join(counts.withColumnsRenamed({"hi": "s_hi", "lo": "s_lo"}), ["s_hi", "s_lo"])
    # one row for each stretch: what all stretches before it hold
    line = asked.select(*at, "distance", "stretch", F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(0).alias("look")).unionByName(held.select(*at, "distance", "stretch", "n", "first", F.lit(1).alias("look")))
    earlier = Window.partitionBy(*at).orderBy("stretch", "look").rowsBetween(Window.unboundedPreceding, -1)
    whole = line.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("least", F.min("first").over(earlier)).where("look = 0")
    looks = whole.select(*at, "distance", "stretch", "before", "least").join(items.select(F.col("seq"), F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo"), "stretch"), ["q_hi", "q_lo", "stretch"]).withColumn("look", F.lit(1))
    # items of a stretch in which the pair's both hashes occur
    common = asked.select(*at, "stretch").join(held.select(*at, "stretch"), [*at, "stretch"])
    seen = common.join(items.select(F.col("seq"), F.col("hi").alias("s_hi"), F.col("lo").alias("s_lo"), "stretch"), ["s_hi", "s_lo", "stretch"])
    seen = seen.select(*at, F.lit(None).cast("bigint").alias("distance"), "stretch", F.lit(0).cast("long").alias("before"), F.lit(None).cast("long").alias("least"), "seq", F.lit(0).alias("look"))
    inside = Window.partitionBy(*at, "stretch").orderBy("seq", F.desc("look")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = looks.unionByName(seen).withColumn("n", F.col("before") + F.sum(1 - F.col("look")).over(inside)).withColumn("first", F.least("least", F.min(F.when(F.col("look") == 0, F.col("seq"))).over(inside)))
    return both.where("look = 1 and n > 0").groupBy("seq").agg(F.sum("n").alias("n_earlier"), F.min("first").alias("first_earlier"), F.min("distance").cast("int").alias("nearest"))


def other_paths(found: DataFrame) -> DataFrame:
    """Paths on the stored side of collisions, each once."""
    return found.select(F.col("other.path").alias("path")).distinct()


def all_paths(found: DataFrame) -> DataFrame:
    """Paths on either side, each once."""
    return found.select(F.explode(F.array("reference.path", "other.path")).alias("path")).distinct()


def match_counts(found: DataFrame) -> DataFrame:
    """(new, old, n): matches of each pair of paths."""
    return found.groupBy(F.col("reference.path").alias("new"), F.col("other.path").alias("old")).agg(F.count("*").alias("n"))


def report(found: DataFrame, first_entry: int = 0) -> DataFrame:
    """(entry, item, name, target): an entry for each new path, numbered in order, with the new one, each old one and the
    collisions' description."""
    pairs = found.select(F.col("reference.path").alias("new"), F.col("other.path").alias("old")).distinct()
    entries = numbered(pairs.select("new").distinct(), "new", name="entry").withColumn("entry", F.col("entry") + first_entry)
    links = pairs.join(entries, "new").withColumn("item", F.row_number().over(Window.partitionBy("new").orderBy("old"))).select("entry", "item", F.lit("dup").alias("kind"), F.col("old").alias("target"))
    new = entries.select("entry", F.lit(0).alias("item"), F.lit("the_new_one").alias("kind"), F.col("new").alias("target"))
    last = links.groupBy("entry").agg((F.max("item") + 1).alias("item")).select("entry", "item", F.lit("debuginfo").alias("kind"), F.lit(None).cast("string").alias("target"))
    rows = new.unionByName(links).unionByName(last)
    return rows.select(F.format_string("%04d", "entry").alias("entry"), F.col("item").cast("int").alias("item"), F.format_string("%04d_%s", "item", "kind").alias("name"), "target")


def next_entry(names: DataFrame) -> DataFrame:
    """(next): one more than the largest leading number of names, or 0; a name without one is an error."""
    number = F.regexp_extract("name", r"^([0-9]+)(_.*)?$", 1)
    return names.agg(F.coalesce(F.max(F.when(number == "", F.raise_error(F.lit("a name without a number")).cast("int")).otherwise(number.cast("int"))) + 1, F.lit(0)).alias("next"))


def listing(rows: DataFrame) -> DataFrame:
    """(line): path and hash of each row, in order of the lines."""
    return rows.select(F.concat(F.lit("Source="), "path", F.lit(", Hash="), to_base64(F.col("hi"), F.col("lo"))).alias("line")).orderBy("line")


def debug_lines(found: DataFrame, frames: DataFrame | None = None, threshold: int = 23, limit: int = 100) -> DataFrame:
    """What is shown of the first `limit` collisions, by distance and places; with `frames` (path, ts, px) also both
    pictures, each distinct frame looked up once."""
    first = found.orderBy("distance", "reference.path", "other.path", "reference.ts", "other.ts").limit(limit)
    side = lambda s: [F.col(f"{s}.path").alias(f"{s}_path"), clock(F.col(f"{s}.ts")).alias(f"{s}_time"), to_base64(F.col(f"{s}.hi"), F.col(f"{s}.lo")).alias(f"{s}_hash")]
    rows = first.select(*side("reference"), *side("other"), F.format_string("%d <= %d", F.col("distance"), F.lit(threshold)).alias("verdict"), F.col("reference.ts").alias("_rt"), F.col("other.ts").alias("_ot"))
    if frames is not None:
        wanted = rows.select(F.explode(F.array(F.struct(F.col("reference_path").alias("path"), F.col("_rt").alias("ts")), F.struct(F.col("other_path").alias("path"), F.col("_ot").alias("ts")))).alias("f")).select("f.*").distinct()
        pictures = frames.join(wanted, ["path", "ts"], "left_semi").dropDuplicates(["path", "ts"])
        for s, t in (("reference", "_rt"), ("other", "_ot")):
            one = pictures.select(F.col("path").alias(f"{s}_path"), F.col("ts").alias(t), F.col("px").alias(f"{s}_px"))
            rows = rows.join(one, [f"{s}_path", t], "left")
    return rows.drop("_rt", "_ot")


def random_paths(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n distinct paths, without replacement: the first ones by the MD5 of seed and path, so a seed gives the same ones again."""
    return rows.select("path").distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "path")), "path").limit(n)
