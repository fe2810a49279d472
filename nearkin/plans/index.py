"""A persistent table of hashes: append, tombstone delete, scan, compaction, statistics, export and import.

An index is a folder of Parquet data. Every change is one append of one row to its `log`, made after the data it names
are written, so a failed job leaves the index as it was and readers see whole changes only:

    log/       (version, action, ident, folder, tag)
    versions/  an empty file for each version
    rows/…     hi, lo, src, added, row         one folder for each add or rebuild
    gone/…     added, row                      one folder for each delete

A stored row is known by (added, row): a random number of the folder that it came with, and a number in it. Deletes append
those pairs; a scan is an anti-join of rows and deletes. A rebuild writes the live rows to a new folder and starts a
new generation; older folders stay as a backup until `vacuum`.

A version belongs to the writer that creates its file, which the file system lets only one do. Adds that meet take the
next version; a delete or a rebuild that finds that others changed the index since it read it fails with `Conflict` and can be
repeated. A tag names a change that must happen once only, such as the storing of a stream's batch.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.operators.rangejoin import find_within
from nearkin.schemas import PAYLOADS, SourceMismatch

LOG = "version long, action string, ident string, folder string, tag string"


class Conflict(RuntimeError):
    """Another writer changed the index meanwhile."""


def _folder(kind: str, version: int) -> tuple[str, int]:
    """A new folder's name and its random number."""
    name = uuid.uuid4()
    return f"{kind}/{version}-{name.hex}", name.int >> 65


@dataclass(frozen=True)
class HashIndex:
    spark: SparkSession
    path: str
    #: None: opened without a payload type, for statistics and rebuilding.
    ident: str | None

    @classmethod
    def create(cls, spark: SparkSession, path: str, ident: str) -> HashIndex:
        if ident not in PAYLOADS:
            raise ValueError(f"unknown payload type {ident!r}")
        made = cls(spark, path, ident)
        made._log(0, "create", "")
        return made

    @classmethod
    def open(cls, spark: SparkSession, path: str, ident: str | None = None) -> HashIndex:
        """The index at a path; `SourceMismatch` if it holds another payload type than `ident`."""
        held = cls(spark, path, ident)._entries().select("ident").first()["ident"]
        if ident is not None and ident != held:
            raise SourceMismatch(f"{path} holds {held}, not {ident}")
        return cls(spark, path, ident)

    def upcast(self) -> HashIndex:
        return HashIndex(self.spark, self.path, None)

    def downcast(self, ident: str) -> HashIndex:
        return HashIndex.open(self.spark, self.path, ident)

    # the log: as many rows as there were changes since the last vacuum
    def _log(self, version: int, action: str, folder: str, tag: str | None = None) -> None:
        ident = self.ident or self.held_ident()
        hadoop = self.spark._jvm.org.apache.hadoop
        while not self._claimed(hadoop.fs.Path(f"{self.path}/versions/{version}")):
            if action != "add":
                raise Conflict(f"{self.path} was changed by another writer")
            version += 1
        self.spark.createDataFrame([(version, action, ident, folder, tag)], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _claimed(self, file) -> bool:
        return file.getFileSystem(self.spark._jsc.hadoopConfiguration()).createNewFile(file)

    def has(self, tag: str) -> bool:
        """Whether a change with this tag was made."""
        return not self._entries().where(F.col("tag") == tag).isEmpty()

    def _entries(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(f"{self.path}/log")

    def held_ident(self) -> str:
        return self._entries().select("ident").first()["ident"]

    def _state(self) -> tuple[int, list[str], list[str]]:
        """Next version, and the folders of rows and deletes of this generation."""
        entries = sorted(self._entries().collect(), key=lambda r: r["version"])
        start = max((i for i, r in enumerate(entries) if r["action"] == "rebuild"), default=0)
        live = entries[start:]
        return entries[-1]["version"] + 1, [r["folder"] for r in live if r["action"] in ("add", "rebuild")], [r["folder"] for r in live if r["action"] == "remove"]

    def _schema(self) -> str:
        return f"hi long, lo long, src {PAYLOADS[self.held_ident()].simpleString()}, added long, row long"

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def all_rows(self) -> DataFrame:
        """All rows of this generation, with `removed`."""
        _, rows, gone = self._state()
        marks = self._read(gone, "added long, row long").distinct().withColumn("removed", F.lit(True))
        return self._read(rows, self._schema()).join(marks, ["added", "row"], "left").withColumn("removed", F.coalesce("removed", F.lit(False)))

    def scan(self) -> DataFrame:
        """Live rows."""
        _, rows, gone = self._state()
        live = self._read(rows, self._schema())
        return live.join(self._read(gone, "added long, row long"), ["added", "row"], "left_anti") if gone else live

    def add(self, rows: DataFrame, tag: str | None = None) -> None:
        """Appends (hi, lo, src) rows; equal ones are kept apart."""
        version, _, _ = self._state()
        folder, number = _folder("rows", version)
        rows.select("hi", "lo", F.col("src").cast(PAYLOADS[self.held_ident()])).withColumn("added", F.lit(number).cast("long")).withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{self.path}/{folder}")
        self._log(version, "add", folder, tag)

    def remove(self, which: Column | DataFrame, on: str = "src.path") -> int:
        """Marks live rows as removed: those where a condition on hi, lo and src holds, or whose `on` is in a table's first
        column. The number of rows that were marked."""
        version, _, _ = self._state()
        live = self.scan()
        if isinstance(which, DataFrame):
            keys = which.select(F.col(which.columns[0]).alias("_key")).distinct()
            bad = live.withColumn("_key", F.col(on)).join(keys, "_key", "left_semi")
        else:
            bad = live.where(which)
        folder, _ = _folder("gone", version)
        bad.select("added", "row").write.parquet(f"{self.path}/{folder}")
        self._log(version, "remove", folder)
        return self._read([folder], "added long, row long").count()

    def rebuild(self) -> None:
        """Live rows only, in a new folder; what was there stays on disk until `vacuum`."""
        version, _, _ = self._state()
        folder, number = _folder("rows", version)
        self.scan().select("hi", "lo", "src", F.lit(number).cast("long").alias("added"), F.monotonically_increasing_id().alias("row")).write.parquet(f"{self.path}/{folder}")
        self._log(version, "rebuild", folder)

    def rebuild_to(self, path: str) -> HashIndex:
        """A new index elsewhere with the live rows."""
        made = HashIndex.create(self.spark, path, self.held_ident())
        made.add(self.scan())
        return made

    def backup(self, path: str) -> None:
        """A copy of the whole index, over one that is there."""
        hadoop = self.spark._jvm.org.apache.hadoop
        conf = self.spark._jsc.hadoopConfiguration()
        src, dst = hadoop.fs.Path(self.path), hadoop.fs.Path(path)
        fs = src.getFileSystem(conf)
        if fs.exists(src):
            dst.getFileSystem(conf).delete(dst, True)
            hadoop.fs.FileUtil.copy(fs, src, dst.getFileSystem(conf), dst, False, conf)

    def vacuum(self) -> None:
        """Deletes folders that this generation doesn't name."""
        hadoop = self.spark._jvm.org.apache.hadoop
        conf = self.spark._jsc.hadoopConfiguration()
        _, rows, gone = self._state()
        for kind, named in (("rows", rows), ("gone", gone)):
            top = hadoop.fs.Path(f"{self.path}/{kind}")
            fs = top.getFileSystem(conf)
            if fs.exists(top):
                for status in fs.listStatus(top):
                    if f"{kind}/{status.getPath().getName()}" not in named:
                        fs.delete(status.getPath(), True)

    def stats(self) -> DataFrame:
        return live_and_dead(self.all_rows())

    def search(self, query: DataFrame, within: int = 23) -> DataFrame:
        """query (hi, lo, ...) with every live row within the distance as `other`, and the distance."""
        live = self.scan()
        pairs = find_within(query, live.select("hi", "lo"), within)
        found = live.select(F.col("hi").alias("s_hi"), F.col("lo").alias("s_lo"), F.struct("hi", "lo", "src").alias("other"))
        return query.join(pairs.withColumnsRenamed({"q_hi": "hi", "q_lo": "lo"}), ["hi", "lo"]).join(found, ["s_hi", "s_lo"]).drop("s_hi", "s_lo")

    def export(self, path: str) -> None:
        self.scan().select("hi", "lo", "src").write.mode("overwrite").json(path)

    def load(self, path: str) -> None:
        """Appends exported rows; those that are there already come twice."""
        self.add(self.spark.read.schema(f"hi long, lo long, src {PAYLOADS[self.held_ident()].simpleString()}").json(path))


def live_and_dead(rows: DataFrame, removed: str = "removed") -> DataFrame:
    """(alive, dead, dead_percent): the share is null for a table without rows."""
    dead = F.count_if(F.col(removed))
    return rows.agg(F.count_if(~F.col(removed)).alias("alive"), dead.alias("dead")).withColumn("dead_percent", F.try_divide(F.lit(100.0) * F.col("dead"), F.col("alive") + F.col("dead")))


def dead_sources(rows: DataFrame, path: str, removed: str = "removed") -> DataFrame:
    """The older share: of sources without a live row among all, null without sources."""
    by = rows.groupBy(path).agg(F.min(F.col(removed).cast("int")).alias("dead"))
    return by.agg(F.sum("dead").alias("dead"), F.count("*").alias("sources")).withColumn("dead_percent", F.try_divide(F.lit(100.0) * F.col("dead"), F.col("sources")))
