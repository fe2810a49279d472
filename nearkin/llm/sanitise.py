"""Personal data: pattern spans, and information-theoretic sanitisation of the terms that give their owners away.

Patterns find e-mail addresses, IPv4 addresses, payment card numbers and phone numbers (`base_spans`). Each distinct
value found is a protected entity. All statistics have one unit, the different texts of the corpus, so copies count once:
N texts, n_e that hold entity e, n_t that hold term t anywhere, and n_et that hold t within `REACH` words of a mention of
e. Their pointwise mutual information is ``PMI = log2(N * n_et / (n_e * n_t))``, and the share of the entity's information
``IC(e) = log2(N / n_e)`` that the term discloses is ``PMI / IC(e)`` (1: the term never occurs without the entity).
n_e and n_et need `SUPPORT` texts, and an entity in more than half of all texts is public and has none. The window bounds the pairs by the mentions, however long a text is.

A term that discloses `REMOVE` or more of an entity is removed wherever it stands, in all texts; one that discloses
`GENERALISE` or more is generalised wherever it stands in the documents that hold the entity. It is replaced by its
narrowest safe class: the classes of a word are its beginnings of 6, 5, 4 and 3 characters, and one is safe if its own
information log2(N / n_class) over the corpus is less than `GENERALISE` of IC(e), so that not even a class that occurred with
the entity always would disclose so much. Where none is safe, the class of all terms is left, `[TERM]`. The method adds
spans; those of the patterns stay.

Terms are words (runs of digits, letters and characters from U+0080 on, A-Z lower-cased) of four bytes or more with
something other than digits, outside pattern spans. n_t adds up what tasks count: texts that stand in one row are simply
added; of texts with copies the largest count of a task bounds n_t from below, which rules out common terms, and for
what is left they are counted by hash. Broadcast filters of at most 8 MB let wanted hashes and few others through, and joins make
that exact. n_class adds up the tasks' different texts, so a text with copies counts once a task.

Defined cases: a null text is empty; copies and ties are treated alike; an empty table gives an empty result; repeated
ids keep a row each; a text of any length is taken whole, by one task; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearkin.llm.textcore import U64, Words, bounded_batches, dealt_join, hash_filter, mix, passing, reliable, slices, utf8

#: Kinds in the order in which spans with one start are listed; the last two are the method's.
KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
REACH, SUPPORT, GENERALISE, REMOVE = 128, 3, 0.6, 0.9
#: Share of all texts above which an entity is public: so little information needs no protection.
PUBLIC = 0.5
#: Characters of the beginnings that are a word's classes, narrowest first.
CLASSES = (6, 5, 4, 3)
#: Counts that a task holds before it hands them on.
HELD = 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins: from inside a run, the rest of the text is the same.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def _emails(text: str):
    """Leftmost addresses; each `@` is tried once with the characters in front that no match took."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns' matches in code points, sorted."""
    out = [(s, 0, e) for s, e in _emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _terms(w: Words) -> np.ndarray:
    """Which words are terms."""
    other = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum((w.data < 0x30) | (w.data > 0x39), out=other[1:])
    return (w.end - w.start >= 4) & (other[w.end] > other[w.start])


def mentions(text: str, spans: list[tuple[int, int, int]]) -> tuple[Words, list[tuple[int, np.ndarray]]]:
    """Words of the text, and of each span (entity, places of the terms within reach, outside all spans)."""
    data = np.frombuffer(text.encode(), np.uint8)
    w = Words(data, np.array([0, len(data)]), "alnum", lower=True)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    start, end, free = points[w.start], points[w.end], _terms(w)
    begins = np.array([s for s, _, _ in spans])
    ends = np.maximum.accumulate(np.array([e for _, _, e in spans]))
    before = np.searchsorted(begins, end) - 1  # the last span that begins in front of the word's end
    free &= (before < 0) | (ends[np.maximum(before, 0)] <= start)
    out = []
    for s, kind, e in spans:
        left, right = int(np.searchsorted(end, s, "right")), int(np.searchsorted(start, e))
        first, last = max(0, left - REACH), min(len(start), right + REACH)
        out.append((_hash(f"{KINDS[kind]}:{text[s:e]}"), first + np.flatnonzero(free[first:last])))
    return w, out


def classes_of(w: Words, at: np.ndarray) -> np.ndarray:
    """Hashes of the classes of the words at some places, a column for each of CLASSES; 0 where a word is no longer."""
    points = np.flatnonzero((w.data & 0xC0) != 0x80)
    begin, stop = np.searchsorted(points, w.start[at]), np.searchsorted(points, w.end[at])
    out = np.zeros((len(at), len(CLASSES)), U64)
    for column, n in enumerate(CLASSES):
        longer = np.flatnonzero(stop - begin > n)
        out[longer, column] = mix(w.hashes(w.start[at[longer]], points[begin[longer] + n]) ^ U64(n))
    return out


def _batch(kinds: dict[str, pa.DataType], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


_LONG = pa.int64()


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entity, text, n): the entities of each text, and under the entity 0 of all texts in how many rows it stands."""
    for b in batches:
        out: dict[tuple[int, int], int] = {}
        for text in b.column(0).to_pylist():
            if text:
                here = _hash(text)
                out[0, here] = out.get((0, here), 0) + 1
                out |= {(_hash(f"{KINDS[kind]}:{text[s:e]}"), here): 1 for s, kind, e in base_spans(text)}
        yield _batch({"entity": _LONG, "text": _LONG, "n": _LONG}, *(zip(*out, strict=True) if out else ((), ())), list(out.values()))


def _evidence(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(entity, term, text) for the entities that pass the broadcast filter and the terms within reach of them."""
        for b in batches:
            for text in b.column(0).to_pylist():
                spans = base_spans(text) if text else []
                if not spans:
                    continue
                entities = np.array([_hash(f"{KINDS[kind]}:{text[s:e]}") for s, kind, e in spans])
                if not passing(wanted.value, entities.view(U64)).any():
                    continue
                w, found = mentions(text, spans)
                own: dict[int, list[np.ndarray]] = {}
                for (entity, near), passes in zip(found, passing(wanted.value, entities.view(U64)), strict=True):
                    if passes:
                        own.setdefault(entity, []).append(near)
                here = _hash(text)
                for entity, places in own.items():
                    term = np.unique(w.hash[np.concatenate(places)]).view(np.int64)
                    yield _batch({"entity": _LONG, "term": _LONG, "text": _LONG}, np.full(len(term), entity), term, np.full(len(term), here))

    return run


class _Counts:
    """Numbers of texts by hash, added up with few arrays."""

    def __init__(self):
        self.keys, self.n, self.rest = np.zeros(0, U64), np.zeros(0, np.int64), []

    def add(self, keys: np.ndarray) -> bool:
        """Counts keys, one for each text that has it; whether it is time to hand the counts on."""
        self.rest.append(keys)
        if sum(map(len, self.rest)) > HELD:
            self.merge()
        return len(self.keys) > HELD

    def merge(self) -> None:
        both = np.concatenate([self.keys, *self.rest])
        weight = np.concatenate([self.n, np.ones(len(both) - len(self.keys), np.int64)])
        self.keys, at = np.unique(both, return_inverse=True)
        self.n, self.rest = np.bincount(at, weight, len(self.keys)).astype(np.int64), []

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Counts of some keys, which hold all that were counted."""
        out = np.zeros(len(keys), np.int64)
        out[np.searchsorted(keys, self.keys)] = self.n
        return out


def _texts(batches: Iterator[pa.RecordBatch], copied):
    """(words, number of each word's text, hashes of the texts by number, which of them have copies), slice by slice. A
    text with copies, one that passes the broadcast filter, comes once a task; what comes again has the number -1."""
    met: set[int] = set()
    for b in batches:
        data, offsets = utf8(b.column(0))
        for first, last in slices(offsets):
            edge = offsets[first : last + 1]
            part = data[edge[0] : edge[-1]]
            edge = edge - edge[0]
            hashes = np.array([_hash(part[x:y].tobytes()) for x, y in zip(edge[:-1], edge[1:], strict=True)], np.int64)
            copies = passing(copied.value, hashes.view(U64)) if copied else np.zeros(len(hashes), bool)
            number = np.arange(last - first)
            for i in np.flatnonzero(copies).tolist():
                if hashes[i] in met:
                    number[i] = -1
                met.add(int(hashes[i]))
            w = Words(part, edge, "alnum", lower=True)
            yield w, np.repeat(number, w.counts()), hashes, copies


def _once(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Rows (hash, text) without repeats."""
    return np.unique(np.stack([hashes, text.astype(U64)]), axis=1) if len(hashes) else np.zeros((2, 0), U64)


def _rough(wanted, copied):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(term, single, several, classes): a task's texts without copies, and its different ones with copies, that have
        each term that passes the broadcast filter."""
        single, several, classes = _Counts(), _Counts(), {}

        def done():
            single.merge()
            several.merge()
            keys = np.union1d(single.keys, several.keys)
            kinds = {"term": _LONG, "single": _LONG, "several": _LONG, "classes": pa.list_(_LONG)}
            made = _batch(kinds, keys.view(np.int64), single.of(keys), several.of(keys), [classes.get(k) for k in keys.view(np.int64).tolist()])
            single.__init__()
            several.__init__()
            classes.clear()
            return made

        for w, text, _, copies in _texts(batches, copied):
            at = np.flatnonzero(passing(wanted.value, w.hash) & _terms(w) & (text >= 0))
            term, first = np.unique(w.hash[at], return_index=True)
            some = [(t, f) for t, f in zip(term.view(np.int64).tolist(), first.tolist(), strict=True) if t not in classes]
            made = classes_of(w, at[np.array([f for _, f in some], np.int64)]).view(np.int64).tolist()
            classes.update((t, c) for (t, _), c in zip(some, made, strict=True))
            pairs = _once(w.hash[at], text[at])
            often = copies[pairs[1].astype(np.int64)]
            full = single.add(pairs[0][~often])
            if several.add(pairs[0][often]) or full:
                yield done()
        yield done()

    return run


def _exact(terms, copied, classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(term, text, n): each text with copies that has a term that passes its filter, and with a null text a task's
        different texts with a word of a class that passes its filter."""
        kinds, counts = {"term": _LONG, "text": _LONG, "n": _LONG}, _Counts()

        def done():
            counts.merge()
            made = _batch(kinds, counts.keys.view(np.int64), [None] * len(counts.keys), counts.n)
            counts.__init__()
            return made

        for w, text, hashes, copies in _texts(batches, copied):
            own = np.flatnonzero(np.append(copies, False)[text] & (text >= 0))
            at = own[passing(terms.value, w.hash[own]) & _terms(w)[own]]
            pairs = _once(w.hash[at], text[at])
            yield _batch(kinds, pairs[0].view(np.int64), hashes[pairs[1].astype(np.int64)], np.ones(pairs.shape[1], np.int64))
            if classes:
                _, first, at = np.unique(w.hash, return_index=True, return_inverse=True)  # classes of each different word
                found = classes_of(w, first)
                row, column = np.nonzero(found)
                good = passing(classes.value, found[row, column])
                for place in range(len(CLASSES)):
                    of = np.zeros(len(first), U64)
                    here = good & (column == place)
                    of[row[here]] = found[row[here], place]
                    some = np.flatnonzero((of[at] != 0) & (text >= 0))
                    if counts.add(_once(of[at[some]], text[some])[0]):
                        yield done()
        yield done()

    return run


PAIRS = "entity long, term long, kind int, keep int"


def disclosing_terms(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(entity, term, kind, keep) of the pairs over the thresholds; keep is the number of characters of the safe class of
    a term that is generalised, or 0. docs: text."""
    none = docs.sparkSession.createDataFrame([], PAIRS)
    docs = docs.select("text")
    found = reliable(docs.mapInArrow(_entities, "entity long, text long, n long").groupBy("entity", "text").agg(F.sum("n").alias("n")))
    copied = hash_filter(found.where("entity = 0 and n > 1"), "text")
    held = reliable(found.groupBy("entity").agg(F.count("*").alias("n_e")).where((F.col("n_e") >= support) | (F.col("entity") == 0)))
    n_texts = float((held.where("entity = 0").first() or {"n_e": 0})["n_e"])
    entities = held.where((F.col("entity") != 0) & (F.col("n_e") <= PUBLIC * n_texts))
    wanted = hash_filter(entities, "entity")
    if wanted is None:  # no entity has the support, so there is nothing to count
        return none
    evidence = docs.mapInArrow(_evidence(wanted), "entity long, term long, text long").distinct()
    together = evidence.groupBy("entity", "term").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= support)
    pairs = reliable(dealt_join(reliable(together), entities, ["entity"]))
    wanted = hash_filter(pairs, "term")
    if wanted is None:
        return none
    whole = F.lit(n_texts)
    information = F.greatest(F.log2(whole / F.col("n_e")), F.lit(1e-9))
    share = F.log2(whole * F.col("n_et") / (F.col("n_e") * F.greatest("n_t", "n_et"))) / information
    rough = docs.mapInArrow(_rough(wanted, copied), "term long, single long, several long, classes array<long>").groupBy("term")
    rough = rough.agg(F.sum("single").alias("single"), (F.sum("single") + F.max("several")).alias("n_t"), F.max("classes").alias("classes"))
    pairs = reliable(pairs.join(rough, "term").where(share >= generalise).drop("n_t"))
    terms = hash_filter(pairs, "term")
    if terms is None:
        return none
    classes = pairs.select("term", F.posexplode("classes").alias("place", "class")).where("class <> 0").distinct()
    counted = docs.mapInArrow(_exact(terms, copied, hash_filter(classes, "class")), "term long, text long, n long")
    counted = reliable(counted.groupBy("term", "text").agg(F.sum("n").alias("n")))
    several = counted.where("text is not null").groupBy("term").agg(F.count("*").alias("several"))
    exact = pairs.join(several, "term", "left").withColumn("n_t", F.col("single") + F.coalesce("several", F.lit(0)))
    known = exact.withColumn("share", share).where(F.col("share") >= generalise)
    known = known.select("entity", "term", F.when(F.col("share") >= remove, 5).otherwise(4).alias("kind"), (generalise * information).alias("most"))
    sizes = classes.join(counted.where("text is null").select(F.col("term").alias("class"), F.col("n").alias("n_class")), "class")
    safe = F.log2(whole / F.least("n_class", whole)) < F.col("most")
    lengths = F.element_at(F.array(*map(F.lit, CLASSES)), F.col("place") + 1)
    kept = known.where("kind = 4").join(sizes, "term").where(safe).groupBy("entity", "term").agg(F.max(lengths).alias("keep"))
    return reliable(known.join(kept, ["entity", "term"], "left").select("entity", "term", "kind", F.coalesce("keep", F.lit(0)).alias("keep")))


_SPAN = "array<struct<start:int,kind:int,end:int>>"
_ADDED = "array<struct<start:int,kind:int,end:int,keep:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_FOUND = "array<struct<term:bigint,start:int,end:int>>"
_FOUND_TYPE = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(anywhere, own, owners):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document the patterns' spans, the entities that pass `owners`, and all places outside the spans of terms that pass
        `anywhere`, or `own` where there is such an entity; the three are broadcast filters."""
        for b in batches:
            base, held = [], []
            for text in b.column(1).to_pylist():
                base.append(base_spans(text) if text else [])
                entities = np.array(sorted({_hash(f"{KINDS[kind]}:{text[s:e]}") for s, kind, e in base[-1]}) if owners else [], np.int64)
                held.append(entities[passing(owners.value, entities.view(U64))].tolist() if len(entities) else [])
            found: list[list[dict]] = [[] for _ in base]
            data, offsets = utf8(b.column(1))
            for first, last in slices(offsets) if anywhere or own else ():
                edge = offsets[first : last + 1]
                part = data[edge[0] : edge[-1]]
                w = Words(part, edge - edge[0], "alnum", lower=True)
                passes = passing(anywhere.value, w.hash) if anywhere else np.zeros(len(w.hash), bool)
                if own:
                    owner = np.flatnonzero(np.repeat([bool(x) for x in held[first:last]], w.counts()))
                    passes[owner] |= passing(own.value, w.hash[owner])
                at = np.flatnonzero(passes & _terms(w))
                points = np.zeros(len(part) + 1, np.int64)
                np.cumsum((part & 0xC0) != 0x80, out=points[1:])
                row = np.searchsorted(w.first, at, "right") - 1
                zero = points[edge[row] - edge[0]]
                places = ((points[w.start[at]] - zero).tolist(), (points[w.end[at]] - zero).tolist())
                for r, term, start, end in zip((row + first).tolist(), w.hash[at].view(np.int64).tolist(), *places, strict=True):
                    if all(e <= start or end <= s for s, _, e in base[r]):
                        found[r].append({"term": term, "start": start, "end": end})
            spans = [[dict(zip(("start", "kind", "end"), s, strict=True)) for s in x] for x in base]
            made = [b.column(0), pa.array(spans, _SPAN_TYPE), pa.array(held, pa.list_(pa.int64())), pa.array(found, _FOUND_TYPE)]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "base", "held", "found"])

    return run


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the patterns' spans `base`, arrays of (start, kind, end), and the method's spans `added`, with `keep`, the
    characters of a generalised term's class."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pairs = disclosing_terms(docs)
    removed, generalised = pairs.where("kind = 5"), pairs.where("kind = 4")
    scan = _scan(hash_filter(removed, "term"), hash_filter(generalised, "term"), hash_filter(generalised, "entity"))
    scanned = reliable(docs.mapInArrow(scan, f"doc_id long, base {_SPAN}, held array<bigint>, found {_FOUND}").withColumn("row", F.monotonically_increasing_id()))
    where = scanned.select("row", F.explode("found").alias("c")).select("row", "c.term", "c.start", "c.end")
    where = reliable(where)
    anywhere = dealt_join(where, removed.select("term", "kind", "keep").distinct(), ["term"])
    own = dealt_join(scanned.select("row", F.explode("held").alias("entity")), generalised, ["entity"]).groupBy("row", "term").agg(F.max("kind").alias("kind"), F.min("keep").alias("keep"))
    added = anywhere.unionByName(where.join(own, ["row", "term"])).groupBy("row", "start", "end").agg(F.max("kind").alias("kind"), F.min("keep").alias("keep"))
    added = added.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end", "keep")).alias("added"))
    both = scanned.join(added, "row", "left")
    return both.select("doc_id", "base", F.coalesce("added", F.array().cast(_ADDED)).alias("added"))


def all_spans(found: DataFrame) -> Column:
    """The spans of both columns of `personal_data`, as (start, kind, end)."""
    plain = F.transform(found["added"], lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.concat(found["base"], plain)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def span_digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans and the list of all spans."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(all_spans(found)).alias("spans"))


def sanitised(text: str, spans: list[tuple[int, ...]]) -> str:
    """The text with each pattern span as its kind's mark, generalised terms as their class (`begin*`, or `[TERM]`), and removed
    terms left out. spans: (start, kind, end[, keep])."""
    out, at = [], 0
    for start, kind, end, *keep in sorted(spans):
        if start < at:  # inside a span that is replaced already
            at = max(at, end)
            continue
        general = text[start : start + keep[0]] + "*" if keep and keep[0] else "[TERM]"
        out += [text[at:start], "" if kind == 5 else general if kind == 4 else f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text) with the spans of `personal_data` replaced; for ids without repeats."""

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if t is None else sanitised(t, [tuple(s.values()) for s in [*(x or []), *(y or [])]]) for t, x, y in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    spans = found.select("doc_id", "base", "added").where(F.size("base") + F.size("added") > 0)
    return docs.select("doc_id", "text").join(spans, "doc_id", "left").mapInArrow(replace, "doc_id long, text string")
