"""Language identification by prediction by partial matching.

Each language has a context tree over bytes of order 0 to 3. A byte is coded in the longest context that was seen in
training: with c of the context's n counts and d distinct successors, its probability is c / (n + d); an unseen byte
costs the escape d / (n + d) and goes on to the next shorter context, below order 0 to a uniform byte. No exclusions are
made and the statistics are frozen, so a text's code length is the sum over its bytes of a cost that depends on four
bytes alone, and the exact code lengths of a batch need one lookup for each distinct four-byte string in it. The
language with the shortest code wins (ties: first in order); the score is its share of the languages' likelihoods.

Training takes a sample of the distinct labelled texts of each language, chosen by a hash of the text, with an expected `train_bytes` bytes for each
language (8 MB); this parameter bounds the model, which holds at most one entry a language for each sampled byte, and so
what is collected and broadcast. Byte counts for the sampling rate cover every distinct text, so copies neither
lower the rate nor enter repeatedly, and all scores cover every row and the whole texts.

Defined cases: null texts and texts without a letter are `und` with score 0, as are all texts when nothing can be learned
from; equal texts get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearkin.llm.textcore import bounded_batches, slices, utf8

ORDER = 3
TRAIN_BYTES = 8 << 20
SCHEMA = "doc_id long, lang_pred string, score double, bits_per_byte double"


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the 32-bit number of the three bytes before it in its text (0 in front of the text) and itself."""
    code = data.astype(np.uint32)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = code.copy()
    for back in (1, 2, 3):
        held = np.zeros_like(code)
        held[back:] = code[: len(code) - back]
        held[place < back] = 0
        out |= held << np.uint32(8 * back)
    return out


class ContextTrees:
    """Frozen statistics of one language: for each order, counts by context and byte, and totals by context."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.levels = []
        for order in range(ORDER, -1, -1):
            keep = codes & np.uint32((1 << 8 * (order + 1)) - 1) if order < ORDER else codes
            grams, at = np.unique(keep, return_inverse=True)
            n = np.bincount(at, weights=counts, minlength=len(grams))
            contexts, at = np.unique(grams >> np.uint32(8), return_inverse=True)
            total = np.bincount(at, weights=n, minlength=len(contexts))
            distinct = np.bincount(at, minlength=len(contexts)).astype(float)
            self.levels.append((order, grams, n, contexts, total, distinct))

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte behind its other bytes."""
        bits = np.zeros(len(codes))
        left = np.arange(len(codes))
        for order, grams, n, contexts, total, distinct in self.levels:
            if not len(left) or not len(grams):
                break
            gram = codes[left] & np.uint32((1 << 8 * (order + 1)) - 1) if order < ORDER else codes[left]
            context = gram >> np.uint32(8)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            seen = contexts[at] == context
            here = left[seen]
            at, gram = at[seen], gram[seen]
            g = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
            hit = grams[g] == gram
            whole = total[at] + distinct[at]
            bits[here] -= np.log2(np.where(hit, n[g], distinct[at]) / whole)
            left = np.concatenate([left[~seen], here[~hit]])
        bits[left] += 8.0
        return bits


class Scorer:
    """Code lengths under all languages, with the costs of grams that it has met."""

    LIMIT = 2_000_000

    def __init__(self, trees: dict[str, ContextTrees]):
        self.languages = sorted(trees)
        self.trees = [trees[k] for k in self.languages]
        self._forget()

    def _forget(self) -> None:
        self.codes, self.cost = np.zeros(0, np.uint32), np.zeros((len(self.trees), 0))

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """Costs of distinct grams: a row for each language."""
        new = codes[~np.isin(codes, self.codes)] if len(self.codes) else codes
        if len(new):
            if len(self.codes) + len(new) > self.LIMIT:
                self._forget()
                new = codes
            both = np.concatenate([self.codes, new])
            cost = np.concatenate([self.cost, np.stack([t.bits(new) for t in self.trees])], axis=1)
            order = np.argsort(both)
            self.codes, self.cost = both[order], cost[:, order]
        return self.cost[:, np.searchsorted(self.codes, codes)]

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(self.trees), len(offsets) - 1))
        if len(data):
            inverse, distinct = pd.factorize(_grams(data, offsets))
            full = np.flatnonzero(np.diff(offsets))
            for row, cost in zip(out, self.costs(distinct), strict=True):
                row[full] = np.add.reduceat(cost[inverse], offsets[full])
        return out


def held_out(doc_id: Column) -> Column:
    """Whether the document belongs to the fourth that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        languages = np.array(b.column(0).to_pylist(), dtype=object)
        for lang in sorted(set(languages)):
            data, offsets = utf8(b.column(1).filter(pa.array(languages == lang)))
            for first, last in slices(offsets):
                base = offsets[first : last + 1]
                codes, n = np.unique(_grams(data[base[0] : base[-1]], base - base[0]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n)], names=["lang", "code", "n"])


def train(labelled: DataFrame, train_bytes: int = TRAIN_BYTES) -> dict[str, ContextTrees]:
    """Context trees of each language of (text, lang) rows without nulls; see the module for the sample."""
    bounded_batches(labelled.sparkSession)
    key = labelled.select("lang", F.xxhash64("text").alias("hash"), F.octet_length("text").alias("bytes"))
    distinct = key.groupBy("lang", "hash").agg(F.max("bytes").alias("bytes"))
    rates = distinct.groupBy("lang").agg((F.lit(float(train_bytes)) / F.greatest(F.sum("bytes"), F.lit(1))).alias("rate"))
    part = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.col("rate") * (1 << 20)
    sample = labelled.join(F.broadcast(rates), "lang").where(part).select("lang", "text").distinct()
    counts = sample.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    got = counts.toPandas()
    return {lang: ContextTrees(g["code"].to_numpy().astype(np.uint32), g["n"].to_numpy().astype(float)) for lang, g in got.groupby("lang")}


def identify(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_bytes: int = TRAIN_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: lang_pred, score and the winner's bits per byte (null where `und`), learned from `labelled` (text, lang).
    The columns in `carry` follow unchanged."""
    spark = docs.sparkSession
    trees = train(labelled.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull()), train_bytes)
    shared = spark.sparkContext.broadcast(trees)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool) & bool(scorer.trees)
            data, offsets = utf8(b.column(1))
            lang, score, rate = [], [], []
            for first, last in slices(offsets):
                base = offsets[first : last + 1]
                if scorer.trees:
                    bits = scorer.lengths(data[base[0] : base[-1]], base - base[0])
                    best = bits.argmin(axis=0)
                    least = bits.min(axis=0)
                    share = 1 / np.exp2(np.maximum(least - bits, -1000)).sum(axis=0)
                    lang += [scorer.languages[i] for i in best]
                    score += share.tolist()
                    rate += (least / np.maximum(np.diff(base), 1)).tolist()
                else:
                    lang, score, rate = lang + [""] * (last - first), score + [0.0] * (last - first), rate + [0.0] * (last - first)
            rows = [(x, s, r) if ok else ("und", 0.0, None) for x, s, r, ok in zip(lang, score, rate, lettered, strict=True)]
            names, scores, rates = zip(*rows, strict=True) if rows else ((), (), ())
            made = [b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())]
            yield pa.RecordBatch.from_arrays([*made, *b.columns[2:]], names=["doc_id", "lang_pred", "score", "bits_per_byte", *carry])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), *carry)
    more = "".join(f", `{c}` {kind}" for c, kind in docs.select(*carry).dtypes) if carry else ""
    return rows.mapInArrow(predict, SCHEMA + more)


def learned_from(docs: DataFrame) -> DataFrame:
    """The rows of documents that may be learned from: labelled, with a text, and not held out."""
    return docs.where(~held_out(F.col("doc_id"))).select("text", "lang")
