"""Token counts: lengths only, from batch encoding in Arrow functions.

A text is split where no token can cross: in front of a space that follows a non-space character. The pre-tokenizer of
a byte-level vocabulary takes a space only at the front of a token and white space only together with white space, so
each piece's tokens are the text's tokens; special strings hold no space and stay whole. A piece of more than `LONG` characters
(a text without spaces) is split further where letters meet digits or punctuation, for letters, digits and marks of
blocks whose kind is beyond doubt; the pre-tokenizer never joins those kinds. What is left whole is a run of one kind, which
is one unit to the library too. Pieces that a worker has not counted yet are encoded by the library in batches of bounded
bytes, sorted by length so that those of a batch are alike. Only lengths are kept.

Defined cases: a null or empty text has 0 bytes and 0 tokens; equal texts get equal counts; a text of any length is
counted whole; an empty table gives an empty result; columns besides the id and the text are ignored.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.llm.segment_memo import Memo
from nearkin.llm.textcore import bounded_batches, slices, utf8

#: Bytes of pieces given to the library at once.
ENCODE_BYTES = 1 << 18
#: Text bytes taken together, so that pieces they share are encoded once.
GATHER_BYTES = 4 << 20
#: Characters from which a piece is split further.
LONG = 1_000
_SAFE = re.compile(r" (?<=\S )")
# Kinds beyond doubt. No border behind an apostrophe, which may open a contraction, or inside a special string.
_LETTER = "A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_MARK = "!-&(-/:-@\\[-`{-~\u3001\u3002\uff01\uff08\uff09\uff0c\uff1a\uff1b\uff1f"
_SPECIAL = re.compile(r"(<[^<>]*>)")
_BORDER = re.compile(f"(?<=[{_LETTER}])(?=[0-9{_MARK}])|(?<=[0-9])(?=[{_LETTER}{_MARK}])")


def pieces_of(text: str) -> list[str]:
    """The text cut at safe borders; the pieces joined are the text."""
    if not text:
        return []
    parts = _SAFE.split(text)
    parts = [parts[0], *[" " + p for p in parts[1:]]] if len(parts) > 1 else parts
    if max(map(len, parts)) <= LONG:
        return parts
    return [x for p in parts for x in (inner_pieces(p) if len(p) > LONG else (p,))]


def inner_pieces(piece: str) -> list[str]:
    """A piece cut between kinds of characters; one that may hold a special string is cut around what may be one."""
    out = []
    for i, part in enumerate(_SPECIAL.split(piece)):
        out += [part] if i % 2 else _BORDER.split(part)
    return [x for x in out if x]


@lru_cache(maxsize=4)
def _counter(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, Memo()


def count_new(tokenizer, memo: Memo, missing: list[str]) -> None:
    """Adds the token counts of pieces to the memory, in library batches balanced by bytes."""
    missing.sort(key=len)
    _, edge = utf8(pa.array(missing, pa.large_string()))
    for first, last in slices(edge, ENCODE_BYTES):
        batch = missing[first:last]
        memo.update(zip(batch, map(len, tokenizer.encode_batch_fast(batch, add_special_tokens=False)), strict=True))


def count_texts(texts: list[str], path: str) -> list[int]:
    """Token counts of the texts."""
    tokenizer, memo = _counter(path)
    cut = [pieces_of(t) for t in texts]
    missing = memo.missing(set().union(*cut))
    if missing:
        count_new(tokenizer, memo, missing)
    get = memo.__getitem__
    return [sum(map(get, c)) for c in cut]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Per document: n_bytes, n_tokens and whether it has more than `limit` tokens, for the tokenizer file at `path`."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the memory makes no cycles, and many small objects make collections slow
        try:
            for b in batches:
                _, offsets = utf8(b.column(1))
                tokens: list[int] = []
                for first, last in slices(offsets, GATHER_BYTES):
                    tokens += count_texts([t or "" for t in b.column(1).slice(first, last - first).to_pylist()], path)
                n = np.array(tokens, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
        finally:
            gc.enable()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
