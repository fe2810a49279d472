"""Chat formatting by columnar byte assembly.

The template writes each turn as ``<|turn|>role\\n`` + escaped text + ``<|end|>\\n``; the segments of a conversation in
turn order, put one after another, are its formatted text. Control strings inside texts and roles are escaped
reversibly: a backslash is doubled, and ``\\:`` goes behind the first character of each control string, so none of them
is left in the output.

`format_turns` needs no shuffle: a turn's segment depends on its row alone. Segment lengths, cumulative offsets and
scatter indices are computed in numpy and all headers, texts and ends of a batch are copied into one preallocated Arrow
buffer. `conversation_digest` reads the segments back in turn order as a stream, one conversation after another, and
holds only running hashes, so a conversation of any length needs constant memory.

Defined cases: a null text or role is empty; a null conv_id is a conversation of its own; turns that tie are ordered by
role, then text; repeated rows are turns of their own; a text of any length is one segment; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.llm.textcore import bounded_batches, spread, utf8

TURN, END = "<|turn|>", "<|end|>\n"
#: Strings that chat templates treat as control marks.
CONTROL = ("<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(re.escape(first) + "(?=" + "|".join(re.escape(c[1:]) for c in CONTROL if c[0] == first) + ")" for first in "<["))
_ESCAPED = re.compile(r"\\(.)", re.S)
SEGMENT_SCHEMA = "conv_id long, turn long, role string, segment string, seg_chars long, loss_start long, loss_end long"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\:", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: {":": "", "n": "\n"}.get(m[1], m[1]), text) if "\\" in text else text


def _escaped(column: pa.Array, role: bool = False) -> pa.Array:
    """The column with control strings escaped; only rows that may hold one are touched in Python."""
    column = pc.fill_null(column, "")
    odd = pc.match_substring_regex(column, r"[<\[\\\n]" if role else r"[<\[\\]")
    rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    if not len(rows):
        return column
    values = column.to_pylist()
    for i in rows:
        values[i] = escape(values[i]).replace("\n", "\\n") if role else escape(values[i])
    return pa.array(values, pa.string())


def _copy(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Puts each row of (data, offsets) at its place in out."""
    out[spread(at, np.diff(offsets))] = data


def assemble(role: pa.Array, text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The segments of a batch in one Arrow buffer, and the code points in front of each text."""
    role, text = _escaped(role, True), _escaped(text)
    role_data, role_off = utf8(role)
    text_data, text_off = utf8(text)
    n = len(text)
    marks = [np.frombuffer(m.encode(), np.uint8) for m in (TURN, "\n", END)]
    lengths = np.stack([np.full(n, len(marks[0])), np.diff(role_off), np.full(n, 1), np.diff(text_off), np.full(n, len(marks[2]))], axis=1)
    offsets = np.zeros(n * 5 + 1, np.int64)
    np.cumsum(lengths.ravel(), out=offsets[1:])
    out = np.empty(offsets[-1], np.uint8)
    at = offsets[:-1].reshape(n, 5)
    for column, mark in ((0, marks[0]), (2, marks[1]), (4, marks[2])):
        out[(at[:, column, None] + np.arange(len(mark))).ravel()] = np.tile(mark, n)
    _copy(out, at[:, 1], role_data, role_off)
    _copy(out, at[:, 3], text_data, text_off)
    ends = np.append(at[:, 0], offsets[-1]) if n else np.zeros(1, np.int64)
    made = pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
    return made, len(TURN) + 1 + pc.utf8_length(role).to_numpy(zero_copy_only=False).astype(np.int64)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        role, text = b.column("role"), b.column("text")
        segment, before = assemble(role, text)
        chars = pc.utf8_length(segment).to_numpy(zero_copy_only=False).astype(np.int64)
        assistant = pc.fill_null(pc.equal(role, "assistant"), False).to_numpy(zero_copy_only=False)
        end = np.where(assistant, chars - len(END), before)
        yield pa.RecordBatch.from_arrays(
            [b.column("conv_id"), b.column("turn"), role, segment, pa.array(chars), pa.array(before), pa.array(end)],
            names=["conv_id", "turn", "role", "segment", "seg_chars", "loss_start", "loss_end"],
        )


def format_turns(conversations: DataFrame) -> DataFrame:
    """A formatted segment for each turn, with its loss mask as a code point range of the segment (empty unless the
    role is assistant)."""
    bounded_batches(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(_format, SEGMENT_SCHEMA)


def parse(segment: str) -> tuple[str, str]:
    """Role and text of a formatted segment."""
    if not segment.startswith(TURN) or not segment.endswith(END):
        raise ValueError("not a formatted turn")
    role, _, text = segment[len(TURN) : -len(END)].partition("\n")
    return unescape(role), unescape(text)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    now, state = object(), None

    def row():
        return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    def table(rows):
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for b in batches:
        done = []
        for conv, segment, chars, start, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "segment", "seg_chars", "loss_start", "loss_end")), strict=True):
            if state is None or conv != now:
                if state is not None:
                    done.append(row())
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parse(segment)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            loss = unescape(segment[start:end])
            state[2] += len(loss)
            state[3].update(loss.encode())
            state[4] += chars
        if done:
            yield table(done)
    if state is not None:
        yield table([row()])


def conversation_digest(segments: DataFrame) -> DataFrame:
    """Reads the segments back: one row for each conversation with its turns, loss text and formatted length."""
    inner = F.expr(f"substring(segment, loss_start + 1, seg_chars - loss_start - {len(END)})")
    text = F.regexp_replace(inner, r"\\(\\)|\\:", "$1")  # unescaped, as turns that tie are ordered by their texts
    ordered = segments.withColumn("_text", text).repartition("conv_id").sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), "_text")
    columns = ordered.select("conv_id", "segment", "seg_chars", "loss_start", "loss_end")
    return columns.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
