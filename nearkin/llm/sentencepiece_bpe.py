"""Exact encoding and decoding with merge-type SentencePiece models.

The encoder finds the merges' result without replaying them. An Aho-Corasick automaton over the vocabulary gives the
longest token at each position; a token may follow another only if the two are compatible, that is, if re-merging
their joined characters keeps the border between them. Where no token that starts at a position is compatible, the
position is marked in a bitfield of failed ones and the encoder steps back and tries the previous token's next shorter
prefix. The one sequence whose neighbours are all compatible is the merges' result.

No piece of such a vocabulary holds the space mark behind another character, so no merge crosses the border in front
of a run of space marks; texts are cut there and each distinct segment is encoded once. Characters that the vocabulary
lacks become byte pieces and never merge.

Models that this doesn't cover are refused when they are loaded: unigram models, normalisers that change texts,
user-defined or unused pieces, equal merge ranks. Runs of space marks may share the lowest rank: they merge after
everything else, from the left.

Defined cases: a null or empty text has no ids and decodes to the empty text; U+2581 in a text is the space mark, as in
the library; a text of any length is encoded whole, by one task, in time that grows with its length; an empty table gives an empty result; columns besides the id and the text are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.llm.textcore import bounded_batches

SPACE = "▁"
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_SHIFT = 20


class MergeModel:
    """Tables of a merge-type model: ranks, canonical splits, prefixes and the automaton."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(size)]
        normal = [i for i in range(size) if not special[i]]
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in normal) or any(sp.is_unused(i) for i in range(size)):
            raise ValueError("pieces with inner space marks, or unused pieces, are not covered")
        probe = " a  ﬁ Å\t　­z "
        if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("the model's normaliser is not covered")
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.byte_of = {i: bytes([b]) for b, i in self.byte_id.items()}
        self.control = {i for i in range(size) if sp.is_control(i)}
        self.unknown = {i for i in range(size) if sp.is_unknown(i)}
        if len(self.byte_id) != 256:
            raise ValueError("a model without byte pieces is not covered")
        by_text = {self.pieces[i]: i for i in normal}
        self.text_of = [None if special[i] else self.pieces[i] for i in range(size)]
        merged = sorted((i for i in normal if len(self.pieces[i]) > 1), key=sp.get_score, reverse=True)
        self.space = by_text.get(SPACE, -1)
        self.runs = {len(self.pieces[i]): i for i in normal if set(self.pieces[i]) == {SPACE}}
        merged = [i for i in merged if set(self.pieces[i]) != {SPACE}]
        if len({sp.get_score(i) for i in merged}) < len(merged):
            raise ValueError("equal merge ranks are not covered")
        spaces = {sp.get_score(i) for n, i in self.runs.items() if n > 1}
        if spaces and (len(spaces) > 1 or merged and min(spaces) >= sp.get_score(merged[-1])):
            raise ValueError("runs of space marks that don't merge last are not covered")
        self.rank = [0] * size
        for r, i in enumerate(merged, 1):
            self.rank[i] = r
        self.length = [len(p) for p in self.pieces]
        self.left, self.right, self.prefix = [-1] * size, [-1] * size, [-1] * size
        self.pair: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        reached = {self.pieces[i]: i for i in normal if len(self.pieces[i]) == 1}
        for i in merged:
            halves = self._last_merge(self.pieces[i], by_text)
            if halves:
                self.left[i], self.right[i] = halves
                self.pair[halves[0] << _SHIFT | halves[1]] = self.rank[i]
                reached[self.pieces[i]] = i
        # Single characters are looked up in a dict: thousands of them would make the automaton's root slow to search.
        self.single = {text: i for text, i in reached.items() if len(text) == 1}
        for text, i in reached.items():
            if len(text) > 1:
                self.automaton.add_word(text, i)
            self.prefix[i] = next((reached[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in reached), -1)
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}

    def _last_merge(self, text: str, by_text: dict[str, int]) -> tuple[int, int] | None:
        """The two pieces whose merge gives `text` when its characters are merged; None if merging ends otherwise."""
        if any(c not in by_text for c in text):
            return None
        parts = list(text)
        while len(parts) > 2:
            ranks = [self.rank[by_text[p]] if (p := a + b) in by_text else 1 << 40 for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == 1 << 40:
                return None
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (by_text[parts[0]], by_text[parts[1]]) if len(parts) == 2 else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether re-merging keeps the border between a and b. Going back in time, the later merge of the two pieces
        at the border is undone first; the border holds if no pair across it merges while both its pieces exist."""
        key = a << _SHIFT | b
        rank, x, y, until, holds = self.rank, a, b, 1 << 40, True
        while True:
            if self.pair.get(x << _SHIFT | y, 1 << 40) < until:
                holds = False
                break
            if rank[x] > rank[y]:
                until, x = rank[x], self.right[x]
            elif rank[y]:
                until, y = rank[y] + 1, self.left[y]  # of equal ranks the left merge comes first
            else:
                break
        if len(self.fits) >= 300_000:
            self.fits.clear()
        self.fits[key] = holds
        return holds

    def _run(self, longest: list[int], begin: int, end: int, out: list[int]) -> None:
        """Encodes positions begin..end, all of whose characters are known."""
        length, prefix, fits, compatible = self.length, self.prefix, self.fits, self.compatible
        failed = None  # a bitfield of positions from which the rest can't be encoded, made when the first one fails
        base, pos, token, last = len(out), begin, longest[begin], -1
        while True:
            while token >= 0:
                stop = pos + length[token]
                if not failed or not failed[stop - begin >> 3] >> (stop - begin & 7) & 1:
                    if last < 0:
                        break
                    known = fits.get(last << _SHIFT | token)
                    if known or known is None and compatible(last, token):
                        break
                token = prefix[token]
            if token >= 0:
                out.append(token)
                if stop == end:
                    return
                pos, last, token = stop, token, longest[stop]
            else:
                if not failed:
                    failed = bytearray((end - begin >> 3) + 1)
                failed[pos - begin >> 3] |= 1 << (pos - begin & 7)
                token = out.pop()
                pos -= length[token]
                last = out[-1] if len(out) > base else -1

    def encode_segment(self, text: str) -> list[int]:
        """Ids of a text in which space marks stand for spaces."""
        single, length = self.single, self.length
        longest = [single.get(c, -1) for c in text]
        for end, token in self.automaton.iter(text):
            start = end + 1 - length[token]
            if length[longest[start]] < length[token]:
                longest[start] = token
        out: list[int] = []
        begin, n = 0, len(text)
        if min(longest) >= 0:  # all characters are known
            self._run(longest, 0, n, out)
            begin = n
        while begin < n:
            if longest[begin] < 0:
                out += [self.byte_id[b] for b in text[begin].encode()]
                begin += 1
                continue
            end = begin + 1
            while end < n and longest[end] >= 0:
                end += 1
            self._run(longest, begin, end, out)
            begin = end
        if len(out) < 2 or out[0] != self.space or out[1] != self.space:
            return out
        marks = next((k for k, i in enumerate(out) if i != self.space), len(out))
        return [*self._spaces(marks), *out[marks:]]

    def _spaces(self, n: int) -> list[int]:
        """Ids of n space marks that nothing else took. They merge last and all at one rank, so the leftmost pair with a
        piece goes first: no pair in what is done can merge, until the next mark joins its end."""
        done: list[int] = []
        for _ in range(n):
            done.append(1)
            while len(done) > 1 and done[-2] + done[-1] in self.runs:
                last = done.pop()
                done[-1] += last
        return [self.runs[k] for k in done]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for segment in segments_of(text):
            ids += self.encode_segment(segment)
        return ids

    def decode_raw(self, ids: Iterable[int]) -> str:
        """The text of ids with the space mark that encoding puts first, if any; a byte that is no UTF-8 becomes U+FFFD."""
        texts = [self.text_of[i] for i in ids]
        if None not in texts:
            return "".join(texts)
        out: list[str] = []
        run = b""
        for i in ids:
            byte = self.byte_of.get(i)
            if byte is not None:
                run += byte
                continue
            if run:
                out.append(bytes_text(run))
                run = b""
            out.append("" if i in self.control else " ⁇ " if i in self.unknown else self.pieces[i])
        if run:
            out.append(bytes_text(run))
        return "".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        text = self.decode_raw(ids)
        return text.removeprefix(SPACE).replace(SPACE, " ")


class SegmentIds(dict):
    """Ids of segments as decimals joined by commas, found when they are first asked for. `odd` has the decoded text of
    those segments that do not decode to themselves. When there are `limit` segments they become the old ones, and the old
    ones that nobody asked for since then are forgotten, which changes no result."""

    def __init__(self, model: MergeModel, limit: int = 300_000):
        super().__init__()
        self.model, self.limit, self.old = model, limit, {}
        self.numbers = [str(i) for i in range(len(model.pieces))]
        self.odd: dict[str, str] = {}

    def __missing__(self, segment: str) -> str:
        found = self.old.get(segment)
        if found is not None:
            self[segment] = found
            return found
        ids = self.model.encode_segment(segment)
        text = self.model.decode_raw(ids)
        if text != segment:
            self.odd[segment] = text
        found = self[segment] = ",".join([self.numbers[i] for i in ids])
        return found

    def bound(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
            self.odd = {s: x for s, x in self.odd.items() if s in self.old}

    def forget(self) -> None:
        """Frees the memory, since Python workers outlive the task."""
        self.clear()
        self.old, self.odd = {}, {}
        self.model.fits.clear()

    def encode_decode(self, text: str) -> tuple[str, str]:
        """A text's ids joined by commas, and what they decode to."""
        self.bound()
        segments = segments_of(text)
        ids = ",".join(map(self.__getitem__, segments))
        decoded = "".join([self.odd.get(s, s) for s in segments] if self.odd else segments)
        return ids, decoded.removeprefix(SPACE).replace(SPACE, " ")


def bytes_text(run: bytes) -> str:
    """UTF-8 with each byte that belongs to no character as one U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


def segments_of(text: str) -> list[str]:
    """Parts of the marked text that encode independently."""
    return _SEGMENT.findall(SPACE + text.replace(" ", SPACE)) if text else []


@lru_cache(maxsize=2)
def model(path: str) -> MergeModel:
    return MergeModel(path)


@lru_cache(maxsize=2)
def segment_ids(path: str) -> SegmentIds:
    return SegmentIds(model(path))


def _encoded(docs: DataFrame, path: str, row, names: list[str], schema: str) -> DataFrame:
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the memory makes no cycles, and many small objects make collections slow
        memory = segment_ids(path)
        try:
            for b in batches:
                rows = [row(*memory.encode_decode(t or "")) for t in b.column(1).to_pylist()]
                columns = list(zip(*rows, strict=True)) if rows else [()] * (len(names) - 1)
                kinds = [f.type for f in _KINDS[schema]]
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)
        finally:
            memory.forget()
            gc.enable()

    return docs.mapInArrow(run, "doc_id long, " + schema)


_DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"
_FULL = "ids array<int>, decoded string"
_KINDS = {
    _DIGEST: pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]),
    _FULL: pa.schema([("ids", pa.list_(pa.int32())), ("decoded", pa.string())]),
}


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _digest_row(ids: str, text: str) -> tuple:
    return (ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def _full_row(ids: str, text: str) -> tuple:
    return ([int(x) for x in ids.split(",")] if ids else [], text)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its ids and the text that they decode to."""
    return _encoded(_input(docs, id_col, text_col), path, _full_row, ["doc_id", "ids", "decoded"], _FULL)


def encode_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like `encode_decode`, but with the ids' number and digest and the decoded text's digest in their place."""
    return _encoded(_input(docs, id_col, text_col), path, _digest_row, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], _DIGEST)
