"""A bounded memory of results for the segments of texts, for tokenizers whose tokens never cross segment borders."""

from __future__ import annotations

from collections.abc import Iterable


class Memo(dict):
    """Results by segment. When it is full, everything is forgotten, which changes no result: a segment's result
    depends on nothing else. It holds at most `limit` entries of `chars` characters besides those last asked for."""

    def __init__(self, limit: int = 300_000, chars: int = 6_000_000):
        super().__init__()
        self.limit, self.chars, self.held = limit, chars, 0

    def missing(self, wanted: Iterable[str]) -> list[str]:
        """Those of the distinct `wanted` segments whose results the caller has to add."""
        wanted = list(wanted)
        new = [x for x in wanted if x not in self]
        size = sum(map(len, new))
        if new and len(self) and (len(self) + len(new) > self.limit or self.held + size > self.chars):
            self.clear()
            new, self.held = wanted, 0
            size = sum(map(len, new))
        self.held += size
        return new
