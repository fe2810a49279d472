"""Parameters of the engine, one frozen dataclass for each group, and their text forms."""

from __future__ import annotations

import math
import re
import shlex
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any


def percent(text: str) -> float:
    """A finite percentage of 0 or more from its text, which ends in `%`."""
    if not text.endswith("%"):
        raise ValueError(f"{text!r} does not end in %")
    value = float(text[:-1])
    if not math.isfinite(value) or value < 0:
        raise ValueError(f"{text!r} is not a percentage")
    return value


_UNITS = {"ms": 1, "s": 1000, "m": 60_000, "min": 60_000, "h": 3_600_000}


def duration_ms(text: str) -> int:
    """Milliseconds of a text such as `4.2s`, `10s`, `1m 30s`."""
    parts = re.findall(r"\s*([0-9.]+)\s*(ms|min|s|m|h)\s*", text)
    if not parts or "".join(a + b for a, b in parts) != re.sub(r"\s", "", text):
        raise ValueError(f"{text!r} is no duration")
    return round(sum(float(n) * _UNITS[u] for n, u in parts))


@dataclass(frozen=True)
class Similarity:
    #: Bits that two hashes may differ in and still be similar, itself included.
    threshold: int = 23


@dataclass(frozen=True)
class Borders:
    #: Grey values up to this are black in the mask.
    maskify_threshold: int = 40
    #: Rows and columns with at most this share of the fullest one's white pixels are border, in percent.
    maximum_whites: float = 10.0


@dataclass(frozen=True)
class OneColour:
    #: Share of pixels near the most common grey from which an image is bland, in percent.
    threshold: float = 90.0
    #: Distance up to which a grey is near.
    tolerance: int = 20


@dataclass(frozen=True)
class Quality:
    borders: Borders = field(default_factory=Borders)
    one_colour: OneColour = field(default_factory=OneColour)
    #: Share of an image up to which what is left inside its borders is empty, in percent.
    emptiness: float = 10.0


@dataclass(frozen=True)
class Sampling:
    min_frames: int = 5
    step_ms: int = 10_000
    phantom_steps_ms: tuple[int, ...] = (4_200,)
    #: Frame dumps.
    dump_step_ms: int = 1_000
    dump_offset_ms: int = 0
    dump_count: int = 10


@dataclass(frozen=True)
class Debug:
    max_collisions: int = 100
    root: str = "../../"
    entry_dir: str = "."


@dataclass(frozen=True)
class Legacy:
    """Values of the older pipeline with 64-bit hashes."""

    threshold: int = 3
    mask_threshold: int = 20
    border_limit: float = 0.03
    window_s: float = 20.0
    samples: int = 17
    rebuild_dead_percent: float = 5.0
    save_every: int = 400


def flag_list(default: tuple, argv: list[str], flag: str, kind=int) -> tuple:
    """Values of a flag that takes any number of values; repeats append, and any use replaces the default."""
    out: list[Any] | None = None
    at = 0
    while at < len(argv):
        if argv[at] == flag:
            out = [] if out is None else out
            at += 1
            while at < len(argv) and not argv[at].startswith("--"):
                out.append(kind(argv[at]))
                at += 1
        else:
            at += 1
    return default if out is None else tuple(out)


def override(conf, **values):
    """A copy with some values replaced; unknown names are errors."""
    names = {f.name for f in fields(conf)}
    if unknown := set(values) - names:
        raise TypeError(f"unknown: {sorted(unknown)}")
    return type(conf)(**({f.name: getattr(conf, f.name) for f in fields(conf)} | values))


def arguments(argv: list[str], rc_file: str = ".nearkinrc") -> list[str]:
    """The command line, or the words of the rc file where the command line is empty and the file is there."""
    if argv:
        return argv
    path = Path(rc_file)
    return shlex.split(path.read_text(), posix=False) if path.is_file() else []
