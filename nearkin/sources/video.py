"""Videos as a Spark data source: one partition for each file, frames decoded on the executors.

Decoders are plugged in by name. `register` adds one for this process; the option `decoder` may also name `module:function`, which executors import. A
decoder takes (path, target_ms, step_ms, columns) and yields (ts, tb_num, tb_den, first_ts, w, h, px) for each frame with
ts at or behind the target in order; it may use the step to seek. The source gives upright packed RGB frames without row
padding. `raw` reads a simple container of this library, for tests and for frames that other tools have unpacked; `y4m` reads
YUV4MPEG2 files of 8 bits a sample; `ffmpeg` reads whatever an ffmpeg program on the executors can turn into such a stream.
"""

from __future__ import annotations

import importlib
import struct
import subprocess
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, frame_no long, ts long, tb_num int, tb_den int, first_ts long, w int, h int, px array<int>, error string"
_decoders: dict[str, Callable] = {}


def register(name: str, decoder: Callable) -> None:
    _decoders[name] = decoder


def decoder_of(name: str) -> Callable:
    if name in _decoders:
        return _decoders[name]
    module, colon, function = name.partition(":")
    if not colon:
        raise ValueError(f"no decoder {name!r}")
    return getattr(importlib.import_module(module), function)


#: Header of the raw container: mark, time base, first stamp, width, height, frames; then stamp and grey rows for each frame.
_HEAD, _MARK = struct.Struct("<4siiqiii"), b"NKRV"


def write_raw(path: str, frames: list[tuple[int, bytes]], w: int, h: int, tb: tuple[int, int] = (1, 1000), first_ts: int = 0) -> None:
    with open(path, "wb") as f:
        f.write(_HEAD.pack(_MARK, *tb, first_ts, w, h, len(frames)))
        for ts, grey in frames:
            f.write(struct.pack("<q", ts) + grey)


def read_raw(path: str, target_ms: int, step_ms: int, columns: set[str]) -> Iterator[tuple]:
    with open(_local(path), "rb") as f:
        head = f.read(_HEAD.size)
        if len(head) < _HEAD.size or head[:4] != _MARK:
            raise ValueError(f"{path} is no raw video")
        _, num, den, first, w, h, n = _HEAD.unpack(head)
        for _ in range(n):
            (ts,) = struct.unpack("<q", f.read(8))
            if (ts - first) * num * 1000 < target_ms * den or "px" not in columns:
                f.seek(w * h, 1)
                px = None
            else:
                px = [g << 16 | g << 8 | g for g in f.read(w * h)]
            if (ts - first) * num * 1000 >= target_ms * den:
                yield ts, num, den, first, w, h, px


register("raw", read_raw)


def _local(path: str) -> str:
    return path[5:] if path.startswith("file:") else path


def y4m_frames(stream, target_ms: int, columns: set[str]) -> Iterator[tuple]:
    """Frames of a YUV4MPEG2 stream. Its pixels are turned into RGB with the weights of ITU-R BT.601, full range kept as it is."""
    head = stream.readline().decode("ascii", "replace").split()
    if not head or head[0] != "YUV4MPEG2":
        raise ValueError("no YUV4MPEG2 stream")
    fields = {x[0]: x[1:] for x in head[1:]}
    w, h = int(fields["W"]), int(fields["H"])
    num, den = (int(x) for x in fields.get("F", "25:1").split(":"))
    kind = fields.get("C", "420jpeg")
    if "p1" in kind or not kind.startswith(("420", "422", "444", "mono")):
        raise ValueError(f"samples of kind {kind} are not read")
    across, down = (2, 2) if kind.startswith("420") else (2, 1) if kind.startswith("422") else (1, 1)
    small = 0 if kind.startswith("mono") else -(-w // across) * -(-h // down)
    number = 0
    while line := stream.readline():
        if not line.startswith(b"FRAME"):
            raise ValueError("a frame without its mark")
        data = stream.read(w * h + 2 * small)
        if len(data) < w * h + 2 * small:
            raise ValueError("the stream is cut short")
        if number * den * 1000 >= target_ms * num:
            px = None
            if "px" in columns:
                y = np.frombuffer(data, np.uint8, w * h).reshape(h, w).astype(float)
                u = v = np.zeros((h, w))
                if small:
                    planes = np.frombuffer(data, np.uint8, 2 * small, w * h).reshape(2, -(-h // down), -(-w // across)).astype(float) - 128
                    u, v = (np.repeat(np.repeat(p, down, 0), across, 1)[:h, :w] for p in planes)
                rgb = [np.clip(np.rint(c), 0, 255).astype(np.int32) for c in (y + 1.402 * v, y - 0.344136 * u - 0.714136 * v, y + 1.772 * u)]
                px = (rgb[0] << 16 | rgb[1] << 8 | rgb[2]).ravel().tolist()
            yield number, den, num, 0, w, h, px
        number += 1


def read_y4m(path: str, target_ms: int, step_ms: int, columns: set[str]) -> Iterator[tuple]:
    with open(_local(path), "rb") as f:
        yield from y4m_frames(f, target_ms, columns)


def read_ffmpeg(path: str, target_ms: int, step_ms: int, columns: set[str]) -> Iterator[tuple]:
    """Frames as an ffmpeg program decodes them, upright and at a constant rate."""
    with subprocess.Popen(["ffmpeg", "-v", "error", "-nostdin", "-i", _local(path), "-pix_fmt", "yuv444p", "-f", "yuv4mpegpipe", "-strict", "-1", "-"], stdout=subprocess.PIPE) as run:
        try:
            yield from y4m_frames(run.stdout, target_ms, columns)
        finally:
            run.stdout.close()


register("y4m", read_y4m)
register("ffmpeg", read_ffmpeg)


class _File(InputPartition):
    pass


class VideoReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.decoder = options.get("decoder", "raw")
        self.target, self.step = int(options.get("from_ms", 0)), int(options.get("step_ms", 0))
        self.names = schema.names
        self.on_error = options.get("on_error", "raise")

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """Frames in order; with a step, the next one is the first at or behind the last taken one plus the step."""
        after = self.target
        try:
            yield from self._frames(partition.value, after)
        except Exception as e:  # noqa: BLE001 - a file that can't be read is told as a row, if so wanted
            if self.on_error != "row":
                raise
            row = {"path": partition.value, "error": f"{type(e).__name__}: {e}"}
            yield tuple(row.get(n) for n in self.names)

    def _frames(self, path: str, after: float) -> Iterator[tuple]:
        for number, (ts, num, den, first, w, h, px) in enumerate(decoder_of(self.decoder)(path, self.target, self.step, set(self.names))):
            now = (ts - first) * num * 1000 / den
            if now < after:
                continue
            after = now + self.step
            row = {"path": path, "frame_no": number, "ts": ts, "tb_num": num, "tb_den": den, "first_ts": first, "w": w, "h": h, "px": px, "error": None}
            yield tuple(row[n] for n in self.names)


class VideoSource(DataSource):
    """`spark.read.format("nearkin_video")`, options: path or paths (comma-separated), decoder, from_ms, step_ms, on_error
    (`raise`, or `row`: a file that can't be read gives a row with its `error` behind the frames it gave). A schema of fewer columns than all reads only those; without px no pixels are decoded."""

    @classmethod
    def name(cls) -> str:
        return "nearkin_video"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> VideoReader:
        return VideoReader(self.options, schema)
