"""Files, images and archives as DataFrames."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(path, modified, size) of the files directly in any of the folders, each path once. Sub-folders are not listed; a folder
    that can't be read is an error."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folders)
    return found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size")).dropDuplicates(["path"])


def read_images(spark: SparkSession, folders: list[str], drop_invalid: bool = False) -> DataFrame:
    """(path, w, h, px): images decoded by Spark's reader, as packed RGB pixels."""
    image = spark.read.format("image").option("dropInvalid", str(drop_invalid).lower()).load(folders).select("image.*")
    return image.select(F.col("origin").alias("path"), "width", "height", "nChannels", "data").mapInArrow(_pixels, "path string, w int, h int, px array<int>")


def _pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for b in batches:
        out = []
        for r in b.to_pylist():
            w, h, n = r["width"], r["height"], r["nChannels"]
            raw = np.frombuffer(r["data"] or b"", np.uint8)
            raw = raw.reshape(h, w, n).astype(np.int32) if w > 0 and h > 0 else np.zeros((0, 0, 3), np.int32)
            blue, green, red = (raw[..., i] for i in (0, 1, 2)) if raw.shape[2] >= 3 else (raw[..., 0],) * 3
            out.append({"path": r["path"], "w": max(w, 0), "h": max(h, 0), "px": (red << 16 | green << 8 | blue).ravel().tolist()})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("w", pa.int32()), ("h", pa.int32()), ("px", pa.list_(pa.int32()))]))


def image_kind(name: str, data: bytes) -> str | None:
    """The format of an image by its first bytes, else by its name."""
    for head, kind in ((b"\x89PNG", "png"), (b"\xff\xd8\xff", "jpeg"), (b"GIF8", "gif"), (b"BM", "bmp")):
        if data.startswith(head):
            return kind
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    return {".png": "png", ".jpg": "jpeg", ".jpeg": "jpeg", ".gif": "gif", ".bmp": "bmp", ".webp": "webp"}.get(posixpath.splitext(name.lower())[1])


def archive_pages(spark: SparkSession, folders: list[str], pattern: str = "*.cbz") -> DataFrame:
    """(archive, page, name, kind, content): the members of zip archives in their order, without folders. A member that
    can't be read is an error. One archive is one unit of work; its members come out one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    page = 0
                    for info in z.infolist():
                        if info.is_dir():
                            continue
                        data = z.read(info)
                        yield pa.RecordBatch.from_pylist([{"archive": path, "page": page, "name": info.filename, "kind": image_kind(info.filename, data), "content": data}], schema=_PAGE)
                        page += 1

    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folders)
    return found.select("path", "content").mapInArrow(run, "archive string, page int, name string, kind string, content binary")


_PAGE = pa.schema([("archive", pa.string()), ("page", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("content", pa.binary())])


def page_files(pages: DataFrame) -> DataFrame:
    """(archive, file, content) with the file names of a page dump."""
    return pages.select("archive", F.format_string("page_%d.jpg", "page").alias("file"), "content")
