"""Frame quality: blandness, borders, emptiness, the crop that is hashed, and the list of ignored frames.

An image is a row (id, w, h, px) with grey pixels. `judge` works in numpy on Arrow batches, one image at a time, and
never shuffles; all figures of an image come from one pass over its pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.conf import Quality
from nearkin.functions.hashing import image_hash
from nearkin.functions.measures import clock
from nearkin.operators.dealing import settled
from nearkin.operators.rangejoin import find_within

# Names of the reasons, which are parts of file names.
OK, EMPTY, TOO_ONE_COLOUR, IGNORED, SIMILAR = "ok", "empty", "too_one_color", "ignored", "similar_previous"


def modal_grey(grey: np.ndarray) -> int:
    """The most common value; of equally common ones the largest."""
    counts = np.bincount(grey.ravel(), minlength=256)
    return int(255 - counts[::-1].argmax())


def near_percent(grey: np.ndarray, value: int, tolerance: int) -> float:
    """Share of pixels within the tolerance of a value, in percent; an image without pixels has none."""
    if not grey.size:
        raise ValueError("an image without pixels has no share of a colour")
    return 100.0 * int((np.abs(grey.astype(np.int64) - value) <= tolerance).sum()) / grey.size


def one_colour_percent(grey: np.ndarray, tolerance: int) -> float:
    return near_percent(grey, modal_grey(grey), tolerance)


def _extent(whites: np.ndarray, limit: float) -> tuple[int, int]:
    """First place and length of the stretch whose ends have more than `limit` percent of the largest count."""
    most = whites.max(initial=0)
    if not most:
        return 0, 0
    at = np.flatnonzero(100.0 * whites / most > limit)
    return (int(at[0]), int(at[-1] - at[0] + 1)) if len(at) else (0, 0)


def border_box(mask: np.ndarray, limit: float) -> tuple[int, int, int, int]:
    """x, y, width and height of what is inside the borders of a mask of 0 and 255."""
    if not mask.size:
        return 0, 0, 0, 0
    white = mask == 255
    (x, w), (y, h) = _extent(white.sum(axis=0), limit), _extent(white.sum(axis=1), limit)
    return x, y, w, h


def border_box_by_length(mask: np.ndarray, limit: float = 0.03) -> tuple[int, int, int, int] | None:
    """The older rule: a column or row is inside if more than `limit` of its own length is white; None if nothing is."""
    if not mask.size:
        return None
    white = mask > 0
    columns = np.flatnonzero(white.sum(axis=0) / mask.shape[0] > limit)
    rows = np.flatnonzero(white.sum(axis=1) / mask.shape[1] > limit)
    if not len(columns) or not len(rows):
        return None
    return int(columns[0]), int(rows[0]), int(columns[-1] - columns[0] + 1), int(rows[-1] - rows[0] + 1)


def content(grey: np.ndarray, conf: Quality) -> tuple[tuple[int, int, int, int], np.ndarray]:
    """The box inside the borders, and the pixels in it."""
    mask = np.where(grey <= conf.borders.maskify_threshold, 0, 255)
    x, y, w, h = box = border_box(mask, conf.borders.maximum_whites)
    return box, grey[y : y + h, x : x + w]


def verdict(grey: np.ndarray, conf: Quality) -> tuple[str, tuple[int, int, int, int], float]:
    """Reason, box and covered percentage. The whole image's colour is looked at first, then what the borders leave, then
    the colour of that."""
    box, inside = content(grey, conf)
    covered = 100.0 * inside.size / grey.size if grey.size else 0.0
    bland = lambda g: g.size > 0 and one_colour_percent(g, conf.one_colour.tolerance) >= conf.one_colour.threshold
    if bland(grey):
        return TOO_ONE_COLOUR, box, covered
    if covered <= conf.emptiness:
        return EMPTY, box, covered
    return (TOO_ONE_COLOUR if bland(inside) else OK), box, covered


JUDGED = "id long, modal int, one_colour double, x int, y int, cw int, ch int, covered double, reason string, hi long, lo long, mirror_hi long, mirror_lo long"


def judge(images: DataFrame, conf: Quality | None = None) -> DataFrame:
    """Per image (id, w, h, px): its figures, the reason to reject it or `ok`, and for accepted ones the hashes of the crop
    and of the mirrored crop. Null pixels count as an image without pixels: empty, without modal value."""
    conf = conf or Quality()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            px = b.column("px")
            edge, values = px.offsets.to_numpy(), px.values.to_numpy(zero_copy_only=False).astype(np.int64)
            out: list[list] = [[] for _ in _NAMES]
            for i, (key, w, h) in enumerate(zip(*(b.column(c).to_pylist() for c in ("id", "w", "h")), strict=True)):
                pixels = values[edge[i] : edge[i + 1]]
                grey = pixels.reshape(h, w) if pixels.size else np.zeros((0, 0), np.int64)
                reason, box, covered = verdict(grey, conf)
                modal = modal_grey(grey) if grey.size else None
                share = near_percent(grey, modal, conf.one_colour.tolerance) if grey.size else None
                hashes = (None,) * 4
                if reason == OK:
                    x, y, cw, ch = box
                    inside = grey[y : y + ch, x : x + cw]
                    hashes = (*image_hash(inside), *image_hash(inside[:, ::-1]))
                for column, value in zip(out, (key, modal, share, *box, covered, reason, *hashes), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SCHEMA, strict=True)], schema=_SCHEMA)

    return images.select(F.col("id").cast("long"), F.col("w").cast("int"), F.col("h").cast("int"), F.col("px").cast("array<int>")).mapInArrow(run, JUDGED)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
_SCHEMA = pa.schema([(n, _KINDS[t]) for n, t in (x.split(" ") for x in JUDGED.split(", "))])
_NAMES = _SCHEMA.names


def rejected(judged: DataFrame, frames: DataFrame) -> DataFrame:
    """The graveyard: rejected frames that are not mirrored, with their reason; frames too similar to the one before are not
    kept. judged: id, reason; frames: id, mirrored, ts (ms). `file` is the name under which a rejected frame is kept."""
    bad = judged.where(F.col("reason").isin(EMPTY, TOO_ONE_COLOUR, IGNORED))
    return frames.where(F.col("mirrored") == "Normal").join(bad.select("id", "reason"), "id").withColumn("file", F.format_string("%s_%s.jpg", F.col("reason"), clock(F.col("ts"))))


def ignore_list(judged: DataFrame, within: int = 23) -> DataFrame:
    """(id, mirrored, hi, lo) of the hashes to ignore. In order of id, accepted images give their hash and their mirrored one,
    but one that is similar to a kept, not mirrored hash of another image is left out. What is kept depends on all kept
    before, so it is found in rounds: an image without an undecided or kept earlier neighbour is kept, and its later neighbours
    are not. There are as many rounds as the longest chain of neighbours needs, and each one is settled."""
    good = settled(judged.where(F.col("reason") == OK).select("id", "hi", "lo", "mirror_hi", "mirror_lo"))
    normal = good.select("id", F.lit("Normal").alias("mirrored"), "hi", "lo")
    both = normal.unionByName(good.select("id", F.lit("Mirrored").alias("mirrored"), F.col("mirror_hi").alias("hi"), F.col("mirror_lo").alias("lo")))
    pairs = find_within(both, normal, within)
    others = normal.select(F.col("id").alias("other"), F.col("hi").alias("s_hi"), F.col("lo").alias("s_lo"))
    met = both.withColumnsRenamed({"hi": "q_hi", "lo": "q_lo"}).join(pairs, ["q_hi", "q_lo"]).join(others, ["s_hi", "s_lo"])
    against = settled(met.where("other < id").select("id", "mirrored", "other").distinct())
    left = against.where("mirrored = 'Normal'").select("id", "other")
    gone = left.select("id").limit(0)
    while not left.isEmpty():
        kept = left.select("other").distinct().join(left.select(F.col("id").alias("other")).distinct(), "other", "left_anti")
        now = left.join(kept, "other", "left_semi").select("id").distinct()
        gone = settled(gone.union(now))
        left = left.join(gone, "id", "left_anti").join(gone.select(F.col("id").alias("other")), "other", "left_anti")
        left = settled(left.select("id", "other"))
    kept_others = against.join(gone.select(F.col("id").alias("other")), "other", "left_anti")
    return both.join(kept_others.select("id", "mirrored").distinct(), ["id", "mirrored"], "left_anti")


def average_colour(r, g, b):
    """Root mean squares of three colour columns, cut off to whole numbers."""
    one = lambda c: F.floor(F.sqrt(F.avg(c * c))).cast("int")
    return one(r), one(g), one(b)


def colour_variance(pixels: DataFrame) -> DataFrame:
    """(id, r, g, b, variance): average colour and the sample variance of the pixels' distances to it. pixels: id, r, g, b."""
    means = average_colour(F.col("r"), F.col("g"), F.col("b"))
    of = pixels.groupBy("id").agg(*[m.alias(n) for m, n in zip(means, ("mr", "mg", "mb"), strict=True)])
    square = sum(((F.col(c) - F.col("m" + c)) * (F.col(c) - F.col("m" + c)) for c in "rgb"), F.lit(0))
    far = pixels.join(of, "id").withColumn("distance", F.sqrt(square.cast("double")))
    return far.groupBy("id", "mr", "mg", "mb").agg(F.coalesce(F.var_samp("distance"), F.lit(0.0)).alias("variance")).withColumnsRenamed({"mr": "r", "mg": "g", "mb": "b"})


def resize(grey: np.ndarray, new_height: int) -> np.ndarray:
    """Scaled to a height with the aspect kept (width cut off to whole pixels), with a Lanczos kernel of three lobes."""
    height, width = grey.shape
    new_width = new_height * width // height if height else 0

    def weights(size: int, new: int) -> np.ndarray:
        scale = size / new
        reach = 3 * max(1.0, scale)
        centre = (np.arange(new) + 0.5) * scale - 0.5
        x = (np.arange(size)[None, :] - centre[:, None]) / max(1.0, scale)
        w = np.where(np.abs(x) * max(1.0, scale) < reach, np.sinc(x) * np.sinc(x / 3), 0)
        return w / w.sum(axis=1, keepdims=True)

    if not new_width or not new_height:
        return np.zeros((max(new_height, 0), new_width), np.int64)
    scaled = weights(height, new_height) @ grey @ weights(width, new_width).T
    return np.clip(np.rint(scaled), 0, 255).astype(np.int64)


def worsen(grey: np.ndarray, new_height: int) -> np.ndarray:
    """Scaled down and up again to the old height."""
    return resize(resize(grey, new_height), grey.shape[0])


def _by_image(images: DataFrame, one, schema: str) -> DataFrame:
    """(id, ...) of `one(grey)` for each image (id, w, h, px); null pixels count as an image without pixels."""
    fields = [x.split(" ") for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            px = b.column("px")
            edge, values = px.offsets.to_numpy(), px.values.to_numpy(zero_copy_only=False).astype(np.int64)
            shapes = zip(b.column("w").to_pylist(), b.column("h").to_pylist(), strict=True)
            made = [one(values[edge[i] : edge[i + 1]].reshape((h, w) if edge[i + 1] > edge[i] else (0, 0))) for i, (w, h) in enumerate(shapes)]
            columns = [pa.array([m[k] for m in made], _ARROW[t]) for k, (_, t) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *columns], names=["id", *(n for n, _ in fields)])

    return images.select(F.col("id").cast("long"), F.col("w").cast("int"), F.col("h").cast("int"), F.col("px").cast("array<int>")).mapInArrow(run, f"id long, {schema}")


_ARROW = {"int": pa.int32(), "array<int>": pa.list_(pa.int32())}


def boxes_by_length(images: DataFrame, threshold: int = 40, limit: float = 0.03) -> DataFrame:
    """(id, x, y, cw, ch) inside the borders by the older rule; null where nothing is left."""
    return _by_image(images, lambda grey: border_box_by_length(grey > threshold, limit) or (None,) * 4, "x int, y int, cw int, ch int")


def worsened(images: DataFrame, new_height: int) -> DataFrame:
    """(id, w, h, px): images scaled down to a height and up again; images without pixels stay without."""

    def one(grey: np.ndarray):
        made = worsen(grey, new_height) if grey.size else grey
        return made.shape[1], made.shape[0], made.ravel().tolist()

    return _by_image(images, one, "w int, h int, px array<int>")
