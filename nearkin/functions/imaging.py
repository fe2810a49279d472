"""Pixel arrays: grey or packed RGB rows in one ARRAY<INT> column, reshaped with index arithmetic inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "array<int>"


def _gather(n: Column, px: Column, at) -> Column:
    """A new array of n pixels, the i-th taken from place at(i)."""
    built = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.get(px, at(i).cast("int")))
    return F.when(n > 0, built).otherwise(F.array().cast(EMPTY))


def _div(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast("int")


def mirror(w: Column, px: Column) -> Column:
    """Left and right exchanged."""
    return _gather(F.size(px), px, lambda i: i - i % w + w - 1 - i % w)


def rotate(w: Column, h: Column, px: Column, degrees: int) -> Column:
    """Turned clockwise by 90, 180 or 270 degrees; by 90 and 270, width and height change places."""
    if degrees == 180:
        return F.reverse(px)
    if degrees == 90:
        return _gather(F.size(px), px, lambda i: (h - 1 - i % h) * w + _div(i, h))
    if degrees == 270:
        return _gather(F.size(px), px, lambda i: (i % h) * w + w - 1 - _div(i, h))
    raise ValueError("90, 180 or 270 degrees")


def upright(w: Column, h: Column, px: Column, angle: Column) -> Column:
    """Undoes a display matrix's rotation; other angles than quarter turns leave the image."""
    return F.when(angle == -90, rotate(w, h, px, 90)).when(angle == 90, rotate(w, h, px, 270)).when(F.abs(angle) == 180, rotate(w, h, px, 180)).otherwise(px)


def maskify(px: Column, threshold: int = 40) -> Column:
    """0 where a pixel is at most the threshold, else 255."""
    return F.transform(px, lambda p: F.when(p <= threshold, 0).otherwise(255))


def crop(w: Column, px: Column, x: Column, y: Column, cw: Column, ch: Column) -> Column:
    return _gather(cw * ch, px, lambda i: (y + _div(i, F.greatest(cw, F.lit(1)))) * w + x + i % F.greatest(cw, F.lit(1)))


def unstride(px: Column, w: Column, h: Column, stride: Column) -> Column:
    """Rows of w pixels out of rows that are padded to `stride`."""
    return _gather(w * h, px, lambda i: _div(i, w) * stride + i % w)


def filled(w: int, h: int, value: int) -> Column:
    return F.array_repeat(F.lit(value), w * h)


def is_empty(w: Column, h: Column) -> Column:
    return (w == 0) | (h == 0)


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def grey(rgb: Column) -> Column:
    """Brightness of packed RGB pixels with the weights of ITU-R BT.709, in ten thousandths, cut off."""
    part = lambda p, shift: F.shiftright(p, shift).bitwiseAND(255)
    return F.transform(rgb, lambda p: F.floor((part(p, 16) * 2126 + part(p, 8) * 7152 + part(p, 0) * 722) / 10000).cast("int"))


def rgb_distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))
