"""Relative paths with `/` as plain text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_simple(path: Column) -> Column:
    """Whether all parts are plain names; the empty path is simple."""
    return (path == "") | ~F.exists(F.split(path, "/"), lambda part: part.isin("", ".", ".."))


def depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def relative_from_file(file: Column, target: Column) -> Column:
    """The path from a file's folder to target, both below one root; null for the empty path, which names no file."""
    return F.when(file != "", F.concat(F.repeat(F.lit("../"), depth(file) - 1), target))


def relative_from_dir(folder: Column, target: Column) -> Column:
    """The path from a folder to target, both below one root; without a slash at its end."""
    up = F.repeat(F.lit("../"), depth(folder))
    return F.when(target == "", F.rtrim(up, F.lit("/"))).otherwise(F.concat(up, target))


def below_root(path: Column) -> Column:
    """The path without the `..` parts in front."""
    return F.regexp_replace(path, r"^(\.\.(/|$))+", "")


def is_basename(path: Column) -> Column:
    return path.rlike("^[^/]+$") & ~path.isin(".", "..")


def as_filename(path: Column) -> Column:
    """A file name that shows a path."""
    return F.replace(path, F.lit("/"), F.lit("!"))
