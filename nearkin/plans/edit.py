"""The maintenance language of an index: `stats`, `rebuild`, `list:FILE`, `export:DIR`, `import:DIR`, `purge:DIR` and
`randel:N`, done from left to right; the first failure ends it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from nearkin.plans.collisions import listing, random_paths
from nearkin.plans.index import HashIndex

PLAIN, WITH_PLACE, WITH_NUMBER = ("stats", "rebuild"), ("list", "export", "import", "purge"), ("randel",)


@dataclass(frozen=True)
class Goal:
    name: str
    value: str | int | None = None


def parse(text: str) -> Goal:
    name, colon, value = text.partition(":")
    if name in PLAIN and not colon:
        return Goal(name)
    if name in WITH_PLACE and value:
        return Goal(name, value)
    if name in WITH_NUMBER and value.isdigit():
        return Goal(name, int(value))
    raise ValueError(f"not a goal: {text!r}")


def perform(index: HashIndex, goal: Goal, seed: int = 0):
    """Does one goal; statistics and numbers of removed rows are its value."""
    if goal.name == "stats":
        return index.stats().first().asDict()
    if goal.name == "rebuild":
        return index.rebuild()
    live = lambda: index.scan().select("hi", "lo", F.col("src.path").alias("path"))
    if goal.name == "list":
        return listing(live()).write.mode("overwrite").text(goal.value)
    if goal.name == "export":
        return index.export(goal.value)
    if goal.name == "import":
        return index.load(goal.value)
    if goal.name == "purge":
        both = index.spark.read.json(goal.value).select(F.explode(F.array("reference.path", "other.path")).alias("path"))
        return index.remove(both)
    return index.remove(random_paths(live(), goal.value, seed))


def run(index: HashIndex, goals: list[str], seed: int = 0) -> list:
    """Parses all goals first, then does them in turn."""
    parsed = [parse(g) for g in goals]
    return [perform(index, g, seed) for g in parsed]
