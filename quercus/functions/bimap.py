"""Maps that can be read both ways: a table ``left, right`` in which neither side repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def conflicts(pairs: DataFrame) -> DataFrame:
    """``side, key, n``: keys that stand with several of the other side."""
    p = pairs.select("left", "right").distinct()
    one = lambda a, b: p.groupBy(F.col(a).alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(a).alias("side"), "key", "n")
    return one("left", "right").unionByName(one("right", "left"))


def put(pairs: DataFrame, new: DataFrame) -> DataFrame:
    """The map with new pairs; pairs that share a side with a new one go."""
    old = pairs.join(new.select("left"), "left", "left_anti").join(new.select("right"), "right", "left_anti")
    return old.select("left", "right").unionByName(new.select("left", "right"))
