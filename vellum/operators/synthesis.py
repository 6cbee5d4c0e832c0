"""Synthetic pages and distortions for tests of the layout operators.

A page is generated from its number and a seed only, so any task makes the same page again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import geometry

#: Distortion kinds with their strength as a share of the page's height.
KINDS = {"sine": 0.02, "parabola": 0.03, "left": 0.05, "right": 0.05}


def uniform(seed: int, *of: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the given values only."""
    return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 53)) / float(1 << 53)


def drifting(previous: Column, share: Column, low: float, high: float, change: float) -> Column:
    """The next value within +-change of the one before, inside the range; share in [0, 1)."""
    lo, hi = F.greatest(F.lit(low), previous * (1 - change)), F.least(F.lit(high), previous * (1 + change))
    return lo + share * (hi - lo)


def pages(spark: SparkSession, n: int, width: int = 256, height: int = 320, lines: tuple[int, int] = (5, 20), seed: int = 42) -> DataFrame:
    """(page_id, line_id, y0, y1, x, y): ink cells of pages with straight lines of words."""
    page = spark.range(n).withColumnRenamed("id", "page_id")
    count = (lines[0] + F.floor(uniform(seed, F.col("page_id")) * (lines[1] - lines[0] + 1))).cast("int")
    rows = page.withColumn("k", count).withColumn("line_id", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    pitch = F.lit(height) / (F.col("k") + 1)
    rows = rows.withColumns({"y0": F.floor(pitch * (F.col("line_id") + 0.7)).cast("int"), "size": F.greatest(F.lit(3), F.floor(pitch * 0.45)).cast("int")})
    rows = rows.withColumn("y1", F.col("y0") + F.col("size") - 1)
    margin = width // 10
    cells = rows.withColumn("x", F.explode(F.sequence(F.lit(margin), F.lit(width - margin - 1)))).withColumn("y", F.explode(F.sequence("y0", "y1")))
    word = uniform(seed + 1, F.col("page_id"), F.col("line_id"), F.floor(F.col("x") / 7)) > 0.15
    ink = uniform(seed + 2, F.col("page_id"), F.col("x"), F.col("y")) > 0.4
    return cells.where(word & ink).select("page_id", "line_id", "y0", "y1", "x", "y")


def distorted(ink: DataFrame, kind: str, width: int, height: int) -> DataFrame:
    """ink with every column moved by the kind's shift."""
    return geometry.warp(ink, geometry.displacement(kind, F.col("x"), width, KINDS[kind] * height), height)


def straightened(ink: DataFrame, kind: str, width: int, height: int) -> DataFrame:
    """The inverse of distorted, but for cells that it moved off the page."""
    return geometry.warp(ink, -geometry.displacement(kind, F.col("x"), width, KINDS[kind] * height), height)
