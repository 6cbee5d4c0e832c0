"""Projection profiles, regions of text rows, and one-dimensional morphology.

All work on rows (page_id, y, value) with windows over a page; a page is the unit of parallelism
and nothing crosses pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.numeric import by, half_even


def by_page():
    return by("page_id")


def by_row():
    return by("page_id").orderBy("y")


def minmax(profile: DataFrame, value: str = "hpp", out: str = "norm") -> DataFrame:
    """To [0, 1] by page; a constant profile is all zero."""
    low, high = F.min(value).over(by_page()), F.max(value).over(by_page())
    return profile.withColumn(out, F.when(high - low > 1e-9, (F.col(value) - low) / (high - low)).otherwise(0.0))


def zscore(profile: DataFrame, value: str = "hpp", out: str = "z") -> DataFrame:
    """Mean 0 and population deviation 1 by page; a constant profile is all zero."""
    mean, std = F.avg(value).over(by_page()), F.stddev_pop(value).over(by_page())
    return profile.withColumn(out, F.when(std > 1e-9, (F.col(value) - mean) / std).otherwise(0.0))


def regions(profile: DataFrame, inside: Column, least: int = 1) -> DataFrame:
    """(page_id, y0, y1): maximal runs of rows where `inside` holds, of `least` rows or more."""
    runs = profile.where(inside).withColumn("run", F.col("y") - F.row_number().over(by_row()))
    found = runs.groupBy("page_id", "run").agg(F.min("y").alias("y0"), F.max("y").alias("y1"))
    return found.where(F.col("y1") - F.col("y0") + 1 >= least).drop("run")


def merge_regions(found: DataFrame, gap: int) -> DataFrame:
    """Regions whose blank gap to the ones before is `gap` rows or fewer become one."""
    order = by_page().orderBy("y0", "y1")
    reach = F.max("y1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    grouped = found.withColumn("new", F.when(F.col("y0") - reach - 1 <= gap, 0).otherwise(1)).withColumn("group", F.sum("new").over(order))
    return grouped.groupBy("page_id", "group").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1")).drop("group")


def drop_thin(found: DataFrame, part: float = 3.0) -> DataFrame:
    """Without regions thinner than a part of the page's mean; a page's only region stays."""
    height = F.col("y1") - F.col("y0") + 1
    sized = found.withColumns({"mean": F.avg(height).over(by_page()), "n": F.count("*").over(by_page())})
    return sized.where((F.col("n") <= 1) | (height >= F.col("mean") / part)).drop("mean", "n")


def shrink(found: DataFrame, share: float = 0.5) -> DataFrame:
    """The central share of each region, one row at least."""
    height = F.col("y1") - F.col("y0") + 1
    kept = F.greatest(F.lit(1), half_even(height * share))
    start = F.col("y0") + F.floor((height - kept) / 2).cast("int")
    return found.select("page_id", start.alias("y0"), (start + kept - 1).alias("y1"))


def seam_starts(found: DataFrame, floor: bool = False) -> DataFrame:
    """(page_id, seam_id, y): the row midway between a region and the one before, halves to even,
    or with `floor` down."""
    order = by_page().orderBy("y0")
    between = found.withColumn("before", F.lag("y1").over(order)).where("before is not null")
    return between.select("page_id", F.row_number().over(order).alias("seam_id"), (F.floor((F.col("y0") + F.col("before")) / 2).cast("int") if floor else half_even((F.col("y0") + F.col("before")) / 2)).alias("y"))


def word_spans(columns: DataFrame, gap: int = 6, least: int = 3) -> DataFrame:
    """columns(page_id, line, x), or runs of ink columns (page_id, line, x0, x1), to word spans; a
    word ends where more than `gap` columns are empty, and is `least` columns wide or more."""
    runs = columns if "x0" in columns.columns else columns.select("page_id", "line", F.col("x").alias("x0"), F.col("x").alias("x1"))
    order = Window.partitionBy("page_id", "line").orderBy("x0")
    new = F.when(F.col("x0") - F.lag("x1").over(order) - 1 <= gap, 0).otherwise(1)
    words = runs.withColumn("new", new).withColumn("word", F.sum("new").over(order))
    spans = words.groupBy("page_id", "line", "word").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    return spans.where(F.col("x1") - F.col("x0") + 1 >= least)


def _around(k: int):
    return by_row().rowsBetween(-(k // 2), k // 2)


def close_open(profile: DataFrame, value: str, k: int, out: str = "smooth") -> DataFrame:
    """Closing then opening with a centred window of k rows; rows beyond the page don't count."""
    steps = (("__a", value, F.max), ("__b", "__a", F.min), ("__c", "__b", F.min), (out, "__c", F.max))
    for name, of, f in steps:
        profile = profile.withColumn(name, f(of).over(_around(k)))
    return profile.drop("__a", "__b", "__c")


def quantised(profile: DataFrame, value: str = "hpp", out: str = "q") -> DataFrame:
    """The min-max profile in steps of 1/255."""
    return minmax(profile, value, "__n").withColumn(out, F.floor(F.col("__n") * 255).cast("int")).drop("__n")


def plateaus(profile: DataFrame, value: str = "q", rise: int = 13) -> DataFrame:
    """(page_id, y0, y1, level): runs of one level above both neighbours, and above the foot of
    the slope on either side by `rise` or more. Feet are found over the list of runs, which is
    one row per page."""
    new = F.when(F.col(value) == F.lag(value).over(by_row()), 0).otherwise(1)
    runs = profile.withColumn("new", new).withColumn("run", F.sum("new").over(by_row()))
    runs = runs.groupBy("page_id", "run").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.first(value).alias("level"))
    order = by_page().orderBy("run")
    # a foot is the last run before which the level doesn't go on falling
    runs = runs.withColumns({"prev": F.lag("level").over(order), "next": F.lead("level").over(order)})
    left = F.last(F.when(F.col("prev").isNull() | (F.col("prev") > F.col("level")), F.col("level")), True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(F.when(F.col("next").isNull() | (F.col("next") > F.col("level")), F.col("level")), True).over(order.rowsBetween(0, Window.unboundedFollowing))
    runs = runs.withColumns({"left": left, "right": right})
    peak = (F.col("level") > 0) & (F.col("prev") < F.col("level")) & (F.col("next") < F.col("level"))
    return runs.where(peak & (F.least(F.col("level") - F.col("left"), F.col("level") - F.col("right")) >= rise)).select("page_id", "y0", "y1", "level")


def two_kernels(profile: DataFrame, k1: int, k2: int, value: str = "hpp") -> DataFrame:
    """Plateaus of the profile smoothed by either kernel: for each page those of the kernel with
    more of them, the first on a tie."""
    base = quantised(profile, value)
    both = None
    for i, k in enumerate((k1, k2)):
        found = plateaus(close_open(base, "q", k, "s"), "s").withColumn("kernel", F.lit(i))
        both = found if both is None else both.unionAll(found)
    counted = both.withColumn("n", F.count("*").over(Window.partitionBy("page_id", "kernel")))
    best = F.max(F.struct("n", (-F.col("kernel")).alias("k"))).over(by_page())
    return counted.withColumn("best", -best["k"]).where("kernel = best").select("page_id", "kernel", "y0", "y1", "level")


def box_smoothed(profile: DataFrame, k: int, value: str = "hpp", out: str = "smooth") -> DataFrame:
    """Moving sum over k rows divided by k: rows beyond the page count as zero."""
    return profile.withColumn(out, F.sum(value).over(_around(k)) / k)
