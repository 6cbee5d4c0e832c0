"""Voting for straight text lines, line fitting and merging."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.numeric import by, half_even


def votes(points: DataFrame, thetas: list[float], step: float, low: Column) -> DataFrame:
    """points(page_id, point_id, x, y): (page_id, rho, theta, n, first) of the cells with votes;
    rho is the bin's number from `low`, first the smallest point in it. Each point meets each
    angle once; cells are summed on the map side."""
    angles = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(math.cos(math.radians(t))).alias("c"), F.lit(math.sin(math.radians(t))).alias("s")) for i, t in enumerate(thetas)])).alias("a")
    rho = half_even((F.col("x") * F.col("a.c") + F.col("y") * F.col("a.s") - low) / step)
    return points.select("page_id", "point_id", "x", "y", angles).groupBy("page_id", rho.alias("rho"), F.col("a.i").alias("theta")).agg(F.count("*").alias("n"), F.min("point_id").alias("first"))


def peak(cells: DataFrame) -> DataFrame:
    """The cell with most votes of a page; on a tie the one that was first to get a vote."""
    best = F.max_by(F.struct("rho", "theta", "n"), F.struct(F.col("n"), -F.col("first"), -F.col("theta"))).alias("b")
    return cells.groupBy("page_id").agg(best).select("page_id", "b.rho", "b.theta", "b.n")


def y_on_line(rho: Column, theta: Column, x: Column) -> Column:
    """theta in radians; 0 for a vertical line."""
    return F.when(F.abs(F.sin(theta)) < 1e-6, 0.0).otherwise((rho - x * F.cos(theta)) / F.sin(theta))


def _lines(points: np.ndarray, comp: np.ndarray, sizes: dict, thetas: np.ndarray, step: float, low: float, least: int, second: int, skew: float, fraction: float, radius: int) -> list:
    """One page: take the best cell while it has `least` votes; below `second` votes only within
    `skew` degrees of the lines found so far. A component joins a line if the given part of its
    points voted for the cell or its neighbours, and its points leave."""
    found, left = [], np.ones(len(points), bool)
    c, s = np.cos(np.radians(thetas)), np.sin(np.radians(thetas))
    bins = np.rint((points[:, :1] * c + points[:, 1:] * s - low) / step).astype(int)
    while left.sum() >= least:
        at = np.flatnonzero(left)
        keys, first, n = np.unique(bins[at] * len(thetas) + np.arange(len(thetas)), return_index=True, return_counts=True)
        k = min(range(len(keys)), key=lambda i: (-n[i], first[i]))
        if n[k] < least:
            break
        rho, t = divmod(int(keys[k]), len(thetas))
        usual = np.mean([f[1] for f in found]) if found else thetas[t]
        voted = left & (np.abs(bins[:, t] - rho) <= radius)
        ids, count = np.unique(comp[voted], return_counts=True)
        joined = [int(i) for i, m in zip(ids, count) if m >= fraction * sizes[i]]
        if n[k] < second and abs(thetas[t] - usual) > skew or not joined:
            left &= ~voted
            continue
        found.append((low + rho * step, float(thetas[t]), joined))
        left &= ~np.isin(comp, joined)
    return found


def text_lines(points: DataFrame, width: float, height: float, step: float, thetas: tuple = tuple(range(85, 96)), least: int = 5, second: int = 9, skew: float = 2.0, fraction: float = 0.5, radius: int = 5) -> DataFrame:
    """points(page_id, point_id, comp_id, x, y): (page_id, line_id, rho, theta, comp_ids). Taking
    peaks is sequential by nature, so a page's block centres meet in one task."""
    low = -math.hypot(width, height)

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("point_id", ignore_index=True)
        sizes = page.groupby("comp_id").size().to_dict()
        found = _lines(page[["x", "y"]].to_numpy(float), page["comp_id"].to_numpy(), sizes, np.array(thetas, float), step, low, least, second, skew, fraction, radius)
        return pd.DataFrame([(page["page_id"][0], i, r, t, c) for i, (r, t, c) in enumerate(found)], columns=["page_id", "line_id", "rho", "theta", "comp_ids"])

    typed = points.select(F.col("page_id").cast("bigint"), F.col("point_id").cast("bigint"), F.col("comp_id").cast("bigint"), F.col("x").cast("double"), F.col("y").cast("double"))
    return typed.groupBy("page_id").applyInPandas(run, "page_id bigint, line_id int, rho double, theta double, comp_ids array<bigint>")


def nearest_line(points: DataFrame, lines: DataFrame) -> DataFrame:
    """points(page_id, comp_id, x, y), lines(page_id, line_id, rho, theta): the line whose height
    at x is nearest, first line on a tie. A page's lines come to its points as one list."""
    lists = lines.groupBy("page_id").agg(F.collect_list(F.struct("line_id", "rho", "theta")).alias("lines"))
    away = F.transform("lines", lambda k: F.struct(F.abs(F.col("y") - y_on_line(k["rho"], F.radians(k["theta"]), F.col("x"))).alias("d"), k["line_id"].alias("line_id")))
    return points.join(lists, "page_id").withColumn("m", F.array_min(away)).select("page_id", "comp_id", F.col("m.line_id").alias("line_id"), F.col("m.d").alias("distance"))


def merge_lines(lines: DataFrame, factor: float = 1.0) -> DataFrame:
    """lines(page_id, line_id, y_mid): neighbours nearer than factor times the page's mean gap
    become one group, named by its first line."""
    order = by("page_id").orderBy("y_mid", "line_id")
    gaps = lines.withColumn("gap", F.col("y_mid") - F.lag("y_mid").over(order))
    marked = gaps.withColumn("new", F.when(F.col("gap") < factor * F.avg("gap").over(by("page_id")), 0).otherwise(1))
    grouped = marked.withColumn("group", F.sum("new").over(order))
    return grouped.groupBy("page_id", "group").agg(F.min_by("line_id", F.struct("y_mid", "line_id")).alias("line_id"), F.count("*").alias("n"), F.min("y_mid").alias("y0"), F.max("y_mid").alias("y1")).drop("group")


def drop_skewed(lines: DataFrame, most: float) -> DataFrame:
    """Without lines whose angle is off the page's median by more than `most`; a page's only line
    stays."""
    page = by("page_id")
    sized = lines.withColumns({"m": F.median("theta").over(page), "k": F.count("*").over(page)})
    return sized.where((F.col("k") <= 1) | (F.abs(F.col("theta") - F.col("m")) <= most)).drop("m", "k")


def fitted(points: DataFrame, *keys: str) -> DataFrame:
    """Least-squares line through each point set, in polar form (theta in degrees, 0 to 180)."""
    fit = points.groupBy(*keys).agg(F.regr_slope("y", "x").alias("m"), F.regr_intercept("y", "x").alias("b")).where("m is not null")
    theta = F.degrees(F.atan2(F.lit(1.0), -F.col("m")))
    return fit.select(*keys, (F.col("b") / F.sqrt(1 + F.col("m") * F.col("m"))).alias("rho"), theta.alias("theta"))


def reference_angle(lines: DataFrame) -> DataFrame:
    return lines.groupBy("page_id").agg(F.coalesce(F.median("theta"), F.lit(90.0)).alias("theta"))


def chain_groups(rows: DataFrame, value: str, most: float, *keys: str) -> DataFrame:
    """Rows in order of value; a step above `most` starts a new group."""
    order = Window.partitionBy(*keys).orderBy(value)
    new = F.when(F.col(value) - F.lag(value).over(order) <= most, 0).otherwise(1)
    return rows.withColumn("new", new).withColumn("group", F.sum("new").over(order)).drop("new")


def anchored_groups(lines: DataFrame, most: Column) -> DataFrame:
    """lines(page_id, line_id, y_mid): a line nearer than `most` (a column by page) to the first
    line of the current group joins it; else it opens a group. Later lines are compared with the
    group's first line, not the one before, so this is a fold over the page's sorted lines."""
    lists = lines.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("y_mid", "line_id"))).alias("ls"), F.first(most).alias("most"))
    empty = F.array().cast("array<struct<line_id:bigint,first:double,n:int>>")

    def step(done, line):
        last = F.try_element_at(done, F.lit(-1))
        joins = (F.size(done) > 0) & (line["y_mid"] - last["first"] < F.col("most"))
        grown = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["line_id"].alias("line_id"), last["first"].alias("first"), (last["n"] + 1).alias("n"))))
        opened = F.concat(done, F.array(F.struct(line["line_id"].cast("bigint").alias("line_id"), line["y_mid"].cast("double").alias("first"), F.lit(1).alias("n"))))
        return F.when(joins, grown).otherwise(opened)

    return lists.select("page_id", F.inline(F.aggregate("ls", empty, step)))


def mean_groups(rows: DataFrame, most: float) -> DataFrame:
    """rows(page_id, comp_id, y): in order of y, a row within `most` of the running mean of the
    current group joins it. (page_id, group, mean, comp_ids)."""
    lists = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(F.col("y").cast("double").alias("y"), F.col("comp_id").cast("bigint").alias("comp_id")))).alias("rs"))
    empty = F.array().cast("array<struct<total:double,comp_ids:array<bigint>>>")

    def step(done, r):
        last = F.try_element_at(done, F.lit(-1))
        joins = (F.size(done) > 0) & (F.abs(r["y"] - last["total"] / F.size(last["comp_ids"])) <= most)
        grown = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct((last["total"] + r["y"]).alias("total"), F.concat(last["comp_ids"], F.array(r["comp_id"])).alias("comp_ids"))))
        return F.when(joins, grown).otherwise(F.concat(done, F.array(F.struct(r["y"].alias("total"), F.array(r["comp_id"]).alias("comp_ids")))))

    found = lists.select("page_id", F.posexplode(F.aggregate("rs", empty, step)).alias("group", "g"))
    return found.select("page_id", "group", (F.col("g.total") / F.size("g.comp_ids")).alias("mean"), F.col("g.comp_ids").alias("comp_ids"))
