"""Connected components and what is derived from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.numeric import by


def label_runs(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """8-connected labels of horizontal runs (sorted by y, x0), numbered from 1 in that order."""
    parent = list(range(len(y)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above = here = 0
    for i in range(len(y)):
        if i and y[i] != y[i - 1]:
            above, here = (here, i) if y[i] == y[i - 1] + 1 else (i, i)
        j = above
        while j < here and x0[j] <= x1[i] + 1:
            if x1[j] >= x0[i] - 1:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
            j += 1
    roots = [find(i) for i in range(len(y))]
    number = {r: k + 1 for k, r in enumerate(dict.fromkeys(roots))}
    return np.array([number[r] for r in roots], np.int64)


def components(ink: DataFrame, least: int = 1) -> DataFrame:
    """ink(page_id, y, x): (page_id, comp_id, x, y, w, h, area, cx, cy). Cells become runs
    natively; a page's runs meet in one task, which labels them in order of the raster."""
    runs = _runs(ink)
    labelled = runs.groupBy("page_id").applyInPandas(_label, "page_id bigint, comp_id bigint, y int, x0 int, x1 int")
    n = F.col("x1") - F.col("x0") + 1
    area = F.sum(n)
    out = labelled.groupBy("page_id", "comp_id").agg(
        F.min("x0").alias("x"), F.min("y").alias("y"), (F.max("x1") - F.min("x0") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"),
        area.alias("area"), (F.sum(n * (F.col("x0") + F.col("x1")) / 2) / area).alias("cx"), (F.sum(n * F.col("y")) / area).alias("cy"),
    )
    return out.where(F.col("area") >= least)


def _runs(ink: DataFrame) -> DataFrame:
    order = Window.partitionBy("page_id", "y").orderBy("x")
    return ink.withColumn("r", F.col("x") - F.row_number().over(order)).groupBy("page_id", "y", "r").agg(F.min("x").cast("int").alias("x0"), F.max("x").cast("int").alias("x1")).select(F.col("page_id").cast("bigint").alias("page_id"), F.col("y").cast("int").alias("y"), "x0", "x1")


def _label(page: pd.DataFrame) -> pd.DataFrame:
    page = page.sort_values(["y", "x0"], ignore_index=True)
    page.insert(1, "comp_id", label_runs(*(page[c].to_numpy() for c in ("y", "x0", "x1"))))
    return page[["page_id", "comp_id", "y", "x0", "x1"]]


def component_cells(ink: DataFrame) -> DataFrame:
    """(page_id, comp_id, y, x) of every ink cell."""
    labelled = _runs(ink).groupBy("page_id").applyInPandas(_label, "page_id bigint, comp_id bigint, y int, x0 int, x1 int")
    return labelled.select("page_id", "comp_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def character_height(found: DataFrame) -> DataFrame:
    """The most frequent component height of a page, the smallest of several."""
    return found.groupBy("page_id").agg(F.mode("h", True).alias("ah"))


def character_height_mean(found: DataFrame) -> DataFrame:
    """Mean height without the smallest height, where there are several."""
    low, high = F.min("h").over(by("page_id")), F.max("h").over(by("page_id"))
    return found.withColumns({"low": low, "high": high}).where((F.col("h") > F.col("low")) | (F.col("low") == F.col("high"))).groupBy("page_id").agg(F.avg("h").alias("ah"))


def subset(w: Column, h: Column, ah: Column, aw: Column) -> Column:
    """1: usual characters and words; 2: large ones that may join lines; 3: small marks."""
    usual = (h >= 0.5 * ah) & (h < 3 * ah) & (w >= 0.5 * aw)
    large = h >= 3 * ah
    small = ((h < 3 * ah) & (w < 0.5 * aw)) | ((h < 0.5 * ah) & (w >= 0.5 * aw))
    return F.when(usual, 1).when(large, 2).when(small, 3)


def block_centres(cells: DataFrame, width: Column) -> DataFrame:
    """cells(page_id, comp_id, y, x): mean place of the ink in each block of `width` columns of a
    component; the last block may be narrower."""
    left = F.min("x").over(by("page_id", "comp_id"))
    block = F.floor((F.col("x") - left) / width).cast("int")
    return cells.withColumn("block", block).groupBy("page_id", "comp_id", "block").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n"))


def _within(mine: DataFrame, theirs: DataFrame, reach: float) -> DataFrame:
    """mine(page_id, id, cx, cy), theirs(page_id, other, ox, oy): the nearest other within `reach`.
    Points meet in the 3x3 grid squares around them, each of the side of the reach."""
    square = lambda c: F.floor(F.col(c) / reach)
    around = F.explode(F.array(*[F.struct((square("cx") + dx).alias("gx"), (square("cy") + dy).alias("gy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    near = mine.select("page_id", "id", "cx", "cy", around.alias("g")).select("page_id", "id", "cx", "cy", "g.gx", "g.gy")
    there = theirs.select("*", square("ox").alias("gx"), square("oy").alias("gy"))
    return _least(near.join(there, ["page_id", "gx", "gy"])).where(F.col("distance") <= reach)


def _least(pairs: DataFrame) -> DataFrame:
    d = F.sqrt(F.pow(F.col("cx") - F.col("ox"), F.lit(2.0)) + F.pow(F.col("cy") - F.col("oy"), F.lit(2.0)))
    pairs = pairs.where(F.col("id") != F.col("other")).withColumn("d", d)
    return pairs.groupBy("page_id", "id").agg(F.min(F.struct("d", "other")).alias("m")).select("page_id", "id", F.col("m.other").alias("other"), F.col("m.d").alias("distance"))


def nearest_of(mine: DataFrame, theirs: DataFrame, reach: float) -> DataFrame:
    """mine(page_id, id, cx, cy), theirs(page_id, other, ox, oy): (page_id, id, other, distance) of
    the nearest other of the page, of another id, however far; the first other on a tie. `reach` is
    where most are expected: those without a neighbour there look in squares of eight times the
    side, and the few still alone among all of their page."""
    first = _within(mine, theirs, reach)
    left = mine.join(first, ["page_id", "id"], "left_anti")
    second = _within(left, theirs, 8 * reach)
    alone = left.join(second, ["page_id", "id"], "left_anti")
    return first.unionAll(second).unionAll(_least(alone.join(theirs, "page_id")))


def nearest(points: DataFrame, reach: float) -> DataFrame:
    """points(page_id, comp_id, cx, cy): (page_id, comp_id, other, distance) of each point's nearest
    other one; a page's only point has none."""
    found = nearest_of(points.select("page_id", F.col("comp_id").alias("id"), "cx", "cy"), points.select("page_id", F.col("comp_id").alias("other"), F.col("cx").alias("ox"), F.col("cy").alias("oy")), reach)
    return found.withColumnRenamed("id", "comp_id")


def nearest_places(page: np.ndarray, ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, other, distance) of the points that have a neighbour: the nearest of their page with
    another id, the least id on a tie; of points that share page and id, the nearest only.

    Points are sorted into rows of one y. In a row only the next ones on both sides count, and rows
    are looked at from the own one outwards for as long as they are no farther than what is found."""
    n = len(x)
    order = np.lexsort((ids, x, y, page))
    page, ids, x, y = (a[order] for a in (page, ids, x, y))
    new = np.ones(n, bool)
    new[1:] = (page[1:] != page[:-1]) | (y[1:] != y[:-1])
    low = np.flatnonzero(new)
    high = np.append(low[1:], n)
    row = np.cumsum(new) - 1
    new[1:] |= x[1:] != x[:-1]
    same = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # the first point of the same place
    found, other = np.full(n, np.inf), np.full(n, -1)

    def take(me: np.ndarray, it: np.ndarray) -> None:
        d = np.sqrt((x[me] - x[it]) ** 2 + (y[me] - y[it]) ** 2)
        least = (d < found[me]) | ((d == found[me]) & (other[me] >= 0) & (ids[it] < ids[other[me]]))
        found[me[least]], other[me[least]] = d[least], it[least]

    def both_sides(me: np.ndarray, it: np.ndarray, r: np.ndarray) -> None:
        """it: the first point of row r that isn't left of me, or any of the same place."""
        right, left, lo, hi = it.copy(), it - 1, low[r], high[r]
        while len(own := np.flatnonzero((right < hi) & (ids[np.minimum(right, n - 1)] == ids[me]))):
            right[own] += 1
        while len(own := np.flatnonzero((left >= lo) & (ids[np.maximum(left, 0)] == ids[me]))):
            left[own] -= 1
        there = right < hi
        take(me[there], right[there])
        there = left >= lo
        me, left = me[there], same[left[there]]
        while len(own := np.flatnonzero(ids[left] == ids[me])):
            left[own] += 1
        take(me, left)

    def place(me: np.ndarray, r: np.ndarray) -> np.ndarray:
        lo, hi = low[r], high[r]
        while len(open_ := np.flatnonzero(lo < hi)):
            middle = (lo[open_] + hi[open_]) // 2
            less = x[middle] < x[me[open_]]
            lo[open_[less]], hi[open_[~less]] = middle[less] + 1, middle[~less]
        return lo

    every = np.arange(n)
    both_sides(every, every, row)
    up = down = every
    step = 0
    while len(up) or len(down):
        step += 1
        sides = []
        for me, r in ((up, row[up] - step), (down, row[down] + step)):
            inside = (r >= 0) & (r < len(low))
            me, r = me[inside], r[inside]
            near = (page[low[r]] == page[me]) & (np.abs(y[low[r]] - y[me]) <= found[me])
            me, r = me[near], r[near]
            both_sides(me, place(me, r), r)
            sides.append(me)
        up, down = sides
    has = np.flatnonzero(other >= 0)
    by_id = has[np.lexsort((ids[has], page[has]))]
    if ((page[by_id][1:] == page[by_id][:-1]) & (ids[by_id][1:] == ids[by_id][:-1])).any():
        by_id = has[np.lexsort((ids[other[has]], found[has], ids[has], page[has]))]
        one = np.ones(len(by_id), bool)
        one[1:] = (page[by_id][1:] != page[by_id][:-1]) | (ids[by_id][1:] != ids[by_id][:-1])
        has = by_id[one]
    return order[has], ids[other[has]], found[has]


def nearest_in_rows(pages: DataFrame, points: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]) -> DataFrame:
    """The same as `nearest` where a row of `pages` holds a whole page, so that nothing is shuffled:
    (page_id, comp_id, other, distance). points(batches) yields (page_id, row, comp_id, cx, cy):
    the ids of some pages, and by point the number of its page among them, its id and place."""

    def run(batches):
        for page_id, row, ids, cx, cy in points(batches):
            place, other, distance = nearest_places(row, ids, cx, cy)
            for i in range(0, len(place), 100_000):
                p = place[i : i + 100_000]
                columns = (page_id[row[p]], ids[p], other[i : i + 100_000], distance[i : i + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["page_id", "comp_id", "other", "distance"])

    return pages.mapInArrow(run, "page_id bigint, comp_id bigint, other bigint, distance double")


def between_class_threshold(values: DataFrame, value: str = "distance") -> DataFrame:
    """By page: the value t that parts the values into <= t and > t with the greatest between-
    class variance, the first on a tie; the median where one class would be empty. Running sums
    over distinct values, so one pass by page; the median comes of them too, and the values are
    made once."""
    sums = values.groupBy("page_id", F.col(value).alias("t")).agg(F.count("*").alias("n"))
    order = by("page_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    page = by("page_id")
    rows = sums.withColumns({"n1": F.sum("n").over(order), "s1": F.sum(F.col("n") * F.col("t")).over(order), "all": F.sum("n").over(page), "s": F.sum(F.col("n") * F.col("t")).over(page)})
    n2 = F.col("all") - F.col("n1")
    mean = F.col("s1") / F.col("n1") - (F.col("s") - F.col("s1")) / F.nullif(n2, F.lit(0))
    score = F.round(F.col("n1") / F.col("all") * n2 / F.col("all") * mean * mean, 9)
    best = F.min_by("t", F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("a"), "t")))
    return rows.withColumn("score", score).groupBy("page_id").agg(F.coalesce(best, F.percentile("t", F.lit(0.5), F.col("n"))).alias("threshold"))


def otsu(cells: DataFrame, value: str, levels: int = 256) -> DataFrame:
    """cells(page_id, ...): the level up to which values are dark, by the same rule, over whole
    levels."""
    binned = cells.withColumn("distance", F.least(F.lit(levels - 1), F.greatest(F.lit(0), F.floor(F.col(value)))).cast("double"))
    return between_class_threshold(binned)




def _binned(found: DataFrame) -> DataFrame:
    """(page_id, ah): heights in a tenth as many even bins as there are, without the first bin: the
    centre of the fullest, the first on a tie. Pages of one bin or one height don't appear."""
    page = by("page_id")
    sized = found.withColumns({"n": F.count("*").over(page), "a": F.min("h").over(page), "b": F.max("h").over(page)})
    bins = F.floor(F.col("n") / 10)
    width = (F.col("b") - F.col("a")) / bins
    number = F.least(bins - 1, F.floor((F.col("h") - F.col("a")) / width)).cast("int")
    even = (bins >= 2) & (F.col("b") > F.col("a"))
    counted = sized.where(even).withColumns({"k": number, "w": width}).where("k > 0").groupBy("page_id", "k", "a", "w").agg(F.count("*").alias("c"))
    return counted.groupBy("page_id").agg(F.max_by(F.col("a") + (F.col("k") + 0.5) * F.col("w"), F.struct(F.col("c"), -F.col("k"))).alias("ah"))


def character_height_bins(found: DataFrame, least: int = 4) -> DataFrame:
    """The height at the fullest bin of heights above `least`; where these fill one bin only, of all
    heights. Pages of under 20 components (the rule has no second bin there) or of one height have
    the mean of all heights."""
    high, every = _binned(found.where(F.col("h") > least)), _binned(found).withColumnRenamed("ah", "every")
    mean = found.groupBy("page_id").agg(F.avg("h").alias("mean"))
    return mean.join(high, "page_id", "left").join(every, "page_id", "left").select("page_id", F.coalesce("ah", "every", "mean").alias("ah"))


def without_small(cells: DataFrame, least: int) -> DataFrame:
    """cells(page_id, comp_id, ...) of components of `least` cells or more."""
    return cells.withColumn("__n", F.count("*").over(by("page_id", "comp_id"))).where(F.col("__n") >= least).drop("__n")
