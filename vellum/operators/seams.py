"""Energy, minimum-energy seams between text lines, and the classes that they part."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.numeric import by


def energy(cells: DataFrame, ink_weight: float = 10.0, edge_weight: float = 0.5) -> DataFrame:
    """cells(page_id, y, x, v), every cell of a page once, v from 0 (ink) to 255: ink_weight *
    (255 - v) + edge_weight * the length of the 3x3 Sobel gradient; beyond the border the picture
    is mirrored around its border cells."""
    row, col = Window.partitionBy("page_id", "y").orderBy("x"), Window.partitionBy("page_id", "x").orderBy("y")

    def near(c, window, step):
        there, back = (F.lag if step < 0 else F.lead)(c, 1).over(window), (F.lead if step < 0 else F.lag)(c, 1).over(window)
        return F.coalesce(there, back, F.col(c))

    d = cells.withColumns({"__sx": near("v", row, 1) - near("v", row, -1), "__mx": near("v", row, -1) + 2 * F.col("v") + near("v", row, 1)})
    gx = near("__sx", col, -1) + 2 * F.col("__sx") + near("__sx", col, 1)
    gy = near("__mx", col, 1) - near("__mx", col, -1)
    d = d.withColumns({"__gx": gx, "__gy": gy})
    return d.withColumn("energy", ink_weight * (255 - F.col("v")) + edge_weight * F.sqrt(F.col("__gx") * F.col("__gx") + F.col("__gy") * F.col("__gy"))).drop("__sx", "__mx", "__gx", "__gy")


def column_arrays(cells: DataFrame, value: str = "energy") -> DataFrame:
    """(page_id, columns): the values as an array of columns, left to right, each top to bottom."""
    columns = cells.groupBy("page_id", "x").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", value))), lambda c: c[value]).alias("c"))
    return columns.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "c"))), lambda c: c["c"]).alias("columns"))


def least_paths(pages: DataFrame, columns: str = "columns") -> DataFrame:
    """The cost of the cheapest path from the left end to each cell of the last column, moving at
    most one row per column: a fold over the columns."""

    def step(done, column):
        return F.zip_with(
            column,
            F.transform(done, lambda d, i: F.least(d, F.when(i > 0, F.get(done, i - 1)), F.get(done, i + 1))),
            lambda e, d: e + d,
        )

    first = F.element_at(columns, 1)
    return pages.withColumn("costs", F.aggregate(F.slice(columns, 2, F.greatest(F.size(columns) - 1, F.lit(0))), first, step))


def _trace(energy_: np.ndarray, start: int) -> list[int]:
    """From the start row rightwards, each step to the cheapest rest; straight, up, down on ties."""
    rest = energy_.copy()
    for x in range(rest.shape[1] - 2, -1, -1):
        after = np.pad(rest[:, x + 1], 1, constant_values=np.inf)
        rest[:, x] += np.minimum(np.minimum(after[:-2], after[2:]), after[1:-1])
    y, out = start, [start]
    for x in range(1, rest.shape[1]):
        steps = [q for q in (y, y - 1, y + 1) if 0 <= q < len(rest)]
        y = min(steps, key=lambda q: rest[q, x])
        out.append(y)
    return out


def _search(energy_: np.ndarray, blocked: np.ndarray, start: int, drift: float) -> list[int]:
    """The cheapest path from the left to the right border around blocked cells, from the free row
    nearest to the start; empty if there is none. Costs aren't negative, so this is Dijkstra's
    order, which is exact for every energy."""
    height, width = energy_.shape
    free = np.flatnonzero(~blocked[:, 0])
    if not len(free):
        return []
    y = int(free[np.argmin(np.abs(free - start))])
    queue, done, before = [(float(energy_[y, 0]), 0, y)], set(), {}
    best = {(0, y): float(energy_[y, 0])}
    while queue:
        cost, x, y = heapq.heappop(queue)
        if (x, y) in done:
            continue
        done.add((x, y))
        if x == width - 1:
            path = [y]
            while (x, y) in before:
                x, y = before[(x, y)]
                path.append(y)
            return path[::-1]
        for q in (y, y - 1, y + 1):
            if 0 <= q < height and not blocked[q, x + 1]:
                c = cost + float(energy_[q, x + 1]) + drift * abs(q - y)
                if c < best.get((x + 1, q), np.inf):
                    best[(x + 1, q)] = c
                    before[(x + 1, q)] = (x, y)
                    heapq.heappush(queue, (c, x + 1, q))
    return []


def _grids(cells: DataFrame, starts: DataFrame) -> DataFrame:
    """(page_id, columns, blocked, starts): all a page's seams need, in one row."""
    grid = column_arrays(cells)
    walls = column_arrays(cells, "blocked").withColumnRenamed("columns", "blocked") if "blocked" in cells.columns else None
    seeds = starts.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("seam_id", "y"))).alias("starts"))
    both = grid.join(seeds, "page_id")
    return both.join(walls, "page_id") if walls is not None else both.withColumn("blocked", F.lit(None).cast("array<array<boolean>>"))


def seams(cells: DataFrame, starts: DataFrame, search: bool = False, drift: float = 0.0) -> DataFrame:
    """cells(page_id, y, x, energy[, blocked]), starts(page_id, seam_id, y): (page_id, seam_id, x,
    y) of each seam. `search` goes around blocked cells and drops seams that can't; else the
    cheapest rest is followed. Pages are rows, so a task holds one batch of pages."""

    def run(batches):
        for batch in batches:
            out = []
            for page in batch.itertuples(index=False):
                grid = np.stack([np.asarray(c, float) for c in page.columns], axis=1)
                walls = np.stack([np.asarray(c, bool) for c in page.blocked], axis=1) if page.blocked is not None else np.zeros(grid.shape, bool)
                for s in page.starts:
                    path = _search(grid, walls, s["y"], drift) if search else _trace(grid, s["y"])
                    out += [(page.page_id, s["seam_id"], x, y) for x, y in enumerate(path)]
            yield pd.DataFrame(out, columns=["page_id", "seam_id", "x", "y"])

    rows = _grids(cells, starts).withColumnRenamed("columns", "columns")
    return rows.mapInPandas(run, "page_id bigint, seam_id int, x int, y int")


def classes(ink: DataFrame, found: DataFrame) -> DataFrame:
    """ink(page_id, y, x), found(page_id, seam_id, x, y): class_id = 1 + the seams above the cell
    in its column. Cells on a seam belong to the class above it."""
    columns = found.groupBy("page_id", "x").agg(F.collect_list("y").alias("ys"))
    above = F.size(F.filter("ys", lambda s: s < F.col("y")))
    return ink.join(columns, ["page_id", "x"], "left").withColumn("class_id", F.when(F.col("ys").isNull(), 1).otherwise(1 + above)).drop("ys")


def consecutive(cells: DataFrame) -> DataFrame:
    """cells(page_id, ..., class_id) with classes numbered on without gaps: an empty band is no line."""
    order = Window.partitionBy("page_id").orderBy("class_id")
    numbers = cells.select("page_id", "class_id").distinct().withColumn("number", F.row_number().over(order))
    return cells.join(numbers, ["page_id", "class_id"]).withColumn("class_id", F.col("number")).drop("number")


def between(ink: DataFrame, found: DataFrame) -> DataFrame:
    """As classes, but cells on a seam go with no line."""
    columns = found.groupBy("page_id", "x").agg(F.collect_list("y").alias("ys"))
    rows = ink.join(columns, ["page_id", "x"], "left").where("ys is null or not array_contains(ys, y)")
    above = F.size(F.filter("ys", lambda s: s < F.col("y")))
    return rows.withColumn("class_id", F.when(F.col("ys").isNull(), 1).otherwise(1 + above)).drop("ys")


def blocked_rows(cells: DataFrame, regions: DataFrame, above: int = 2, below: int = 2) -> DataFrame:
    """cells with `blocked`: inside a region (page_id, y0, y1), widened by the margins."""
    found = regions.groupBy("page_id").agg(F.collect_list(F.struct("y0", "y1")).alias("regions"))
    inside = F.exists("regions", lambda r: F.col("y").between(r["y0"] - above, r["y1"] + below))
    return cells.join(found, "page_id", "left").withColumn("blocked", F.coalesce(inside, F.lit(False))).drop("regions")


def bands(found: DataFrame, height: int) -> DataFrame:
    """(page_id, band, y0, y1): the rows between the median rows of neighbouring seams."""
    medians = found.groupBy("page_id", "seam_id").agg(F.floor(F.median("y")).cast("int").alias("m")).select("page_id", "m").distinct()
    edges = medians.unionByName(found.select("page_id").distinct().withColumn("m", F.lit(0))).distinct()
    order = by("page_id").orderBy("m")
    return edges.select("page_id", F.row_number().over(order).alias("band"), F.col("m").alias("y0"), F.coalesce(F.lead("m").over(order), F.lit(height)).alias("y1"))


def restored(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """cells(page_id, y, x, class_id) through mapping(page_id, y, x, iy, ix) back to the input;
    where several cells go to one place, the last in raster order is seen."""
    moved = cells.join(mapping, ["page_id", "y", "x"]).where("class_id > 0")
    last = F.max_by("class_id", F.struct("y", "x"))
    return moved.groupBy("page_id", "iy", "ix").agg(last.alias("class_id"))


def pasted(cells: DataFrame, windows: DataFrame) -> DataFrame:
    """cells(sheet_id, page_no, y, x, class_id) of the pages of a sheet, windows(sheet_id,
    page_no, x, y): class ids go on from page to page, and cells move to their window."""
    order = Window.partitionBy("sheet_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    tops = cells.groupBy("sheet_id", "page_no").agg(F.max("class_id").alias("top"))
    offsets = tops.withColumn("offset", F.coalesce(F.sum("top").over(order), F.lit(0))).drop("top")
    at = windows.withColumnsRenamed({"x": "wx", "y": "wy"})
    rows = cells.where("class_id > 0").join(offsets, ["sheet_id", "page_no"]).join(at, ["sheet_id", "page_no"])
    return rows.select("sheet_id", (F.col("y") + F.col("wy")).alias("y"), (F.col("x") + F.col("wx")).alias("x"), (F.col("class_id") + F.col("offset")).alias("class_id"))


def class_boxes(cells: DataFrame) -> DataFrame:
    """Box, size and mass centre of every class."""
    return cells.groupBy("page_id", "class_id").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy")
    )
