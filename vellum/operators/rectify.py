"""Local deskew of warped pages: angles by grid cell, a smooth vertical displacement, and the
inverse of the warp."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.numeric import by, half_even


def cells(ink: DataFrame, rows: int, cols: int, height: int, width: int) -> DataFrame:
    """ink with its grid cell (gy, gx); bounds are evenly spaced and truncated."""
    bound = lambda n, size: [int(i * size / n) for i in range(n + 1)]

    def number(c: Column, edges: list[int]) -> Column:
        out = F.lit(0)
        for e in edges[1:-1]:
            out = out + (c >= e).cast("int")
        return out

    return ink.withColumns({"gy": number(F.col("y"), bound(rows, height)), "gx": number(F.col("x"), bound(cols, width))})


def cell_angles(ink: DataFrame, angles: list[float], rows: int, cols: int, height: int, width: int, least: int = 32, most: float = 8.0) -> DataFrame:
    """(page_id, gy, gx, angle): the skew of each cell, 0 with little ink, within +-most. Cells
    without ink don't appear. Counted per (cell, angle, row) before the variance is taken."""
    slopes = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("angle"), F.lit(math.tan(math.radians(a))).alias("t")) for a in angles])).alias("s")
    split = cells(ink, rows, cols, height, width)
    keys = ["page_id", "gy", "gx"]
    counted = split.select(*keys, "y", "x", slopes).groupBy(*keys, F.col("s.angle").alias("angle"), half_even(F.col("y") - F.col("x") * F.col("s.t")).alias("r")).agg(F.count("*").alias("n"))
    size = float(height) / rows
    var = F.sum(F.col("n") * F.col("n")) / size - F.pow(F.sum("n") / size, F.lit(2.0))
    scored = counted.groupBy(*keys, "angle").agg(F.round(var, 9).alias("var"), F.sum("n").alias("ink"))
    best = scored.groupBy(*keys).agg(F.max_by("angle", F.struct(F.col("var"), -F.abs("angle"), -F.col("angle"))).alias("angle"), F.max("ink").alias("ink"))
    clipped = F.least(F.lit(most), F.greatest(F.lit(-most), F.col("angle")))
    return best.select(*keys, F.when(F.col("ink") < least, 0.0).otherwise(clipped).alias("angle"))


def _cubic(values: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Cubic resampling along an axis, samples at centres, ends repeated."""
    values = np.moveaxis(values, axis, 0)
    n = len(values)
    at = (np.arange(size) + 0.5) * n / size - 0.5
    low = np.floor(at).astype(int)
    f = at - low
    a = -0.75
    near, far = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1, lambda d: ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    weights = far(f + 1), near(f), near(1 - f), far(2 - f)
    out = sum(w.reshape(-1, *[1] * (values.ndim - 1)) * values[np.clip(low + k - 1, 0, n - 1)] for k, w in enumerate(weights))
    return np.moveaxis(out, 0, axis)


def displacement_map(angles: np.ndarray, height: int, width: int) -> np.ndarray:
    """Vertical displacement of every place: angles upsampled, their slopes summed along the row,
    the row's mean taken off."""
    slope = np.tan(np.radians(_cubic(_cubic(angles, height, 0), width, 1)))
    d = np.concatenate([np.zeros((height, 1)), np.cumsum(slope, axis=1)[:, :-1]], axis=1)
    return d - d.mean(axis=1, keepdims=True)


def straightened(ink: DataFrame, angles: DataFrame, rows: int, cols: int, height: int, width: int) -> DataFrame:
    """ink(page_id, y, x) moved to where a local deskew puts it: (page_id, y, x, iy, ix), with the
    source place, which is the map for the way back. A page's ink meets its few angles in one row
    per page column block, so a task holds one batch of columns."""
    grid = angles.groupBy("page_id").agg(F.collect_list(F.struct("gy", "gx", "angle")).alias("cells"))
    columns = ink.groupBy("page_id", "x").agg(F.array_sort(F.collect_list("y")).alias("ys"))

    def run(batches):
        known: dict = {}
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.page_id not in known:
                    known.clear()
                    a = np.zeros((rows, cols))
                    for c in r.cells if r.cells is not None else ():
                        a[c["gy"], c["gx"]] = c["angle"]
                    known[r.page_id] = displacement_map(a, height, width)
                d = known[r.page_id][:, r.x]
                source = np.clip(np.rint(np.arange(height) + d).astype(int), -1, height)
                ink_here = np.zeros(height + 2, bool)
                ink_here[np.asarray(r.ys) + 1] = True
                ys = np.flatnonzero(ink_here[source + 1])
                out.append(pd.DataFrame({"page_id": r.page_id, "y": ys.astype(np.int32), "x": r.x, "iy": source[ys].astype(np.int32), "ix": r.x}))
            yield pd.concat(out) if out else pd.DataFrame(columns=["page_id", "y", "x", "iy", "ix"])

    both = columns.join(grid, "page_id", "left").repartition("page_id").sortWithinPartitions("page_id", "x")
    return both.mapInPandas(run, "page_id bigint, y int, x int, iy int, ix int")


def slanted_profile(ink: DataFrame, angles: DataFrame, rows: int, cols: int, height: int, width: int) -> DataFrame:
    """(page_id, y, hpp): ink summed along each cell's own slant; under a quarter degree a cell is
    read straight."""
    split = cells(ink, rows, cols, height, width).join(angles, ["page_id", "gy", "gx"])
    left = F.col("gx") * float(width) / cols
    t = F.when(F.abs("angle") <= 0.25, 0.0).otherwise(F.tan(F.radians("angle")))
    row = half_even(F.col("y") - (F.col("x") - F.floor(left)) * t)
    return split.groupBy("page_id", row.alias("y")).agg(F.count("*").alias("hpp"))


def padding(height: Column, width: Column, angle: float, safety: int = 2) -> tuple[Column, Column]:
    """Rows and columns to add on each side so that nothing leaves the picture when it turns."""
    c, s = abs(math.cos(math.radians(angle))), abs(math.sin(math.radians(angle)))
    need = lambda turned, size: F.ceil(F.greatest(F.lit(0.0), turned - size) / 2).cast("int") + safety
    return need(height * c + width * s, height), need(width * c + height * s, width)


def equalised(grey: DataFrame, clip: float = 2.0, tiles: int = 8, gamma: float = 1.0, height: int = 64, width: int = 64) -> DataFrame:
    """grey(page_id, y, x, v), whole values 0 to 255: contrast evened out by tile, counts above
    `clip` times the mean spread over all levels, then a power law. Levels are looked up in their
    own tile's distribution; tiles aren't blended."""
    area = F.lit(float(height * width) / tiles / tiles)
    rows = grey.withColumns({"ty": F.floor(F.col("y") * tiles / height), "tx": F.floor(F.col("x") * tiles / width)})
    keys = ["page_id", "ty", "tx"]
    n = rows.groupBy(*keys, "v").agg(F.count("*").alias("n"))
    most = F.greatest(F.lit(1.0), clip * area / 256)
    tile = Window.partitionBy(*keys)
    n = n.withColumns({"kept": F.least(F.col("n").cast("double"), most)}).withColumn("extra", F.sum(F.col("n") - F.col("kept")).over(tile))
    below = F.sum("kept").over(tile.orderBy("v")) + F.col("extra") * (F.col("v") + 1) / 256
    table = n.withColumn("e", F.rint(255 * F.least(F.lit(1.0), below / F.sum("n").over(tile)))).select(*keys, "v", "e")
    lut = F.rint(255 * F.pow(F.col("e") / 255, F.lit(gamma))).cast("int")
    return rows.join(table, [*keys, "v"]).select("page_id", "y", "x", lut.alias("v"))


def orientation(ink: DataFrame, prominence: float = 0.1) -> DataFrame:
    """(page_id, angle): 0 or 90, where the profile has more peaks above both neighbours by the
    share `prominence` of its greatest value; 0 on a tie."""
    both = None
    for angle, c in ((0, "y"), (90, "x")):
        p = ink.groupBy("page_id", F.col(c).alias("k")).agg(F.count("*").alias("n"))
        order, page = by("page_id").orderBy("k"), by("page_id")
        beside = lambda f: F.when(f("k").over(order) == F.col("k") + (1 if f is F.lead else -1), f("n").over(order)).otherwise(0)  # noqa: B023, E731
        high = F.col("n") - F.greatest(beside(F.lag), beside(F.lead)) >= prominence * F.max("n").over(page)
        peaks = p.withColumn("peak", high).groupBy("page_id").agg(F.count_if("peak").alias("peaks")).withColumn("angle", F.lit(angle))
        both = peaks if both is None else both.unionAll(peaks)
    return both.groupBy("page_id").agg(F.max_by("angle", F.struct(F.col("peaks"), -F.col("angle"))).alias("angle"))
