"""Skew search, boxes, polygons and vertical displacement."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.numeric import axis, by, half_even, overlap


def skew(ink: DataFrame, angles: list[float], height: int) -> DataFrame:
    """ink(page_id, y, x): the angle whose sheared row counts vary most, first angle on a tie.

    Rows are counted per (page, angle, row) before the variance, and rows without ink enter it by
    the known height: var = sum(n^2)/H - (sum(n)/H)^2. An ink cell meets every angle, nothing else."""
    slopes = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("angle"), F.lit(math.tan(math.radians(a))).alias("t")) for a in angles])).alias("s")
    rows = ink.select("page_id", "y", "x", slopes).groupBy("page_id", F.col("s.angle").alias("angle"), half_even(F.col("y") - F.col("x") * F.col("s.t")).alias("r")).agg(F.count("*").alias("n"))
    var = F.sum(F.col("n") * F.col("n")) / height - (F.sum("n") / height) * (F.sum("n") / height)
    scored = rows.groupBy("page_id", "angle").agg(F.round(var, 9).alias("var"))
    best = F.max_by(F.struct("angle", "var"), F.struct(F.col("var"), -F.col("angle"))).alias("b")
    return scored.groupBy("page_id").agg(best).select("page_id", "b.angle", "b.var")


def _places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, x, y) of the column `cells`: cells by row, and their places, row after row and each in
    order of the raster."""
    flat = batch["cells"].flatten()
    n = batch["cells"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    x, y = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("x", "y"))
    order = np.lexsort((x, y, np.repeat(np.arange(len(n)), n)))
    return n, x[order], y[order]


def _axes(n: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[float | None]:
    xs, ys, ends = x.tolist(), y.tolist(), np.cumsum(n).tolist()
    return [axis(xs[a:b], ys[a:b]) for a, b in zip([0, *ends], ends)]


def _by_page(pages: DataFrame, keys: list[str], found: Callable[[pa.RecordBatch], tuple[pa.RecordBatch, dict]], columns: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            batch, new = found(batch)
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), *(pa.array(v) for v in new.values())], [*keys, *new])

    whole = pages.groupBy(*keys).agg(F.flatten(F.collect_list("cells")).alias("cells"))
    return whole.mapInArrow(run, ", ".join([*(f"`{k}` {whole.schema[k].dataType.simpleString()}" for k in keys), columns]))


def axes(pages: DataFrame, *keys: str) -> DataFrame:
    """pages(*keys, cells array<struct<y, x>>), whole pages or parts of them: (*keys, n, angle), the
    number of cells and the axis of their greatest variance."""

    def found(batch):
        n, x, y = _places(batch)
        return batch, {"n": n, "angle": pa.array(_axes(n, x, y), pa.float64())}

    return _by_page(pages, list(keys), found, "n bigint, angle double")


def pca_box(pages: DataFrame, *keys: str, least: int = 10, low: float = 0.01, high: float = 0.99, low_short: float = 0.05, high_short: float = 0.95) -> DataFrame:
    """The box along the main axis of each point set, pages(*keys, cells) as for `axes`: direction,
    and extents from the centre between percentiles along it and across it. The axis comes in
    closed form from the covariances."""

    def found(batch):
        batch = batch.filter(pa.compute.greater_equal(pa.compute.list_value_length(batch["cells"]), max(least, 2)))
        n, x, y = _places(batch)
        angles = _axes(n, x, y)
        page = np.repeat(np.arange(len(n)), n)
        mean = lambda c: (np.bincount(page, c, len(n)) / n)[page]
        turn = lambda f: np.array([f(a) for a in angles])[page]
        dx, dy = x - mean(x), y - mean(y)
        cos, sin = turn(math.cos), turn(math.sin)
        start = np.cumsum(n) - n

        def percentiles(c, *shares):
            c = c[np.lexsort((c, page))]
            for q in shares:
                at = q * (n - 1)
                a, b = np.floor(at), np.ceil(at)
                first, second = c[start + a.astype(np.int64)], c[start + b.astype(np.int64)]
                yield np.where(a == b, first, (b - at) * first + (at - a) * second)

        s0, s1 = percentiles(dx * cos + dy * sin, low, high)
        t0, t1 = percentiles(dy * cos - dx * sin, low_short, high_short)
        return batch, {"n": n, "angle": pa.array(angles, pa.float64()), "s0": s0, "s1": s1, "t0": t0, "t1": t1}

    return _by_page(pages, list(keys), found, "n bigint, angle double, s0 double, s1 double, t0 double, t1 double")


def box_iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """IoU of two axis-aligned boxes, each with x0, y0, x1, y1."""
    inter = overlap(a["x0"], a["x1"], b["x0"], b["x1"]) * overlap(a["y0"], a["y1"], b["y0"], b["y1"])
    area = lambda k: (k["x1"] - k["x0"]) * (k["y1"] - k["y0"])
    return F.when(area(a) + area(b) - inter > 0, inter / (area(a) + area(b) - inter)).otherwise(0.0)


def box_pairs(pred: DataFrame, target: DataFrame, reach: float = 64.0) -> DataFrame:
    """Pairs of boxes of a page that overlap, with their IoU. Boxes are dealt into bands of rows,
    `reach` rows high; a pair meets in the bands that both touch and counts once, in the band
    where its intersection starts."""
    bands = lambda d, p: d.select("page_id", *[F.col(c).alias(p + c) for c in ("box_id", "x0", "y0", "x1", "y1")], F.explode(F.sequence(F.floor(F.col("y0") / reach), F.floor(F.col("y1") / reach))).alias("band"))
    both = bands(pred, "p_").join(bands(target, "t_"), ["page_id", "band"])
    both = both.where(F.col("band") == F.floor(F.greatest("p_y0", "t_y0") / reach))
    side = lambda p: {c: F.col(p + c) for c in ("x0", "y0", "x1", "y1")}
    return both.withColumn("iou", box_iou(side("p_"), side("t_"))).where("iou > 0").select("page_id", F.col("p_box_id").alias("pred"), F.col("t_box_id").alias("target"), "iou")


def shoelace(points: str = "points") -> Column:
    """Area of a polygon array<struct<x, y>>."""
    following = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    cross = F.zip_with(points, following, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, c: s + c)) / 2


def crop_tall(boxes: DataFrame, factor: float = 1.2) -> DataFrame:
    """boxes(page_id, box_id, y0, y1, mass): boxes higher than factor times the page's mean height
    get that height, kept on the side of the mass centre (the top on a tie), moved just so far
    that the mass centre is inside, and never out of the old box; under 2 rows the old box stays."""
    height = F.col("y1") - F.col("y0")
    sized = boxes.withColumn("mean", F.avg(height).over(by("page_id")))
    top = (F.col("mass") - F.col("y0")) <= (F.col("y1") - F.col("mass"))
    start = F.when(top, F.col("y0")).otherwise(F.col("y1") - F.col("mean"))
    start = F.least(start, F.col("mass"))
    start = F.greatest(start, F.col("mass") - F.col("mean"))
    start = F.greatest(F.col("y0"), F.least(start, F.col("y1") - F.col("mean")))
    cut = (height > factor * F.col("mean")) & (F.col("mean") >= 2)
    return sized.withColumn("n0", F.when(cut, start).otherwise(F.col("y0"))).withColumn("n1", F.when(cut, F.col("n0") + F.col("mean")).otherwise(F.col("y1"))).drop("mean")


def two_means(rows: DataFrame, value: str, *keys: str, rounds: int = 30, close: float = 1e-3) -> DataFrame:
    """2-means on one dimension from the least and greatest value, by group: (low, high, n_low,
    n_high). Values are first summed per distinct value, so a group is a list of distinct values;
    the rounds are a fold over that list."""
    sums = rows.groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    lists = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("vs"))

    def mean(vs, near_low, c):
        chosen = F.filter(vs, lambda x: (F.abs(x["v"] - c["a"]) <= F.abs(x["v"] - c["b"])) if near_low else (F.abs(x["v"] - c["a"]) > F.abs(x["v"] - c["b"])))
        total = F.aggregate(chosen, F.lit(0.0), lambda s, x: s + x["v"] * x["n"])
        n = F.aggregate(chosen, F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
        return F.when(n > 0, total / n).otherwise(c["a"] if near_low else c["b"]), n

    def step(c, _):
        a, _n = mean(F.col("vs"), True, c)
        b, _n = mean(F.col("vs"), False, c)
        done = c["done"] | ((F.abs(a - c["a"]) <= close) & (F.abs(b - c["b"]) <= close))
        return F.struct(F.when(c["done"], c["a"]).otherwise(a).alias("a"), F.when(c["done"], c["b"]).otherwise(b).alias("b"), done.alias("done"))

    start = F.struct(F.element_at("vs", 1)["v"].alias("a"), F.element_at("vs", -1)["v"].alias("b"), F.lit(False).alias("done"))
    ended = lists.withColumn("c", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step))
    c = {"a": F.col("c.a"), "b": F.col("c.b")}
    return ended.select(*keys, F.col("c.a").alias("low"), F.col("c.b").alias("high"), mean(F.col("vs"), True, c)[1].alias("n_low"), mean(F.col("vs"), False, c)[1].alias("n_high"))


def monotone(columns: DataFrame, step: float) -> DataFrame:
    """columns(page_id, x, y, c): each column's map made to rise by `step` per row or more. The
    running rule c[y] = max(c[y], c[y-1] + step) in closed form: y*step + running max(c - y*step)."""
    order = Window.partitionBy("page_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return columns.withColumn("m", F.col("y") * step + F.max(F.col("c") - F.col("y") * step).over(order))


def displacement(kind: str, x: Column, width: float, strength: float, power: float = 2.0) -> Column:
    """Vertical shift of column x: sine, parabola, or the bend of the left or right edge."""
    if kind == "sine":
        return strength * F.sin(2 * math.pi * x / width)
    if kind == "parabola":
        return strength * F.pow((x - width / 2) / (width / 2), F.lit(2.0))
    distance = x if kind == "left" else width - 1 - x
    return strength * F.pow(F.least(F.greatest(1 - distance / width, F.lit(0.0)), F.lit(1.0)), F.lit(power))


def warp(cells: DataFrame, shift: Column, height: int) -> DataFrame:
    """cells(page_id, y, x): each output cell (y, x) shows the source cell at y - shift, rounded;
    here forward, source to output, which is the same for shifts by column."""
    return cells.withColumn("y", F.col("y") + half_even(shift)).where(F.col("y").between(0, height - 1))


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, by the monotone chain."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(rows):
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points) + half(points[::-1]))


def smallest_rectangle(points: np.ndarray) -> np.ndarray:
    """Corners of the rotated rectangle of least area around the points: one side lies along an
    edge of the hull."""
    edge = hull(points.astype(float))
    if len(edge) < 3:
        return np.repeat(edge, 2, axis=0)[:4] if len(edge) == 2 else np.repeat(edge, 4, axis=0)
    best = None
    for d in np.roll(edge, -1, axis=0) - edge:
        u = d / np.hypot(*d)
        v = np.array([-u[1], u[0]])
        s, t = edge @ u, edge @ v
        area = (s.max() - s.min()) * (t.max() - t.min())
        if best is None or area < best[0] - 1e-9:
            best = area, [a * u + b * v for a, b in ((s.min(), t.min()), (s.max(), t.min()), (s.max(), t.max()), (s.min(), t.max()))]
    return np.array(best[1])


def rectangles(ink: DataFrame, *keys: str, least: int = 3) -> DataFrame:
    """Rotated rectangles around point sets of `least` points or more. First each row of a set is
    cut to its ends, natively: only they can be corners, and a set becomes two points per row."""
    ends = ink.groupBy(*keys, "y").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("n"))
    types = {f.name: f.dataType.simpleString() for f in ink.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", corners array<array<double>>"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        points = np.concatenate([group[["x0", "y"]].to_numpy(), group[["x1", "y"]].to_numpy()])
        return pd.DataFrame([[*(first[k] for k in keys), [list(map(float, p)) for p in smallest_rectangle(points)]]], columns=[*keys, "corners"])

    whole = ends.withColumn("all", F.sum("n").over(by(*keys))).where(F.col("all") >= least)
    return whole.select(*keys, "y", "x0", "x1").groupBy(*keys).applyInPandas(run, schema)


def clip(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of a convex polygon inside another one, corner by corner of the latter."""
    if len(window) and _signed(window) < 0:
        window = window[::-1]
    out = [tuple(p) for p in subject]
    for a, b in zip(window, np.roll(window, -1, axis=0)):
        side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])  # noqa: B023, E731
        kept = []
        for p, q in zip(out, out[1:] + out[:1]):
            sp, sq = side(p), side(q)
            if sp >= 0:
                kept.append(p)
            if sp * sq < 0:
                k = sp / (sp - sq)
                kept.append((p[0] + k * (q[0] - p[0]), p[1] + k * (q[1] - p[1])))
        out = kept
    return np.array(out).reshape(-1, 2)


def _signed(p: np.ndarray) -> float:
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2) if len(p) else 0.0


def polygon_iou(a: np.ndarray, b: np.ndarray) -> float:
    """IoU of two convex polygons, 0 where the union is empty."""
    inter = abs(_signed(clip(a, b)))
    union = abs(_signed(a)) + abs(_signed(b)) - inter
    return inter / union if union > 0 else 0.0


def in_polygons(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """points(page_id, y, x), polygons(page_id, class_id, points): the class of each point, the
    greatest where polygons overlap; points in none are dropped. A page's polygons come to its
    points as one list, and the box is tested before the edges are counted."""
    xs, ys = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    boxed = polygons.select("page_id", F.struct("class_id", "points", F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1")).alias("p"))
    lists = boxed.groupBy("page_id").agg(F.collect_list("p").alias("ps"))

    def inside(p):
        following = F.concat(F.slice(p["points"], 2, F.size(p["points"])), F.slice(p["points"], 1, 1))
        crossed = F.zip_with(
            p["points"], following,
            lambda a, b: ((a["y"] > F.col("y")) != (b["y"] > F.col("y"))) & (F.col("x") < (b["x"] - a["x"]) * (F.col("y") - a["y"]) / (b["y"] - a["y"]) + a["x"]),
        )
        near = F.col("x").between(p["x0"], p["x1"]) & F.col("y").between(p["y0"], p["y1"])
        return near & (F.size(F.filter(crossed, lambda c: c)) % 2 == 1)

    found = F.array_max(F.transform(F.filter("ps", inside), lambda p: p["class_id"]))
    return points.join(lists, "page_id").withColumn("class_id", found).where("class_id is not null").drop("ps")


def crop_to_mass(boxes: DataFrame, least: float = 2.0) -> DataFrame:
    """boxes(page_id, box_id, y0, y1, mass): the mass centre comes to mid-height, the half height
    is its distance to the nearer side; under `least` rows the old box stays."""
    half = F.least(F.col("mass") - F.col("y0"), F.col("y1") - F.col("mass"))
    cut = 2 * half >= least
    return boxes.withColumns({"n0": F.when(cut, F.col("mass") - half).otherwise(F.col("y0")), "n1": F.when(cut, F.col("mass") + half).otherwise(F.col("y1"))})


def top_by_share(ink: DataFrame, share: float, *keys: str) -> DataFrame:
    """Boxes whose top edge leaves out the highest cells beyond `share` of all."""
    return ink.groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.percentile("y", F.lit(1 - share)).alias("y0"), F.max("y").cast("double").alias("y1"), F.count("*").alias("n"))


def side_noise(boxes: DataFrame, low: float = 0.05, high: float = 0.35, least: float = 3.0) -> DataFrame:
    """boxes(page_id, box_id, x0, x1, ...): the cut at a page's side, if text of a neighbour page
    shows there. Left and right midpoints of all boxes form two clusters; where the smaller one's
    share is from low to high and the centres are farther apart than points are from theirs on
    average, every box is cut at the mid of the centres, on the smaller cluster's side. A box that
    the cut doesn't cross, or that would keep under `least` columns, stays as it is. Returns all
    boxes with n0, n1."""
    sides = boxes.select("page_id", F.explode(F.array("x0", "x1")).alias("x"))
    means = two_means(sides, "x", "page_id")
    near = F.least(F.abs(F.col("x") - F.col("low")), F.abs(F.col("x") - F.col("high")))
    spread = sides.join(means, "page_id").groupBy("page_id").agg(F.avg(near).alias("spread"))
    small = F.least("n_low", "n_high") / (F.col("n_low") + F.col("n_high"))
    found = means.join(spread, "page_id").where((small >= low) & (small <= high) & (F.col("high") - F.col("low") > F.col("spread")))
    cuts = found.select("page_id", ((F.col("low") + F.col("high")) / 2).alias("cut"), (F.col("n_low") < F.col("n_high")).alias("left"))
    crossed = (F.col("x0") < F.col("cut")) & (F.col("cut") < F.col("x1"))
    n0 = F.when(crossed & F.col("left") & (F.col("x1") - F.col("cut") >= least), F.col("cut")).otherwise(F.col("x0"))
    n1 = F.when(crossed & ~F.col("left") & (F.col("cut") - F.col("x0") >= least), F.col("cut")).otherwise(F.col("x1"))
    return boxes.join(cuts, "page_id", "left").withColumns({"n0": n0, "n1": n1}).drop("cut", "left")


def straddling(boxes: DataFrame, width: Column) -> DataFrame:
    """Boxes that reach over the middle of the picture."""
    return boxes.where((F.col("x0") < width / 2) & (F.col("x1") >= width / 2))
