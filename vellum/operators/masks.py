"""Cells of masks and class matrices moved, cropped, fitted, scaled and compared.

All work on rows (page_id, y, x, ...) of the cells that aren't empty; a picture's size is a number
or a column by page. Nothing is joined but by page or by place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.numeric import by, half_even
from vellum.operators.geometry import axes


def cropped(cells: DataFrame) -> DataFrame:
    """cells moved so that their box starts at (0, 0), with the box's size (h, w)."""
    page = by("page_id")
    y0, x0 = F.min("y").over(page), F.min("x").over(page)
    sized = cells.withColumns({"h": F.max("y").over(page) - y0 + 1, "w": F.max("x").over(page) - x0 + 1, "__y": F.col("y") - y0, "__x": F.col("x") - x0})
    return sized.drop("y", "x").withColumnsRenamed({"__y": "y", "__x": "x"})


def fitted(cells: DataFrame, h: Column, w: Column, height: Column, width: Column) -> DataFrame:
    """cells of a picture of h x w in the middle of one of height x width: padded where it is
    smaller, cut where it is larger, the odd row or column at the end."""
    off = lambda size, target: F.greatest(F.lit(0), F.floor((target - size) / 2)) - F.greatest(F.lit(0), F.floor((size - target) / 2))
    moved = cells.withColumns({"y": (F.col("y") + off(h, height)).cast("int"), "x": (F.col("x") + off(w, width)).cast("int")})
    return moved.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))


def shifted(cells: DataFrame, dy: Column, dx: Column, height: int, width: int) -> DataFrame:
    """cells moved without wrapping around."""
    moved = cells.withColumns({"y": F.col("y") + dy, "x": F.col("x") + dx})
    return moved.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))


def scaled(cells: DataFrame, height: int, width: int, to_height: int, to_width: int) -> DataFrame:
    """Nearest resizing: output (Y, X) shows the cell at the floor of Y*height/to_height. Each cell
    brings the output places that show it."""
    places = lambda c, size, to: F.sequence(F.ceil(F.col(c) * to / size).cast("int"), (F.ceil((F.col(c) + 1) * to / size) - 1).cast("int"))
    shown = lambda c, size, to: F.filter(places(c, size, to), lambda p: F.floor(p * size / to) == F.col(c))
    rows = cells.withColumn("__y", F.explode(shown("y", height, to_height)))
    return rows.withColumn("__x", F.explode(shown("x", width, to_width))).drop("y", "x").withColumnsRenamed({"__y": "y", "__x": "x"})


def turned(cells: DataFrame, degrees: float, height: int, width: int) -> DataFrame:
    """cells turned about the picture's centre, nearest source: output (y, x) shows the cell that the
    inverse turn rounds to. Each page's places meet its cells by place."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    my, mx = (height - 1) / 2, (width - 1) / 2
    grid = cells.select("page_id").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    dy, dx = F.col("y") - my, F.col("x") - mx
    rounded = lambda v: half_even(F.round(v, 9))
    sources = grid.withColumns({"sy": rounded(my - s * dx + c * dy), "sx": rounded(mx + c * dx + s * dy)})
    return sources.join(cells.withColumnsRenamed({"y": "sy", "x": "sx"}), ["page_id", "sy", "sx"]).drop("sy", "sx")


def line_band(cells: DataFrame, height: int, margin: int = 16) -> DataFrame:
    """(page_id, y0, y1): the rows of the ink with a margin, inside the picture."""
    ends = cells.groupBy("page_id").agg(F.min("y").alias("a"), F.max("y").alias("b"))
    return ends.select("page_id", F.greatest(F.lit(0), F.col("a") - margin).alias("y0"), F.least(F.lit(height - 1), F.col("b") + margin).alias("y1"))


def zone_energy(cells: DataFrame, regions: DataFrame, weight: float = 255.0) -> DataFrame:
    """cells(page_id, y, x, v) with energy = v, and `weight` more inside regions(page_id, y0, y1).
    Regions come as rows, so each row of a page meets at most one."""
    rows = regions.select("page_id", F.explode(F.sequence("y0", "y1")).alias("y")).distinct().withColumn("__in", F.lit(weight))
    return cells.join(rows, ["page_id", "y"], "left").withColumn("energy", F.col("v") + F.coalesce("__in", F.lit(0.0))).drop("__in")


def used_share(candidate: DataFrame, used: DataFrame, height: int, width: int) -> DataFrame:
    """candidate, used(page_id, y, x): the share of the candidate's cells on the page that are used
    already; 1 if none of them is on the page."""
    here = candidate.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    hit = here.join(used.select("page_id", "y", "x").distinct().withColumn("__hit", F.lit(1)), ["page_id", "y", "x"], "left")
    shares = hit.groupBy("page_id").agg((F.count("__hit") / F.count("*")).alias("share"))
    return candidate.select("page_id").distinct().join(shares, "page_id", "left").withColumn("share", F.coalesce("share", F.lit(1.0)))


def equal_blocks(cells: DataFrame, width: Column) -> DataFrame:
    """cells(page_id, comp_id, y, x): mean place of the ink in each of ceil(w / width) equal blocks
    of a component, their edges truncated; empty blocks don't appear."""
    comp = by("page_id", "comp_id")
    left = F.min("x").over(comp)
    sized = cells.withColumns({"__i": F.col("x") - left, "__w": F.max("x").over(comp) - left + 1}).withColumn("__n", F.ceil(F.col("__w") / width))
    # block i holds columns from floor(i*w/n) on: the last i whose edge isn't beyond the column
    block = F.floor(((F.col("__i") + 1) * F.col("__n") - 1) / F.col("__w")).cast("int")
    return sized.groupBy("page_id", "comp_id", block.alias("block")).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n"))


def in_reading_order(lines: DataFrame, value: str, *ties: str) -> DataFrame:
    """lines(page_id, ...) numbered from the top of the page."""
    return lines.withColumn("number", F.row_number().over(by("page_id").orderBy(value, *ties)))


def page_window(found: DataFrame) -> DataFrame:
    """found(page_id, x0, y0, x1, y1, score, area): each picture's page, the one of greatest score,
    then area."""
    rest = F.struct("x0", "y0", "x1", "y1", "score", "area")
    return found.groupBy("page_id").agg(F.max_by(rest, F.struct("score", "area", (-F.col("y0")).alias("a"), (-F.col("x0")).alias("b"))).alias("p")).select("page_id", "p.*")


def inside_window(cells: DataFrame, windows: DataFrame) -> DataFrame:
    """cells of each picture's page, moved to its corner."""
    both = cells.join(windows.select("page_id", "x0", "y0", "x1", "y1"), "page_id")
    rows = both.where((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")))
    return rows.withColumns({"y": F.col("y") - F.col("y0"), "x": F.col("x") - F.col("x0")}).drop("x0", "y0", "x1", "y1")


def assigned(sources: DataFrame, lines: DataFrame, pad: float = 0.0, reach: float = 64.0) -> DataFrame:
    """sources, lines(page_id, box_id, x0, y0, x1, y1): (page_id, source, line, area), each source
    with the line that it shares the greatest area with, lines padded on all sides, the first on a
    tie; a source that touches no line isn't there. Boxes meet in bands of rows."""
    bands = lambda d, p, pad: d.select("page_id", *[(F.col(c) + k).alias(p + c) for c, k in (("x0", -pad), ("y0", -pad), ("x1", pad), ("y1", pad))], F.col("box_id").alias(p + "id")).withColumn("band", F.explode(F.sequence(F.floor(F.col(p + "y0") / reach), F.floor(F.col(p + "y1") / reach))))
    both = bands(sources, "s_", 0.0).join(bands(lines, "l_", pad), ["page_id", "band"]).where(F.col("band") == F.floor(F.greatest("s_y0", "l_y0") / reach))
    side = lambda c: F.greatest(F.lit(0.0), F.least(f"s_{c}1", f"l_{c}1") - F.greatest(f"s_{c}0", f"l_{c}0"))
    sized = both.withColumn("area", side("x") * side("y")).where("area > 0")
    best = F.max_by(F.struct(F.col("l_id").alias("line"), "area"), F.struct("area", -F.col("l_id"))).alias("b")
    return sized.groupBy("page_id", F.col("s_id").alias("source")).agg(best).select("page_id", "source", "b.line", "b.area")


def sides(corners: Column) -> Column:
    """The side lengths of an array of corner structs."""
    following = F.concat(F.slice(corners, 2, F.size(corners)), F.slice(corners, 1, 1))
    return F.zip_with(corners, following, lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])))


def side_midpoints(corners: Column) -> Column:
    """struct(left, right): the midpoints of the leftmost and the rightmost side, the first on a tie."""
    following = F.concat(F.slice(corners, 2, F.size(corners)), F.slice(corners, 1, 1))
    mids = F.zip_with(corners, following, lambda a, b: F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y")))
    keyed = lambda sign: F.transform(mids, lambda m, i: F.struct((sign * m["x"]).alias("k"), i.alias("i"), m.alias("m")))
    return F.struct(F.array_min(keyed(1))["m"].alias("left"), F.array_min(keyed(-1))["m"].alias("right"))


def segment_distance(px: Column, py: Column, a: Column, b: Column) -> Column:
    """Distance of a point to the segment from a to b."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - a["x"]) * dx + (py - a["y"]) * dy) / length))).otherwise(0.0)
    ex, ey = px - a["x"] - t * dx, py - a["y"] - t * dy
    return F.sqrt(ex * ex + ey * ey)


def outline_distance(px: Column, py: Column, corners: Column) -> Column:
    """Distance of a point to the nearest side of a polygon."""
    following = F.concat(F.slice(corners, 2, F.size(corners)), F.slice(corners, 1, 1))
    return F.array_min(F.zip_with(corners, following, lambda a, b: segment_distance(px, py, a, b)))


def long_boxes(boxes: DataFrame, corners: Column, width: Column, share: float = 0.2) -> DataFrame:
    """Boxes whose longest side is above a share of the picture's width."""
    return boxes.where(F.array_max(sides(corners)) > share * width)


def main_direction(pages: DataFrame, least: int = 3) -> DataFrame:
    """pages(page_id, cells) as for geometry.axes: degrees of the axis of greatest variance, from 0
    up to 180; 0 with fewer than `least` points."""
    angle = F.degrees("angle")
    turned_up = F.when(angle < 0, angle + 180).otherwise(angle)
    return axes(pages, "page_id").select("page_id", F.when(F.col("n") < least, 0.0).otherwise(turned_up).alias("angle"))


def vote_thresholds(n: Column, first: int, second: int, few: int, many: int, least: tuple[int, int], most: tuple[int, int]) -> tuple[Column, Column]:
    """Vote thresholds for a page of n components: halved for few of them, two more for many,
    inside their bounds."""

    def one(value: int, low: int, high: int) -> Column:
        return F.when(n < few, max(low, value // 2)).when(n > many, min(high, value + 2)).otherwise(value)

    return one(first, least[0], most[0]), one(second, least[1], most[1])


def relaxed_subset(w: Column, h: Column, ah: Column, aw: Column, low: float = 0.5, high: float = 3.0, width: float = 0.5) -> Column:
    """As components.subset, but what fits nowhere is usual too."""
    usual = (h >= low * ah) & (h < high * ah) & (w >= width * aw)
    small = ((h < high * ah) & (w < width * aw)) | ((h < low * ah) & (w > width * aw))
    return F.when(usual, 1).when(h >= high * ah, 2).when(small, 3).otherwise(1)


def odd_window(k: Column, n: Column) -> Column:
    """A window of an odd number of rows, 3 or more, that fits the profile where it can."""
    size = F.greatest(F.lit(3), F.least(k, n))
    return F.greatest(F.lit(3), F.when(size % 2 == 0, size - 1).otherwise(size))


def local_threshold_parts(cells: DataFrame, boxes: DataFrame, parts: int = 4) -> DataFrame:
    """cells(page_id, y, x, v) inside boxes(page_id, box_id, x0, y0, x1, y1) with the number of the
    box's vertical part that they are in, parts of equal width."""
    both = cells.join(boxes, "page_id").where((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")))
    part = F.least(F.lit(parts - 1), F.floor((F.col("x") - F.col("x0")) * parts / (F.col("x1") - F.col("x0")))).cast("int")
    return both.withColumn("part", part).select("page_id", "box_id", "part", "y", "x", "v")


def padded_union(boxes: DataFrame, pad: int, height: int, width: int) -> DataFrame:
    """(page_id, y, x) of all cells of the picture in a box that is padded on all sides."""
    clip = lambda c, k, top: F.greatest(F.lit(0), F.least(F.lit(top), (F.col(c) + k).cast("int")))
    rows = boxes.select("page_id", F.explode(F.sequence(clip("y0", -pad, height), clip("y1", pad, height))).alias("y"), clip("x0", -pad, width).alias("a"), clip("x1", pad, width).alias("b"))
    return rows.where(F.col("y") < height).select("page_id", "y", F.explode(F.sequence("a", "b")).alias("x")).where(F.col("x") < width).distinct()
