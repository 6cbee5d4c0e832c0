"""Text-line detectors end to end: ink in, one box per line out.

A page's ink, regions and seam starts meet in one row, where the seams are found; all other
steps are windows and aggregates over pages. Pages without regions or seams keep all their ink as
one line, and no page affects another.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import components, geometry, hough, matching, metrics, profile, rectify, seams


def row_profile(ink: DataFrame, height: int) -> DataFrame:
    """(page_id, y, hpp) for every row of a page with ink, zeros included."""
    counts = ink.groupBy("page_id", "y").agg(F.count("*").alias("hpp"))
    every = ink.select("page_id").distinct().select("page_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    return every.join(counts, ["page_id", "y"], "left").select("page_id", "y", F.coalesce("hpp", F.lit(0)).alias("hpp"))


def page_seams(ink: DataFrame, regions: DataFrame, starts: DataFrame, height: int, width: int, search: bool, drift: float = 2.0) -> DataFrame:
    """(page_id, seam_id, x, y): seams through an energy of ink and regions. With `search`,
    regions are walls; else they are dear."""
    marks = ink.groupBy("page_id").agg(F.collect_list(F.struct("y", "x")).alias("ink"))
    zones = regions.groupBy("page_id").agg(F.collect_list(F.struct("y0", "y1")).alias("regions"))
    seeds = starts.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("seam_id", "y"))).alias("starts"))
    rows = marks.join(seeds, "page_id").join(zones, "page_id")

    def run(batches):
        for batch in batches:
            out = []
            for p in batch.itertuples(index=False):
                energy = np.zeros((height, width))
                energy[[c["y"] for c in p.ink], [c["x"] for c in p.ink]] = 255
                walls = np.zeros((height, width), bool)
                for r in p.regions:
                    walls[r["y0"] : r["y1"] + 1] = True
                for s in p.starts:
                    path = seams._search(energy, walls, s["y"], drift) if search else seams._trace(energy + 255 * walls, s["y"])
                    out += [(p.page_id, s["seam_id"], x, y) for x, y in enumerate(path)]
            yield pd.DataFrame(out, columns=["page_id", "seam_id", "x", "y"])

    return rows.mapInPandas(run, "page_id bigint, seam_id int, x int, y int")


def _boxes(ink: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """One box per class of `least` cells or more, numbered from the top of the page."""
    sized = seams.class_boxes(seams.classes(ink, found)).where(F.col("n") >= least)
    return sized.select("page_id", F.col("class_id").cast("bigint").alias("box_id"), F.col("x0").cast("double").alias("x0"), F.col("y0").cast("double").alias("y0"), (F.col("x1") + 1).cast("double").alias("x1"), (F.col("y1") + 1).cast("double").alias("y1"))


def by_profile(ink: DataFrame, height: int, width: int, z: float = 0.0, gap: int = 0, least_height: int = 1, least: int = 3) -> DataFrame:
    """Rows whose z-score is above z, merged over small gaps, with a traced seam between
    neighbours."""
    scored = profile.zscore(row_profile(ink, height))
    regions = profile.merge_regions(profile.regions(scored, F.col("z") > z, least_height), gap)
    found = page_seams(ink, regions, profile.seam_starts(regions), height, width, False)
    return _boxes(ink, found, least)


def by_two_kernels(ink: DataFrame, height: int, width: int, k1: int, k2: int, least: int = 3, tall: float = 1.2) -> DataFrame:
    """Plateaus of the profile smoothed by the better of two kernels, shrunk to their middles,
    seams searched around them, and tall boxes cropped towards their ink."""
    found = profile.two_kernels(row_profile(ink, height), k1, k2).select("page_id", "y0", "y1")
    regions = profile.shrink(found)
    lines = page_seams(ink, regions, profile.seam_starts(regions), height, width, True)
    parted = seams.classes(ink, lines)
    mass = parted.groupBy("page_id", F.col("class_id").cast("bigint").alias("box_id")).agg(F.avg(F.col("y") + 0.5).alias("mass"))
    cropped = geometry.crop_tall(_boxes(ink, lines, least).join(mass, ["page_id", "box_id"]), tall)
    return cropped.select("page_id", "box_id", "x0", F.col("n0").alias("y0"), "x1", F.col("n1").alias("y1"))


def by_hough(ink: DataFrame, height: int, width: int, block: int = 8, step: float = 2.0, **options) -> DataFrame:
    """Votes of block centres of all components; every component goes whole to the nearest line."""
    found = components.components(ink)
    cells = components.component_cells(ink)
    centres = components.block_centres(cells, F.lit(block))
    order = profile.by("page_id").orderBy("comp_id", "block")
    points = centres.select("page_id", F.row_number().over(order).alias("point_id"), "comp_id", F.col("cx").alias("x"), F.col("cy").alias("y"))
    lines = hough.text_lines(points, width, height, step, **options)
    owner = hough.nearest_line(found.select("page_id", "comp_id", F.col("cx").alias("x"), F.col("cy").alias("y")), lines)
    sized = found.join(owner, ["page_id", "comp_id"]).groupBy("page_id", F.col("line_id").cast("bigint").alias("box_id"))
    return sized.agg(F.min("x").cast("double").alias("x0"), F.min("y").cast("double").alias("y0"), F.max(F.col("x") + F.col("w")).cast("double").alias("x1"), F.max(F.col("y") + F.col("h")).cast("double").alias("y1"))


def deskewed(ink: DataFrame, height: int, width: int, rows: int = 3, cols: int = 3, angles: tuple = tuple(range(-8, 9))) -> DataFrame:
    """ink after a local deskew, with its source place (iy, ix)."""
    found = rectify.cell_angles(ink, list(map(float, angles)), rows, cols, height, width)
    return rectify.straightened(ink, found, rows, cols, height, width)


def evaluated(boxes: DataFrame, targets: DataFrame, least: float = 0.5) -> DataFrame:
    """Micro-averaged figures of boxes against targets; a page without boxes counts as missed."""
    pairs = geometry.box_pairs(boxes, targets)
    counts = matching.greedy(boxes.select("page_id", F.col("box_id").alias("pred")), targets.select("page_id", F.col("box_id").alias("target")), pairs, least)
    return metrics.micro(counts)
