"""Operators without a SQL twin against brute force, and hand-computed cases."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import components, etl, geometry, hough, matching, metrics, models, profile, seams, synthesis, tuning
from vellum.sources import labels, views
from vellum.streaming import runs


def profile_of(spark, *values):
    return spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "page_id bigint, y int, hpp int")


def test_constant_profile_is_zero(spark):
    p = profile_of(spark, 4, 4, 4)
    assert {r.z for r in profile.zscore(p).collect()} == {0.0} == {r.norm for r in profile.minmax(p).collect()}
    assert profile.regions(profile.zscore(p), F.col("z") > 0).count() == 0


def test_regions_merge_and_starts(spark):
    p = profile_of(spark, 5, 0, 5, 5, 0, 0, 0, 5)
    found = profile.regions(p, F.col("hpp") > 0)
    assert sorted((r.y0, r.y1) for r in found.collect()) == [(0, 0), (2, 3), (7, 7)]
    merged = profile.merge_regions(found, 1)
    assert sorted((r.y0, r.y1) for r in merged.collect()) == [(0, 3), (7, 7)]
    assert [r.y for r in profile.seam_starts(merged).collect()] == [5]
    one = profile.merge_regions(found, 9)
    assert profile.seam_starts(one).count() == 0
    assert [r.y0 for r in profile.drop_thin(one).collect()] == [0]


def test_shrink_keeps_the_middle(spark):
    found = spark.createDataFrame([(1, 0, 9), (1, 20, 20), (1, 30, 34)], "page_id bigint, y0 int, y1 int")
    assert sorted((r.y0, r.y1) for r in profile.shrink(found).collect()) == [(2, 6), (20, 20), (31, 32)]


def test_plateaus_need_both_neighbours(spark):
    p = profile_of(spark, 255, 0, 100, 100, 0, 5, 200).withColumnRenamed("hpp", "q")
    assert [(r.y0, r.y1, r.level) for r in profile.plateaus(p).collect()] == [(2, 3, 100)]
    low = profile_of(spark, 90, 100, 95, 200).withColumnRenamed("hpp", "q")
    assert profile.plateaus(low).count() == 0


def test_word_spans(spark):
    xs = [0, 1, 2, 10, 11, 12, 19, 40]
    cells = spark.createDataFrame([(1, 0, x) for x in xs], "page_id bigint, line int, x int")
    assert sorted((r.x0, r.x1) for r in profile.word_spans(cells).collect()) == [(0, 2), (10, 19)]


def flood(grid):
    seen, out = set(), []
    for y, x in zip(*np.nonzero(grid)):
        if (y, x) in seen:
            continue
        todo, mine = [(y, x)], set()
        while todo:
            p = todo.pop()
            if p in mine:
                continue
            mine.add(p)
            todo += [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if 0 <= p[0] + a < len(grid) and 0 <= p[1] + b < len(grid[0]) and grid[p[0] + a][p[1] + b]]
        seen |= mine
        ys, xs = [p[0] for p in mine], [p[1] for p in mine]
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(mine), round(float(np.mean(xs)), 9), round(float(np.mean(ys)), 9)))
    return out


def test_components_equal_flood_fill(spark):
    r = random.Random(1)
    rows, want = [], []
    for page in range(12):
        grid = [[r.random() < 0.1 + page * 0.05 for _ in range(14)] for _ in range(11)]
        rows += [(page, y, x) for y in range(11) for x in range(14) if grid[y][x]]
        want += [(page, i + 1, *c) for i, c in enumerate(flood(np.array(grid)))]
    found = components.components(spark.createDataFrame(rows, "page_id bigint, y int, x int"))
    got = [(c.page_id, c.comp_id, c.x, c.y, c.w, c.h, c.area, round(c.cx, 9), round(c.cy, 9)) for c in found.collect()]
    assert sorted(got) == sorted(want)
    cells = components.component_cells(spark.createDataFrame(rows, "page_id bigint, y int, x int"))
    assert cells.count() == len(rows)


def test_mode_takes_the_smallest(spark):
    found = spark.createDataFrame([(1, h) for h in (3, 3, 2, 2, 9)], "page_id bigint, h int")
    assert components.character_height(found).first().ah == 2
    assert components.character_height_mean(found).first().ah == 5
    same = spark.createDataFrame([(1, 4), (1, 4)], "page_id bigint, h int")
    assert components.character_height_mean(same).first().ah == 4


def test_least_paths_by_hand(spark):
    pages = spark.createDataFrame([(1, [[1.0, 2.0, 9.0], [3.0, 1.0, 1.0], [5.0, 9.0, 0.0]])], "page_id bigint, columns array<array<double>>")
    assert seams.least_paths(pages).first().costs == [7.0, 11.0, 2.0]


def paths(height, width):
    for start in range(height):
        for steps in itertools.product((-1, 0, 1), repeat=width - 1):
            ys = list(itertools.accumulate(steps, initial=start))
            if all(0 <= y < height for y in ys):
                yield ys


def test_search_is_optimal():
    r = random.Random(2)
    for _ in range(30):
        e = np.array([[r.randint(0, 5) for _ in range(5)] for _ in range(4)], float)
        blocked = np.array([[r.random() < 0.2 for _ in range(5)] for _ in range(4)])
        got = seams._search(e, blocked, 1, 0.5)
        free = np.flatnonzero(~blocked[:, 0])
        start = free[np.argmin(np.abs(free - 1))] if len(free) else None
        cost = lambda p: sum(e[y, x] for x, y in enumerate(p)) + 0.5 * sum(abs(a - b) for a, b in zip(p, p[1:]))  # noqa: B023, E731
        options = [cost(p) for p in paths(4, 5) if p[0] == start and not any(blocked[y, x] for x, y in enumerate(p))]
        assert (not got and not options) or cost(got) == min(options)


def test_trace_is_cheapest():
    e = np.array([[random.Random(3 * y + x).randint(0, 9) for x in range(6)] for y in range(4)], float)
    got = seams._trace(e, 2)
    assert sum(e[y, x] for x, y in enumerate(got)) == min(sum(e[y, x] for x, y in enumerate(p)) for p in paths(4, 6) if p[0] == 2)


def test_seams_and_classes(spark):
    cells = spark.createDataFrame([(1, y, x, float(y != 2)) for y in range(5) for x in range(6)], "page_id bigint, y int, x int, energy double")
    starts = spark.createDataFrame([(1, 1, 2)], "page_id bigint, seam_id int, y int")
    found = seams.seams(cells, starts)
    assert {r.y for r in found.collect()} == {2}
    ids = {(r.y): r.class_id for r in seams.classes(cells, found).collect()}
    assert ids == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2}
    assert seams.between(cells, found).where("y = 2").count() == 0
    assert {r.class_id for r in seams.classes(cells, found.limit(0)).collect()} == {1}
    walls = seams.blocked_rows(cells, spark.createDataFrame([(1, 2, 2)], "page_id bigint, y0 int, y1 int"), 0, 0)
    around = seams.seams(walls, starts, search=True)
    assert 2 not in {r.y for r in around.collect()} and around.count() == 6
    assert [(r.y0, r.y1) for r in seams.bands(found, 5).orderBy("band").collect()] == [(0, 2), (2, 5)]


def test_greedy_takes_the_first(spark):
    rows = [(1, 1, 1, 0.6), (1, 2, 1, 0.9), (1, 3, 2, 0.5), (1, 4, 2, 0.49), (2, 1, 1, 0.2)]
    pairs = spark.createDataFrame(rows, "page_id bigint, pred int, target int, iou double")
    preds = spark.createDataFrame([(1, i) for i in (1, 2, 3, 4)] + [(2, 1)], "page_id bigint, pred int")
    targets = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1)], "page_id bigint, target int")
    got = {r.page_id: (r.tp, r.fp, r.fn) for r in matching.greedy(preds, targets, pairs).collect()}
    assert got == {1: (2, 2, 0), 2: (0, 1, 1), 3: (0, 0, 1)}
    whole = metrics.micro(matching.greedy(preds, targets, pairs).where("page_id = 3")).first()
    assert (whole.precision, whole.recall, whole.hmean) == (0, 0, 0)


def test_greedy_equals_a_loop(spark):
    r = random.Random(4)
    rows = [(p, i, j, round(r.random(), 1)) for p in range(20) for i in range(5) for j in range(5) if r.random() < 0.7]
    pairs = spark.createDataFrame(rows, "page_id bigint, pred int, target int, iou double")
    sides = [spark.createDataFrame([(p, i) for p in range(20) for i in range(5)], f"page_id bigint, {c} int") for c in ("pred", "target")]
    want = {}
    for p in range(20):
        taken = set()
        for i in range(5):
            free = [(-k, j) for q, a, j, k in rows if (q, a) == (p, i) and j not in taken and k >= 0.5]
            if free:
                taken.add(min(free)[1])
        want[p] = (len(taken), 5 - len(taken), 5 - len(taken))
    assert {x.page_id: (x.tp, x.fp, x.fn) for x in matching.greedy(*sides, pairs).collect()} == want


@pytest.mark.parametrize("shape", [(3, 3), (2, 4), (4, 2), (1, 1)])
def test_assignment_is_optimal(shape):
    r = random.Random(5)
    for _ in range(20):
        cost = np.array([[r.random() for _ in range(shape[1])] for _ in range(shape[0])])
        got = matching.assignment(cost)
        big, small = (shape[1], shape[0]) if shape[0] <= shape[1] else shape
        table = cost if shape[0] <= shape[1] else cost.T
        best = min(sum(table[i, p[i]] for i in range(small)) for p in itertools.permutations(range(big), small))
        assert len(got) == small and math.isclose(sum(cost[a, b] for a, b in got), best)


def test_rectangle_and_clip():
    r = random.Random(6)
    for _ in range(20):
        points = np.array([[r.randint(0, 20), r.randint(0, 20)] for _ in range(12)], float)
        box = geometry.smallest_rectangle(points)
        area = abs(geometry._signed(box))
        for angle in np.linspace(0, math.pi / 2, 400):
            u, v = np.array([math.cos(angle), math.sin(angle)]), np.array([-math.sin(angle), math.cos(angle)])
            assert area <= (np.ptp(points @ u)) * (np.ptp(points @ v)) + 1e-6
    square = lambda x, y, s: np.array([[x, y], [x + s, y], [x + s, y + s], [x, y + s]], float)
    assert math.isclose(geometry.polygon_iou(square(0, 0, 2), square(1, 1, 2)), 1 / 7)
    assert math.isclose(geometry.polygon_iou(square(0, 0, 2)[::-1], square(0, 0, 2)), 1)
    assert geometry.polygon_iou(square(0, 0, 1), square(5, 5, 1)) == 0


def test_box_pairs_cross_bands(spark):
    cols = "page_id bigint, box_id int, x0 double, y0 double, x1 double, y1 double"
    a = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 200.0), (1, 2, 20.0, 63.5, 30.0, 64.5)], cols)
    got = {(r.pred, r.target): round(r.iou, 6) for r in geometry.box_pairs(a, a).collect()}
    assert got == {(1, 1): 1.0, (2, 2): 1.0}


def test_hough_finds_drawn_lines(spark):
    points, n = [], 0
    for line, (y, t) in enumerate([(20, 90), (60, 90), (100, 88)]):
        for c in range(4):
            for b in range(5):
                x = c * 40 + b * 6
                points.append((1, n, line * 10 + c, float(x), float(y) - (x / math.tan(math.radians(t)) if t != 90 else 0)))
                n += 1
    found = hough.text_lines(spark.createDataFrame(points, "page_id bigint, point_id int, comp_id int, x double, y double"), 200, 200, 2.0, radius=2)
    got = sorted((round(r.theta), len(r.comp_ids)) for r in found.collect())
    assert got == [(88, 4), (90, 4), (90, 4)]


def test_line_formulas(spark):
    one = spark.createDataFrame([(1, x, 2 * x + 3) for x in range(5)], "page_id bigint, x int, y int")
    r = hough.fitted(one, "page_id").first()
    y = spark.range(1).select(hough.y_on_line(F.lit(r.rho), F.lit(math.radians(r.theta)), F.lit(10.0))).first()[0]
    assert math.isclose(y, 23, abs_tol=1e-9)
    lines = spark.createDataFrame([(1, i, y) for i, y in enumerate((0.0, 10.0, 12.0, 22.0))], "page_id bigint, line_id int, y_mid double")
    assert sorted((x.line_id, x.n) for x in hough.merge_lines(lines).collect()) == [(0, 1), (1, 2), (3, 1)]


def test_monotone_and_tall(spark):
    rows = spark.createDataFrame([(1, 0, i, c) for i, c in enumerate((0.0, 5.0, 1.0, 2.0))], "page_id bigint, x int, y int, c double")
    assert [r.m for r in geometry.monotone(rows, 1.0).orderBy("y").collect()] == [0.0, 5.0, 6.0, 7.0]
    boxes = spark.createDataFrame([(1, 1, 0.0, 4.0, 2.0), (1, 2, 10.0, 14.0, 12.0), (1, 3, 20.0, 36.0, 22.0)], "page_id bigint, box_id int, y0 double, y1 double, mass double")
    got = {r.box_id: (r.n0, r.n1) for r in geometry.crop_tall(boxes).collect()}
    assert got == {1: (0, 4), 2: (10, 14), 3: (20, 28)}


def test_empty_masks_and_classes(spark):
    cells = spark.createDataFrame([(1, False, False)], "page_id bigint, a boolean, b boolean")
    assert metrics.mask_overlap(cells, F.col("a"), F.col("b"), "page_id").first().iou == 1
    assert metrics.mask_overlap(cells, F.col("a"), F.col("b"), "page_id", empty=0.0).first().iou == 0
    none = metrics.runtime_summary(spark.createDataFrame([], "sec double"), "sec").first()
    assert (none.n, none.total, none.median) == (0, 0.0, 0.0)


def test_labels(spark, tmp_path):
    text = ["a/1.jpg\t" + json.dumps([{"points": [[0, 0], [1, 0], [1, 1]]}, {"points": [[0, 0], [1, 1]]}, {"points": [[0, 0], [2, 0], [2, 2]], "score": 0.2}]), "", "no tab", "b\t{bad", "c\t5", "d\t[]"]
    (tmp_path / "l.txt").write_text("\n".join(text))
    got = {r.path: len(r.polygons) for r in labels.read_labels(spark, str(tmp_path / "l.txt")).collect()}
    assert got["a/1.jpg"] == 2 and got["d"] == 0 and not {"", "no tab", "b"} & {k for k, v in got.items() if v}
    strict = labels.read_labels(spark, str(tmp_path / "l.txt"), least_score=0.5)
    assert {r.path: len(r.polygons) for r in strict.collect()}["a/1.jpg"] == 1
    (tmp_path / "s1.txt").write_text("x\n\ny\n")
    (tmp_path / "s2.txt").write_text("y\nz\nx\n")
    rows = labels.read_split(spark, str(tmp_path / "s1.txt"), str(tmp_path / "s2.txt")).orderBy("ordinal").collect()
    assert [r.path for r in rows] == ["x", "y", "z"]


def test_yolo_and_coco(spark, tmp_path):
    lines = spark.createDataFrame([("0 0 0 0.5 0.5 1 2",), ("0 0 0 1 1",), ("0 0 0 1 1 1",), ("1 0.1 0.1 0.2 0.2 0.3 0.3 0.4",)], "value string")
    got = labels.yolo_polygons(lines, F.lit(100.0), F.lit(50.0)).collect()
    assert [[tuple(p) for p in r.points] for r in got] == [[(0, 0), (50, 25), (99, 49)]]
    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "a", "width": 9, "height": 9}], "annotations": [
        {"image_id": 1, "category_id": 0, "segmentation": [[0, 0, 4, 0, 4, 4], [1, 1]], "attributes": {"translation": "t"}}, {"image_id": 1, "category_id": 3, "segmentation": []}]}))
    images, annotations = labels.read_coco(spark, str(tmp_path / "c.json"))
    assert images.count() == 1 and annotations.count() == 2
    rings = labels.rings(annotations, [0, 1, 2]).collect()
    assert [[tuple(p) for p in r.points] for r in rings] == [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)]]


def test_paths(spark):
    wanted = spark.createDataFrame([("p/a.png.jpg",), ("q/b.jpg",), ("c.jpg",)], "path string")
    files = spark.createDataFrame([("p/a.png",), ("z/b.jpeg",)], "file string")
    assert {r.path: r.file for r in labels.resolved(wanted, files).collect()} == {"p/a.png.jpg": "p/a.png", "q/b.jpg": "z/b.jpeg", "c.jpg": None}


def test_etl(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "file string, score double")
    b = spark.createDataFrame([("x", 3.0)], "file string, score double")
    assert {r.file: r.score for r in etl.best_of_each([a, b], "file", "score").collect()} == {"x": 3.0, "y": 2.0}
    assert [r.file for r in etl.pending(a, b, "file").collect()] == ["y"]
    parts = etl.split(spark.range(5000), "id", {"train": 85, "valid": 10, "test": 5}).groupBy("part").count().collect()
    shares = {r.part: r["count"] / 5000 for r in parts}
    assert abs(shares["train"] - 0.85) < 0.03 and abs(shares["valid"] - 0.1) < 0.02


def test_tuning(spark):
    assert tuning.grid(spark, a=[1, 2], b=[3]).count() == 2
    scores = spark.createDataFrame([(0, 0.5), (1, 0.9), (2, 0.9)], "trial int, hmean double")
    assert tuning.best_trial(scores).first().trial == 1
    rows = spark.createDataFrame([([float(i), 0.0], float(i)) for i in range(30)], "v array<float>, t double")
    fitted = tuning.fit_regressors(rows, "v", ["t"], rounds=3, depth=2, rate=0.5)
    got = tuning.predict_settings(rows, "v", fitted, {"t": (5.0, 20.0)}).agg(F.min("t"), F.max("t")).first()
    assert got[0] >= 5 and got[1] <= 20


def test_two_means_and_threshold(spark):
    rows = spark.createDataFrame([(1, v) for v in (1.0, 2.0, 1.0, 50.0, 52.0)], "page_id bigint, v double")
    r = geometry.two_means(rows, "v", "page_id").first()
    assert (r.n_low, r.n_high) == (3, 2) and r.high == 51
    cut = components.between_class_threshold(rows.withColumnRenamed("v", "distance")).first()
    assert cut.threshold == 2.0
    one = components.between_class_threshold(rows.limit(1).withColumnRenamed("v", "distance")).first()
    assert one.threshold == 1.0


def test_synthesis_repeats(spark):
    a, b = synthesis.pages(spark, 3), synthesis.pages(spark, 3)
    assert a.exceptAll(b).count() == 0 and a.select("page_id").distinct().count() == 3
    ink = a.select("page_id", "y", "x").distinct()
    for kind in synthesis.KINDS:
        back = synthesis.straightened(synthesis.distorted(ink, kind, 256, 320), kind, 256, 320)
        assert back.join(ink, ["page_id", "y", "x"]).count() >= 0.9 * ink.count()


def test_threshold_binariser(spark):
    picture = np.full((6, 8, 3), 230, np.uint8)
    picture[2, 3:6] = 20
    images = spark.createDataFrame([("p", 6, 8, 3, bytearray(picture.tobytes()))], "path string, height int, width int, channels int, data binary")
    assert sorted((r.y, r.x) for r in models.binarised(images).collect()) == [(2, 3), (2, 4), (2, 5)]
    blank = spark.createDataFrame([("p", 1, 2, 1, bytearray(b"\x07\x07"))], "path string, height int, width int, channels int, data binary")
    assert models.binarised(blank).count() == 0


def test_views_agree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert views.page_ink(docs).count() == views.page_lines(docs).agg(F.sum("hpp")).first()[0]


def test_streams(spark, tmp_path):
    schema = "file string, sec double, at timestamp"
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 3.0)], "file string, sec double").withColumn("at", F.lit("2024-01-01 00:00:01").cast("timestamp"))
    labels.append_rows(rows.coalesce(1), log)
    run = lambda: runs.append(runs.new_rows(runs.log(spark, log, schema), "file", "at"), out, str(tmp_path / "cp")).awaitTermination()
    run()
    assert sorted(r.file for r in spark.read.parquet(out).collect()) == ["a", "b"]
    labels.append_rows(rows.where("file = 'a'").withColumn("file", F.lit("c")).limit(1), log)
    run()
    assert sorted(r.file for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    assert runs.running(runs.log(spark, log, schema), "at").isStreaming


def test_side_noise_is_cut(spark):
    schema = "page_id bigint, box_id int, x0 double, x1 double"
    rows = [(1, i, 400.0, 420.0) for i in range(9)] + [(1, 9, 10.0, 420.0)]
    got = {r.box_id: (r.n0, r.n1) for r in geometry.side_noise(spark.createDataFrame(rows, schema)).collect()}
    cut = (10 + (9 * 400 + 10 * 420) / 19) / 2  # one of 20 midpoints is on the left
    assert got[0] == (400, 420) and math.isclose(got[9][0], cut) and got[9][1] == 420
    halves = [(1, 0, 0.0, 1000.0)] + [(1, i, 100.0, 1000.0) for i in range(1, 10)]
    assert {(r.n0, r.n1) for r in geometry.side_noise(spark.createDataFrame(halves, schema)).collect()} == {(0, 1000), (100, 1000)}


def test_far_points_have_neighbours(spark):
    points = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 4.0), (1, 2, 60.0, 0.0), (1, 3, 5000.0, 0.0), (2, 0, 1.0, 1.0)], "page_id bigint, comp_id int, cx double, cy double")
    got = {(r.page_id, r.comp_id): (r.other, r.distance) for r in components.nearest(points, 6.0).collect()}
    assert got == {(1, 0): (1, 5), (1, 1): (0, 5), (1, 2): (1, math.hypot(57, 4)), (1, 3): (2, 4940)}
    cells = lambda *c: spark.createDataFrame([(p, y, x) for p, y, x in c], "page_id bigint, y int, x int")
    far = metrics.chamfer(cells((1, 0, 0), (2, 0, 0)), cells((1, 0, 40), (3, 1, 1)), 3.0, 50.0)
    assert {r.page_id: r.chamfer for r in far.collect()} == {1: 40, 2: 50, 3: 50}


def test_classes_go_on_without_gaps(spark):
    cells = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 0, 5), (1, 1, 1, 5), (2, 0, 0, 1)], "page_id bigint, y int, x int, class_id int")
    assert sorted((r.page_id, r.y, r.class_id) for r in seams.consecutive(cells).collect()) == [(1, 0, 1), (1, 1, 2), (1, 1, 2), (2, 0, 1)]


def test_local_warp_straightens_a_slope(spark):
    from vellum.operators import rectify

    t = math.tan(math.radians(5))
    rows = [(1, round(30 + k * 20 + (x - 60) * t), x) for k in range(3) for x in range(120)]
    ink = spark.createDataFrame(rows, "page_id bigint, y int, x int")
    angles = rectify.cell_angles(ink, [float(a) for a in range(-8, 9)], 2, 2, 100, 120)
    assert {r.angle for r in angles.collect()} == {5.0}
    moved = rectify.straightened(ink, angles, 2, 2, 100, 120)
    heights = moved.groupBy("y").count().where("count > 30").count()
    assert heights <= 6 < ink.select("y").distinct().count()
    assert moved.join(ink.withColumnsRenamed({"y": "iy", "x": "ix"}), ["page_id", "iy", "ix"], "left_anti").count() == 0


def test_running_means_and_anchors(spark):
    rows = spark.createDataFrame([(1, i, y) for i, y in enumerate((0.0, 2.0, 4.0, 20.0, 21.0))], "page_id bigint, comp_id int, y double")
    got = [(r.group, r["mean"], r.comp_ids) for r in hough.mean_groups(rows, 3.0).orderBy("group").collect()]
    assert got == [(0, 2.0, [0, 1, 2]), (1, 20.5, [3, 4])]
    lines = rows.selectExpr("page_id", "comp_id as line_id", "y as y_mid", "3.0d as most")
    assert sorted((r.line_id, r.n) for r in hough.anchored_groups(lines, F.col("most")).collect()) == [(0, 2), (2, 1), (3, 2)]


def test_small_helpers(spark):
    cells = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 0, 0), (1, 2, 0, 1)], "page_id bigint, comp_id int, y int, x int")
    assert components.without_small(cells, 2).count() == 2
    boxes = spark.createDataFrame([(0.0, 40.0), (0.0, 60.0), (55.0, 90.0)], "x0 double, x1 double")
    assert geometry.straddling(boxes, F.lit(100.0)).count() == 1
    one = spark.range(1).select(metrics.f_beta(F.lit(0.5), F.lit(1.0)).alias("f"), metrics.chamfer_score(F.lit(5.0), 5.0).alias("c"), metrics.f_beta(F.lit(0.0), F.lit(0.0)).alias("z")).first()
    assert math.isclose(one.f, 2 / 3) and one.c == 0.5 and one.z == 0


def test_detectors_find_generated_lines(spark):
    from vellum.operators import detectors

    made = synthesis.pages(spark, 6, width=160, height=200, lines=(5, 9)).cache()
    ink = made.select("page_id", "y", "x").distinct()
    targets = made.groupBy("page_id", F.col("line_id").cast("bigint").alias("box_id")).agg(
        F.min("x").cast("double").alias("x0"), F.min("y").cast("double").alias("y0"), (F.max("x") + 1).cast("double").alias("x1"), (F.max("y") + 1).cast("double").alias("y1")
    )
    for boxes in (detectors.by_profile(ink, 200, 160), detectors.by_two_kernels(ink, 200, 160, 5, 3, tall=9.0)):
        r = detectors.evaluated(boxes, targets).first()
        assert r.hmean > 0.9, r
    r = detectors.evaluated(detectors.by_hough(ink, 200, 160, fraction=0.3, radius=3), targets).first()
    assert r.recall > 0.5, r
    assert detectors.evaluated(targets.limit(0), targets).first().recall == 0
    assert detectors.deskewed(ink, 200, 160).count() > 0


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString(), frame._jdf.queryExecution().executedPlan().toString()


def test_nearest_words_without_a_shuffle(spark):
    from vellum.plans import layout

    texts = [(1, "ab  c\n\nüü 😀\tx\n" + " " * 70 + "far"), (2, None), (3, ""), (4, "one"), (None, "a b"), (5, "\n".join(" " * (i % 7) + "a bb" * (i % 3) + " c" for i in range(40)))]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = layout.nearest_component(docs)
    points = layout.words(docs).select("page_id", (F.col("y") * 100000 + F.col("x")).alias("comp_id"), (F.col("x") + F.col("w") / 2).alias("cx"), (8.0 * F.col("y")).alias("cy"))
    want = components.nearest(points, 12.0).where("page_id is not null").select("page_id", "comp_id", F.round("distance", 6).alias("distance"))
    assert sorted(got.collect()) == sorted(want.collect())
    assert "Exchange" not in _plan(got)[1]


def test_nearest_places_by_all_pairs():
    rng = np.random.default_rng(3)
    for t in range(60):
        n = int(rng.integers(0, 40))
        page, ids = rng.integers(0, 3, n), rng.integers(0, 12, n) if t % 2 else rng.permutation(n)
        x, y = rng.integers(0, 3 + 40 * (t % 3), n) / 2, rng.integers(0, 3 + 9 * (t % 4), n) * 1.0
        want = {}
        for i in range(n):
            pairs = [(math.sqrt((x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2), int(ids[j])) for j in range(n) if page[j] == page[i] and ids[j] != ids[i]]
            if pairs:
                key = int(page[i]), int(ids[i])
                want[key] = min([*pairs, want.get(key, (math.inf, 0))])
        place, other, distance = components.nearest_places(page, ids, x, y)
        assert {(int(page[p]), int(ids[p])): (float(d), int(o)) for p, o, d in zip(place, other, distance)} == want and len(place) == len(want)


def test_threshold_makes_its_values_once(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 1.0), (1, 50.0), (1, 52.0), (2, 4.0), (2, 4.0)], "page_id bigint, distance double")
    found = components.between_class_threshold(rows.withColumn("distance", F.col("distance") + 0))
    assert {r.page_id: r.threshold for r in found.collect()} == {1: 2.0, 2: 4.0}
    assert "Join" not in _plan(found)[0]


def test_axes_of_parts_in_any_order(spark):
    cells = [(y, x) for y in range(6) for x in range(9) if (x * y) % 4 < 2]
    mixed = random.Random(1).sample(cells, len(cells))
    rows = [(1, cells), (2, mixed[:7]), (2, mixed[7:]), (3, [(0, 0)]), (4, [(0, 5), (0, 1)])]
    found = geometry.axes(spark.createDataFrame(rows, "page_id bigint, cells array<struct<y: int, x: int>>").repartition(3), "page_id")
    got = {r.page_id: (r.n, r.angle) for r in found.collect()}
    assert got[1] == got[2] and got[1][0] == len(cells) and got[3] == (1, None) and got[4] == (2, 0.0)
    x, y = np.array(cells)[:, 1], np.array(cells)[:, 0]
    xy = np.cov(x, y)
    assert math.isclose(got[1][1], math.atan2(2 * xy[0, 1], xy[0, 0] - xy[1, 1]) / 2)
