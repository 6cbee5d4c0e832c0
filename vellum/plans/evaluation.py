"""Queries over boxes, classes, runs and datasets: matching, metrics, ETL, tuning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import etl, geometry, matching, metrics, profile, tuning
from vellum.plans.collect import collector
from vellum.plans.layout import ink, lines, z_regions
from vellum.plans.sql import BOX, PAGE_LINE, TILE, ZREGION
from vellum.sources import labels, views

QUERIES, ORACLES, query = collector()


# --- boxes and matching: line boxes are the targets, the same boxes moved and cut the predictions

_PAIRS = f"""{BOX}, pred AS (SELECT page_id, box_id, x0 + box_id % 5 AS x0, y0 + CASE WHEN box_id % 7 = 3 THEN 0.6 ELSE 0.1 END AS y0, x1 - box_id % 3 + box_id % 5 AS x1, y1 + CASE WHEN box_id % 7 = 3 THEN 0.6 ELSE 0.1 END AS y1 FROM box WHERE box_id % 11 <> 10),
raw AS (SELECT p.page_id, p.box_id AS pred, t.box_id AS target, greatest(0, least(p.x1, t.x1) - greatest(p.x0, t.x0)) * greatest(0, least(p.y1, t.y1) - greatest(p.y0, t.y0)) AS i, (p.x1 - p.x0) * (p.y1 - p.y0) AS a, (t.x1 - t.x0) * (t.y1 - t.y0) AS b FROM pred p JOIN box t ON t.page_id = p.page_id AND t.box_id BETWEEN p.box_id - 1 AND p.box_id + 2),
pairs AS (SELECT page_id, pred, target, round(i / (a + b - i), 9) AS iou FROM raw WHERE i > 0 AND a > 0)"""


def predictions(docs: DataFrame) -> DataFrame:
    k = F.col("box_id")
    move = F.when(k % 7 == 3, 0.6).otherwise(0.1)
    return views.line_boxes(docs).where(k % 11 != 10).select("page_id", "box_id", (F.col("x0") + k % 5).alias("x0"), (F.col("y0") + move).alias("y0"), (F.col("x1") - k % 3 + k % 5).alias("x1"), (F.col("y1") + move).alias("y1"))


def pairs(docs: DataFrame) -> DataFrame:
    return geometry.box_pairs(predictions(docs), views.line_boxes(docs)).withColumn("iou", F.round("iou", 9))


@query(f"WITH {_PAIRS} SELECT page_id, pred, target, round(iou, 6) AS iou FROM pairs")
def bbox_iou_pairs(docs):
    return pairs(docs).withColumn("iou", F.round("iou", 6))


@query(f"WITH {_PAIRS} SELECT page_id, pred, arg_min(target, (-iou, target)) AS target, round(max(iou), 6) AS iou FROM pairs GROUP BY 1, 2")
def best_overlap_assign(docs):
    return matching.best_target(pairs(docs)).withColumn("iou", F.round("iou", 6))


@query(f"WITH {_PAIRS} SELECT page_id, pred, target, round(iou, 6) AS iou, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY iou DESC, pred, target) AS rank FROM pairs) WHERE rank <= 10")
def top_matched_pairs(docs):
    return matching.top_pairs(pairs(docs)).withColumn("iou", F.round("iou", 6))


def _counts(docs):
    preds, targets = predictions(docs).select("page_id", F.col("box_id").alias("pred")), views.line_boxes(docs).select("page_id", F.col("box_id").alias("target"))
    return matching.greedy(preds, targets, pairs(docs))


@query()
def greedy_match(docs):
    """No SQL twin: each prediction's choice depends on those before. Tested against a loop."""
    return _counts(docs)


@query()
def hungarian_match(docs):
    """No SQL twin: an optimal assignment. Tested against all permutations."""
    return matching.optimal(pairs(docs), 0.3).groupBy("page_id").agg(F.count("*").alias("n"), F.round(F.sum("iou"), 6).alias("iou"))


@query(
    f"""WITH {_PAIRS}, g AS (SELECT page_id, pred FROM pairs WHERE iou >= 0.5 GROUP BY 1, 2), p AS (SELECT page_id, count(*) AS p FROM pred GROUP BY 1), t AS (SELECT page_id, count(*) AS t FROM box GROUP BY 1), m AS (SELECT page_id, count(*) AS tp FROM g GROUP BY 1),
c AS (SELECT coalesce(m.tp, 0) AS tp, coalesce(p.p, 0) - coalesce(m.tp, 0) AS fp, t.t - coalesce(m.tp, 0) AS fn FROM t LEFT JOIN p USING (page_id) LEFT JOIN m USING (page_id)),
s AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM c), r AS (SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS q FROM s)
SELECT tp, fp, fn, round(p, 6) AS precision, round(q, 6) AS recall, round(2 * p * q / greatest(p + q, 1e-9), 6) AS hmean FROM r"""
)
def micro_prf(docs):
    """Here no two predictions want one target at 0.5, so SQL can count what greedy matching finds."""
    found = metrics.micro(_counts(docs))
    return found.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "hmean")])


@query(
    f"""WITH {_PAIRS}, g AS (SELECT page_id, count(DISTINCT pred) AS tp FROM pairs WHERE iou >= 0.5 GROUP BY 1), p AS (SELECT page_id, count(*) AS p FROM pred GROUP BY 1), t AS (SELECT page_id, count(*) AS t FROM box GROUP BY 1),
c AS (SELECT page_id, coalesce(tp, 0) AS tp, coalesce(p, 0) AS p, t FROM t LEFT JOIN p USING (page_id) LEFT JOIN g USING (page_id)),
l AS (SELECT 'precision' AS metric, tp / greatest(p, 1) AS v FROM c UNION ALL SELECT 'recall', tp / greatest(t, 1) FROM c)
SELECT metric, round(avg(v), 6) AS value, count(*) AS n FROM l GROUP BY 1"""
)
def macro_metric_mean(docs):
    c = _counts(docs)
    p, r = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    long = c.select(F.explode(F.array(F.struct(F.lit("precision").alias("metric"), p.alias("value")), F.struct(F.lit("recall").alias("metric"), r.alias("value")))).alias("m")).select("m.*")
    return metrics.macro(long).withColumn("value", F.round("value", 6))


# --- class metrics

_CONF = "c AS (SELECT quality AS pred, toxic AS target, count(*) AS n FROM labels GROUP BY 1, 2)"


def _confusion(rows):
    return metrics.confusion(rows, "quality", "toxic")


@query(
    f"""WITH {_CONF}, k AS (SELECT pred AS class FROM c UNION SELECT target FROM c), s AS (SELECT class, coalesce((SELECT sum(n) FROM c WHERE pred = class AND target = class), 0) AS tp, coalesce((SELECT sum(n) FROM c WHERE pred = class AND target <> class), 0) AS fp, coalesce((SELECT sum(n) FROM c WHERE pred <> class AND target = class), 0) AS fn FROM k),
r AS (SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS q FROM s)
SELECT class, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(p, 6) AS precision, round(q, 6) AS recall, round(2 * p * q / greatest(p + q, 1e-9), 6) AS f1, round(CASE WHEN tp + fp + fn = 0 THEN 1 ELSE tp / (tp + fp + fn) END, 6) AS iou FROM r""",
    "labels",
)
def per_class_prf_iou(rows):
    found = metrics.per_class(_confusion(rows))
    return found.select("class", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "iou")])


@query(f"WITH {_CONF} SELECT round(sum(CASE WHEN pred = target THEN n * -ln(0.999) ELSE n * -ln(greatest(1e-9, 0.001 / greatest(1, (SELECT max(greatest(pred, target)) FROM c)))) END) / sum(n), 6) AS cross_entropy FROM c", "labels")
def cross_entropy(rows):
    return metrics.cross_entropy(_confusion(rows)).select(F.round("cross_entropy", 6).alias("cross_entropy"))


_TWO = f"{TILE}, two AS (SELECT tile_id AS page_id, y, x, v > 0 AS a, v > 0.05 OR (x + y) % 5 = 0 AS b FROM tile)"


def _two(vecs):
    return views.tiles(vecs).select(F.col("tile_id").alias("page_id"), "y", "x", (F.col("v") > 0).alias("a"), ((F.col("v") > 0.05) | ((F.col("x") + F.col("y")) % 5 == 0)).alias("b"))


@query(f"WITH {_TWO}, s AS (SELECT page_id, count(*) FILTER (a AND b) AS i, count(*) FILTER (a OR b) AS u, count(*) FILTER (a) AS p, count(*) FILTER (b) AS q FROM two GROUP BY 1) SELECT page_id, i AS inter, u AS union, round(CASE WHEN u = 0 THEN 1 ELSE i / u END, 6) AS iou, round(CASE WHEN p + q = 0 THEN 1 ELSE 2 * i / (p + q) END, 6) AS dice FROM s".replace("AS union", 'AS "union"'), "embeddings")
def text_iou_dice(vecs):
    found = metrics.mask_overlap(_two(vecs), F.col("a"), F.col("b"), "page_id")
    return found.withColumns({"iou": F.round("iou", 6), "dice": F.round("dice", 6)})


@query(
    f"""WITH {_TWO}, j AS (SELECT p.page_id, q.y - p.y AS dy, q.x - p.x AS dx, count(*) AS n FROM two p JOIN two q ON p.page_id = q.page_id AND p.a AND q.b AND abs(q.y - p.y) <= 2 AND abs(q.x - p.x) <= 2 GROUP BY 1, 2, 3)
SELECT page_id, dy, dx, n FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, dy, dx) AS k FROM j) WHERE k = 1""",
    "embeddings",
)
def best_shift_overlap(vecs):
    two = _two(vecs)
    return metrics.best_shift(two.where("a").select("page_id", "y", "x"), two.where("b").select("page_id", "y", "x"), 2)


@query(
    f"""WITH {_TWO}, p AS (SELECT page_id, x, avg(y) AS a FROM two WHERE a GROUP BY 1, 2), q AS (SELECT page_id, x, avg(y) AS b FROM two WHERE b GROUP BY 1, 2)
SELECT page_id, round(avg(abs(a - b)), 6) AS mae, round(stddev_pop(a - b), 6) AS std, count(*) AS columns FROM p JOIN q USING (page_id, x) GROUP BY 1 HAVING count(*) >= 5""",
    "embeddings",
)
def centerline_mae(vecs):
    two = _two(vecs)
    found = metrics.centerline_error(two.where("a").select("page_id", "x", "y"), two.where("b").select("page_id", "x", "y"))
    return found.select("page_id", F.round("mae", 6).alias("mae"), F.round("std", 6).alias("std"), "columns")


@query(
    f"""WITH {_TWO}, c AS (SELECT page_id, CASE WHEN a THEN 1 + CAST(y > 3 AS INTEGER) ELSE 0 END AS pred, CASE WHEN b THEN 1 + CAST(y > 4 AS INTEGER) ELSE 0 END AS target FROM two), n AS (SELECT page_id, pred, target, count(*) AS n FROM c GROUP BY 1, 2, 3),
s AS (SELECT *, sum(n) OVER (PARTITION BY page_id, pred) AS p, sum(n) OVER (PARTITION BY page_id, target) AS t FROM n)
SELECT page_id, pred, target, round(n / (p + t - n), 6) AS iou FROM s WHERE pred > 0 AND target > 0""",
    "embeddings",
)
def class_overlap_iou(vecs):
    two = _two(vecs)
    cells = two.select("page_id", F.when(F.col("a"), 1 + (F.col("y") > 3).cast("int")).otherwise(0).alias("pred"), F.when(F.col("b"), 1 + (F.col("y") > 4).cast("int")).otherwise(0).alias("target"))
    return matching.class_overlaps(cells).withColumn("iou", F.round("iou", 6))


# --- runtimes


@query("SELECT event_type AS name, count(value) AS n, round(coalesce(sum(value), 0), 4) AS total, round(coalesce(avg(value), 0), 6) AS mean, round(coalesce(median(value), 0), 6) AS median, round(coalesce(min(value), 0), 6) AS least, round(coalesce(max(value), 0), 6) AS greatest FROM events GROUP BY 1", "events")
def runtime_summary(events):
    found = metrics.runtime_summary(events.withColumnRenamed("event_type", "name"), "value", "name")
    return found.select("name", "n", F.round("total", 4).alias("total"), *[F.round(c, 6).alias(c) for c in ("mean", "median", "least", "greatest")])


@query("SELECT user_id, round(avg(value), 6) AS mean, round(var_pop(value), 5) AS var, round(stddev_pop(value), 6) AS std, max(value) AS greatest, count(value) AS n, round(CASE WHEN abs(avg(value)) > 1e-12 THEN stddev_pop(value) / avg(value) END, 6) AS cv, CASE WHEN max(value) <= 0.15 THEN 'not important' ELSE 'important' END AS label FROM events GROUP BY 1", "events")
def cv_stats(events):
    found = metrics.spread(events, "value", "user_id")
    return found.withColumns({"mean": F.round("mean", 6), "var": F.round("var", 5), "std": F.round("std", 6), "cv": F.round("cv", 6)})


@query("SELECT event_type AS name, coalesce(user_id % 4, -1) AS kind, grouping(user_id % 4) AS g, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY GROUPING SETS ((event_type, user_id % 4), (event_type))".replace("grouping(user_id % 4) AS g", "CAST(grouping(user_id % 4) AS TINYINT) AS g"), "events")
def distortion_grouping_sets(events):
    rows = events.select(F.col("event_type").alias("name"), (F.col("user_id") % 4).alias("kind"), "value")
    return rows.groupingSets([["name", "kind"], ["name"]], "name", "kind").agg(F.grouping("kind").alias("g"), F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).withColumn("kind", F.coalesce("kind", F.lit(-1)))


@query("WITH b AS (SELECT user_id % 10 AS k, event_type AS metric, avg(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), a AS (SELECT user_id % 10 AS k, event_type AS metric, avg(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2) SELECT k, metric, round(CASE WHEN metric IN ('click', 'error') THEN b.v - a.v ELSE a.v - b.v END, 6) AS gain FROM b JOIN a USING (k, metric)", "events")
def improvements(events):
    side = lambda odd: events.where(F.col("event_id") % 2 == odd).groupBy((F.col("user_id") % 10).alias("k"), F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    return metrics.improvements(side(0), side(1), ["click", "error"], "k").withColumn("gain", F.round("gain", 6))


# --- datasets


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)", "documents", "labels")
def split_left_join_default(docs, rated):
    return etl.with_default(docs.select("doc_id"), rated, "doc_id", "quality", F.lit(-1)).select("doc_id", "quality")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)", "documents", "labels")
def resume_anti_join(docs, rated):
    return etl.pending(docs.select("doc_id", "source"), rated, "doc_id")


@query("SELECT text, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS n FROM documents GROUP BY text")
def dedup_first(docs):
    return etl.first_of_each(docs.select("text", "doc_id", "source"), "text", "doc_id")


@query("SELECT user_id, max(value) AS value, arg_max(event_id, (value, event_id)) AS event_id FROM events GROUP BY 1", "events")
def merge_keep_best(events):
    rows = events.select("user_id", "event_id", "value")
    return etl.best_of_each([rows.where("event_type = 'click'"), rows.where("event_type <> 'click'")], "user_id", "value").select("user_id", "value", "event_id")


_VALID = f"""{BOX}, r AS (SELECT page_id, box_id, list_filter([CASE WHEN (x1 - x0) * (y1 - y0) >= 20 THEN NULL ELSE 'area' END, CASE WHEN (x1 - x0) / (y1 - y0) <= 200 THEN NULL ELSE 'aspect' END, CASE WHEN x0 = 0 THEN NULL ELSE 'indent' END], lambda v: v IS NOT NULL) AS reasons FROM box)"""


def _reasons(docs):
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    checks = {"area": w * h >= 20, "aspect": w / h <= 200, "indent": F.col("x0") == 0}
    return views.line_boxes(docs).withColumn("reasons", etl.reasons(checks))


@query(f"WITH {_VALID} SELECT page_id, box_id, array_to_string(reasons, ',') AS reasons FROM r")
def validate_reasons(docs):
    return _reasons(docs).select("page_id", "box_id", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {_VALID} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM r) GROUP BY 1")
def reason_counts(docs):
    return etl.reason_counts(_reasons(docs))


@query("WITH s AS (SELECT d.source, l.doc_id IS NOT NULL AS hit FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)) SELECT source, count(*) AS n, count(*) FILTER (hit) AS copied, count(*) FILTER (NOT hit) AS skipped FROM s GROUP BY 1", "documents", "labels")
def merge_per_source_skips(docs, rated):
    return etl.per_source_skips(docs.select("doc_id", "source"), rated, "doc_id")


@query("SELECT doc_id, CASE WHEN k = 1 THEN name ELSE replace(name, '.jpg', '_dup' || CAST(k - 1 AS VARCHAR) || '.jpg') END AS target FROM (SELECT doc_id, source || '.jpg' AS name, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents)")
def copy_names(docs):
    return etl.numbered_copies(docs.select("doc_id", F.concat("source", F.lit(".jpg")).alias("name")), "name", "doc_id").select("doc_id", "target")


@query()
def dataset_split(docs):
    """No SQL twin: DuckDB has no CRC-32. Tested for shares and repeatability."""
    return etl.split(docs.select("doc_id"), "doc_id", {"train": 85, "valid": 10, "test": 5})


# --- formats


@query(f"WITH {BOX}, k AS (SELECT page_id, box_id, x0, x1, y0, y1 FROM box) SELECT page_id, box_id, printf('0 %.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f', least(1, x0 / 4096), least(1, y0 / 512), least(1, x1 / 4096), least(1, y0 / 512), least(1, x1 / 4096), least(1, y1 / 512), least(1, x0 / 4096), least(1, y1 / 512)) AS value FROM k")
def yolo_line_format(docs):
    found = views.line_boxes(docs)
    corners = F.array(*[F.struct(F.col(a).alias("x"), F.col(b).alias("y")) for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    return found.select("page_id", "box_id", labels.yolo_line(F.lit(0), corners, F.lit(4096.0), F.lit(512.0)).alias("value"))


@query(f"WITH {BOX} SELECT page_id, box_id, 4 AS n, CAST(trunc(least(4095, x1)) AS INTEGER) AS x, CAST(trunc(least(511, y1)) AS INTEGER) AS y FROM box")
def yolo_round_trip(docs):
    """Written as shares with six places and read again as pixels of the third corner."""
    found = views.line_boxes(docs).where("x1 >= 0")
    corners = F.array(*[F.struct((F.col(a) + 0.01).alias("x"), (F.col(b) + 0.01).alias("y")) for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    text = found.select("page_id", "box_id", labels.yolo_line(F.lit(0), corners, F.lit(4096.0), F.lit(512.0)).alias("value"))
    back = labels.yolo_polygons(text, F.lit(4096.0), F.lit(512.0))
    return back.select("page_id", "box_id", F.size("points").alias("n"), F.col("points")[2]["x"].alias("x"), F.col("points")[2]["y"].alias("y"))


@query(f"WITH {BOX} SELECT 'page' || CAST(page_id AS VARCHAR) AS path, count(*) FILTER (box_id % 3 <> 0) AS n FROM box GROUP BY page_id")
def label_json_parse(docs):
    """Boxes written as `path TAB JSON`, some of them with two points only, and read again."""
    boxes = views.line_boxes(docs)
    points = F.when(F.col("box_id") % 3 == 0, F.array(F.array("x0", "y0"), F.array("x1", "y1"))).otherwise(F.array(F.array("x0", "y0"), F.array("x1", "y0"), F.array("x1", "y1")))
    objects = boxes.groupBy("page_id").agg(F.collect_list(F.struct(points.alias("points"))).alias("o"))
    text = objects.select(F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit("\t"), F.to_json("o")).alias("value"))
    return labels.split_lines(text).select("path", F.size("polygons").cast("bigint").alias("n"))


# --- tuning: the gap up to which regions merge, scored by how near a page comes to ten lines


_TRIALS = [{"gap": g, "least": h} for g in (0, 1, 2, 4) for h in (1, 2)]

_SCORES = f"""{ZREGION}, t AS (SELECT CAST(i AS INTEGER) AS trial, CASE i // 2 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 4 END AS gap, 1 + i % 2 AS least FROM range(8) r(i)),
tg AS (SELECT trial, page_id, y0, y1, CASE WHEN y0 - max(y1) OVER w - 1 <= gap THEN 0 ELSE 1 END AS n FROM reg, t WHERE y1 - y0 + 1 >= least WINDOW w AS (PARTITION BY trial, page_id ORDER BY y0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sc AS (SELECT trial, page_id, sum(n) AS lines, round(1 / (1 + abs(sum(n) - 10)), 9) AS score FROM tg GROUP BY 1, 2)"""


def _trial_scores(docs):
    rows = tuning.with_settings(z_regions(docs), _TRIALS).where(F.col("y1") - F.col("y0") + 1 >= F.col("least"))
    order = profile.by("trial", "page_id").orderBy("y0")
    from pyspark.sql import Window

    reach = F.max("y1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("n", F.when(F.col("y0") - reach - 1 <= F.col("gap"), 0).otherwise(1))
    return marked.groupBy("trial", "page_id").agg(F.sum("n").alias("lines"), F.round(1 / (1 + F.abs(F.sum("n") - 10)), 9).alias("score"))


@query(f"WITH {_SCORES} SELECT page_id, arg_min(trial, (-score, trial)) AS trial, CAST(arg_min(lines, (-score, trial)) AS BIGINT) AS lines, max(score) AS score FROM sc GROUP BY 1")
def oracle_params_max_by(docs):
    return tuning.best_by_page(_trial_scores(docs), "score")


@query(f"WITH {_SCORES}, m AS (SELECT trial, round(avg(score), 9) AS score FROM sc GROUP BY 1) SELECT arg_min(trial, (-score, trial)) AS trial, round(max(score), 6) AS score FROM m")
def best_trial(docs):
    scores = _trial_scores(docs).groupBy("trial").agg(F.round(F.avg("score"), 9).alias("score"))
    return tuning.best_trial(scores, "score").select("trial", F.round("score", 6).alias("score"))


@query(f"WITH {PAGE_LINE} SELECT page_id, CAST(max(y) + 1 AS INTEGER) AS height, CAST(max(length(line)) AS INTEGER) AS width, CAST(sum(hpp) AS BIGINT) AS ink FROM prof GROUP BY 1")
def page_sizes(docs):
    return views.page_lines(docs).groupBy("page_id").agg((F.max("y") + 1).alias("height"), F.max(F.length("line")).alias("width"), F.sum("hpp").alias("ink"))


@query(f"WITH {TILE} SELECT tile_id AS page_id, round(count(*) FILTER (v > 0) / count(*) FILTER (v <= 0), 6) AS ratio FROM tile GROUP BY 1 HAVING count(*) FILTER (v <= 0) > 0", "embeddings")
def pos_weight(vecs):
    cells = views.tiles(vecs).groupBy(F.col("tile_id").alias("page_id")).agg(F.count_if(F.col("v") > 0).alias("a"), F.count_if(F.col("v") <= 0).alias("b"))
    return cells.where("b > 0").select("page_id", F.round(F.col("a") / F.col("b"), 6).alias("ratio"))


@query(f"WITH {TILE}, i AS (SELECT tile_id AS page_id, y, x FROM tile WHERE v > 0), b AS (SELECT page_id, min(y) AS y0, min(x) AS x0, max(y) AS y1, max(x) AS x1, count(*) AS n FROM i GROUP BY 1 HAVING count(*) >= 16) SELECT page_id, CAST(y1 - y0 + 7 AS INTEGER) AS h, CAST(x1 - x0 + 7 AS INTEGER) AS w, n FROM b", "embeddings")
def trim_to_ink(vecs):
    """Ink box with a margin of three, for tiles of enough ink."""
    cells = ink(vecs).groupBy("page_id").agg(F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"), F.count("*").alias("n"))
    return cells.where("n >= 16").select("page_id", (F.col("y1") - F.col("y0") + 7).alias("h"), (F.col("x1") - F.col("x0") + 7).alias("w"), "n")


@query(f"WITH {PAGE_LINE}, w AS (SELECT page_id, y, hpp, avg(hpp) OVER (PARTITION BY page_id) AS m FROM prof) SELECT page_id, count(*) AS rows, count(*) FILTER (hpp > m) AS dense FROM w GROUP BY 1")
def dense_rows(docs):
    rows = lines(docs).withColumn("m", F.avg("hpp").over(profile.by_page()))
    return rows.groupBy("page_id").agg(F.count("*").alias("rows"), F.count_if(F.col("hpp") > F.col("m")).alias("dense"))
