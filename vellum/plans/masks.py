"""Queries over cells of masks, class matrices, boxes and runs, with their SQL twins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from vellum.functions.numeric import rounded
from vellum.operators import components, etl, masks, seams
from vellum.plans.collect import collector
from vellum.plans.evaluation import predictions
from vellum.plans.layout import as_pages, ink, ink_lists, words, z_regions
from vellum.plans.sql import BOX, PAGE_LINE, TILE, WORD, ZREGION
from vellum.sources import views

QUERIES, ORACLES, query = collector()

_INK = f"{TILE}, ink AS (SELECT tile_id AS page_id, y, x FROM tile WHERE v > 0)"
_CROP = f"{_INK}, crop AS (SELECT page_id, CAST(y - min(y) OVER p AS INTEGER) AS y, CAST(x - min(x) OVER p AS INTEGER) AS x, CAST(max(y) OVER p - min(y) OVER p + 1 AS INTEGER) AS h, CAST(max(x) OVER p - min(x) OVER p + 1 AS INTEGER) AS w FROM (SELECT * FROM ink WHERE y BETWEEN 1 AND 6) WINDOW p AS (PARTITION BY page_id))"


def _crop(vecs):
    return masks.cropped(ink(vecs).where("y between 1 and 6"))


@query(f"WITH {_CROP} SELECT page_id, y, x, h, w FROM crop", "embeddings")
def crop_to_ink(vecs):
    return _crop(vecs).select("page_id", "y", "x", "h", "w")


@query(f"WITH {_CROP}, m AS (SELECT page_id, CAST(y + greatest(0, (11 - h) // 2) - greatest(0, (h - 11) // 2) AS INTEGER) AS y, CAST(x + greatest(0, (5 - w) // 2) - greatest(0, (w - 5) // 2) AS INTEGER) AS x FROM crop) SELECT page_id, y, x FROM m WHERE y BETWEEN 0 AND 10 AND x BETWEEN 0 AND 4", "embeddings")
def fit_to_shape(vecs):
    return masks.fitted(_crop(vecs), F.col("h"), F.col("w"), F.lit(11), F.lit(5)).select("page_id", "y", "x")


@query(f"WITH {_INK} SELECT page_id, CAST(y - 2 AS INTEGER) AS y, CAST(x + 1 AS INTEGER) AS x FROM ink WHERE y - 2 >= 0 AND x + 1 <= 7", "embeddings")
def shift_mask(vecs):
    return masks.shifted(ink(vecs), F.lit(-2), F.lit(1), 8, 8).select("page_id", "y", "x")


@query(f"WITH {_INK} SELECT page_id, CAST(Y2 AS INTEGER) AS y, CAST(X2 AS INTEGER) AS x FROM ink, range(12) a(Y2), range(21) b(X2) WHERE ink.y = floor(Y2 * 8 / 12) AND ink.x = floor(X2 * 8 / 21)", "embeddings")
def scale_nearest(vecs):
    return masks.scaled(ink(vecs), 8, 8, 12, 21).select("page_id", "y", "x")


_C, _S = math.cos(math.radians(30)), math.sin(math.radians(30))


@query(f"WITH {_INK}, g AS (SELECT p.page_id, CAST(a.i AS INTEGER) AS y, CAST(b.i AS INTEGER) AS x, round_even(round(3.5 - {_S!r} * (b.i - 3.5) + {_C!r} * (a.i - 3.5), 9), 0) AS sy, round_even(round(3.5 + {_C!r} * (b.i - 3.5) + {_S!r} * (a.i - 3.5), 9), 0) AS sx FROM (SELECT DISTINCT page_id FROM ink) p, range(8) a(i), range(8) b(i)) SELECT g.page_id, g.y, g.x FROM g JOIN ink ON ink.page_id = g.page_id AND ink.y = sy AND ink.x = sx", "embeddings")
def rotate_nearest(vecs):
    return masks.turned(ink(vecs), 30.0, 8, 8).select("page_id", "y", "x")


@query(f"WITH {_INK} SELECT page_id, greatest(0, min(y) - 2) AS y0, least(7, max(y) + 2) AS y1 FROM ink WHERE x = 3 GROUP BY 1", "embeddings")
def line_band(vecs):
    return masks.line_band(ink(vecs).where("x = 3"), 8, 2)


@query(f"""WITH {ZREGION} SELECT page_id, y, CAST(hpp AS DOUBLE) + CASE WHEN EXISTS (SELECT 1 FROM reg r WHERE r.page_id = prof.page_id AND prof.y BETWEEN r.y0 AND r.y1) THEN 255.0 ELSE 0.0 END AS energy FROM prof""")
def zone_energy(docs):
    rows = views.page_lines(docs).select("page_id", "y", F.lit(0).alias("x"), F.col("hpp").cast("double").alias("v"))
    return masks.zone_energy(rows, z_regions(docs)).select("page_id", "y", "energy")


@query(f"WITH {_INK}, c AS (SELECT page_id, y + label - 4 AS y, x + 3 AS x FROM ink JOIN (SELECT vec_id AS page_id, label FROM embeddings) USING (page_id)), h AS (SELECT c.page_id, count(*) AS n, count(i.page_id) AS k FROM c LEFT JOIN ink i USING (page_id, y, x) WHERE c.y BETWEEN 0 AND 7 AND c.x BETWEEN 0 AND 7 GROUP BY 1) SELECT p.page_id, round(coalesce(k / n, 1), 6) AS share FROM (SELECT DISTINCT page_id FROM c) p LEFT JOIN h USING (page_id)", "embeddings")
def overlap_with_used(vecs):
    moved = views.tile_ink(vecs).select(F.col("tile_id").alias("page_id"), (F.col("y") + F.col("label") - 4).alias("y"), (F.col("x") + 3).alias("x"))
    return masks.used_share(moved, ink(vecs), 8, 8).withColumn("share", F.round("share", 6))


@query(f"WITH {TILE}, i AS (SELECT tile_id AS page_id, label AS comp_id, y, x FROM tile WHERE v > 0), b AS (SELECT *, x - min(x) OVER p AS c, max(x) OVER p - min(x) OVER p + 1 AS w FROM i WINDOW p AS (PARTITION BY page_id, comp_id)), k AS (SELECT *, ceil(w / 3) AS n FROM b), e AS (SELECT k.*, CAST(j.j AS INTEGER) AS block FROM k, range(3) j(j) WHERE j.j < n AND c >= floor(j.j * w / n) AND c < floor((j.j + 1) * w / n)) SELECT page_id, comp_id, block, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, count(*) AS n FROM e GROUP BY 1, 2, 3", "embeddings")
def equal_block_centres(vecs):
    cells = views.tile_ink(vecs).select(F.col("tile_id").alias("page_id"), F.col("label").alias("comp_id"), "y", "x")
    return masks.equal_blocks(cells, F.lit(3)).select("page_id", "comp_id", "block", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "n")


@query(f"WITH {ZREGION} SELECT page_id, y0 AS line_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY (y0 + y1) / 2, y0) AS INTEGER) AS number FROM reg")
def lines_top_down(docs):
    mids = z_regions(docs).withColumn("y_mid", (F.col("y0") + F.col("y1")) / 2)
    return masks.in_reading_order(mids, "y_mid", "y0").select("page_id", F.col("y0").alias("line_id"), "number")


@query(f"WITH {BOX}, k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY box_id % 5 DESC, (x1 - x0) * (y1 - y0) DESC, y0, x0) AS r FROM box) SELECT page_id, x0, y0, x1, y1, CAST(box_id % 5 AS DOUBLE) AS score, (x1 - x0) * (y1 - y0) AS area FROM k WHERE r = 1")
def page_window(docs):
    """Line boxes stand for page masks, with a score by their number."""
    found = views.line_boxes(docs).withColumns({"score": (F.col("box_id") % 5).cast("double"), "area": (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))})
    return masks.page_window(found)


@query(f"WITH {BOX}, k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY box_id % 5 DESC, (x1 - x0) * (y1 - y0) DESC, y0, x0) AS r FROM box), {WORD[len(PAGE_LINE) + 2:]} SELECT word.page_id, CAST(word.x - k.x0 AS BIGINT) AS x, word.w FROM word JOIN k ON k.page_id = word.page_id AND r = 1 AND word.x >= k.x0 AND word.x < k.x1 AND word.y >= k.y0 AND word.y < k.y1")
def page_window_words(docs):
    found = views.line_boxes(docs).withColumns({"score": (F.col("box_id") % 5).cast("double"), "area": (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))})
    return masks.inside_window(words(docs), masks.page_window(found)).select("page_id", F.col("x").cast("bigint").alias("x"), "w")


_PRED = "pred AS (SELECT page_id, box_id, x0 + box_id % 5 AS x0, y0 + CASE WHEN box_id % 7 = 3 THEN 0.6 ELSE 0.1 END AS y0, x1 - box_id % 3 + box_id % 5 AS x1, y1 + CASE WHEN box_id % 7 = 3 THEN 0.6 ELSE 0.1 END AS y1 FROM box WHERE box_id % 11 <> 10)"


@query(f"WITH {BOX}, {_PRED}, a AS (SELECT p.page_id, p.box_id AS source, t.box_id AS line, greatest(0, least(p.x1, t.x1 + 0.25) - greatest(p.x0, t.x0 - 0.25)) * greatest(0, least(p.y1, t.y1 + 0.25) - greatest(p.y0, t.y0 - 0.25)) AS area FROM pred p JOIN box t ON t.page_id = p.page_id AND t.box_id BETWEEN p.box_id - 2 AND p.box_id + 2), b AS (SELECT *, row_number() OVER (PARTITION BY page_id, source ORDER BY area DESC, line) AS r FROM a WHERE area > 0) SELECT page_id, source, line, round(area, 6) AS area FROM b WHERE r = 1")
def assign_by_area(docs):
    found = masks.assigned(predictions(docs), views.line_boxes(docs), pad=0.25)
    return found.withColumn("area", F.round("area", 6))


def _slanted(docs):
    """Quadrilaterals: line boxes with their lower side moved by one."""
    corner = lambda x, y, k: F.struct((F.col(x) + k).alias("x"), F.col(y).alias("y"))
    return views.line_boxes(docs).withColumn("corners", F.array(corner("x0", "y0", 0.0), corner("x1", "y0", 0.0), corner("x1", "y1", 1.0), corner("x0", "y1", 1.0)))


@query(f"WITH {BOX} SELECT page_id, box_id, round(least(x1 - x0, sqrt(2)), 6) AS height, round(greatest(x1 - x0, sqrt(2)), 6) AS length FROM box")
def quad_sides(docs):
    lengths = masks.sides(F.col("corners"))
    return _slanted(docs).select("page_id", "box_id", F.round(F.array_min(lengths), 6).alias("height"), F.round(F.array_max(lengths), 6).alias("length"))


@query(f"WITH {BOX}, q AS (SELECT page_id, box_id, [[(x0 + x1) / 2, y0], [x1 + 0.5, (y0 + y1) / 2], [(x0 + x1) / 2 + 1, y1], [x0 + 0.5, (y0 + y1) / 2]] AS m FROM box), k AS (SELECT page_id, box_id, list_position(list_transform(m, lambda z: z[1]), list_min(list_transform(m, lambda z: z[1]))) AS l, list_position(list_transform(m, lambda z: z[1]), list_max(list_transform(m, lambda z: z[1]))) AS r, m FROM q) SELECT page_id, box_id, m[l][1] AS lx, m[l][2] AS ly, m[r][1] AS rx, m[r][2] AS ry FROM k")
def quad_midpoints(docs):
    found = _slanted(docs).withColumn("m", masks.side_midpoints(F.col("corners")))
    return found.select("page_id", "box_id", F.col("m.left.x").alias("lx"), F.col("m.left.y").alias("ly"), F.col("m.right.x").alias("rx"), F.col("m.right.y").alias("ry"))


@query(f"WITH {BOX} SELECT page_id, box_id FROM box WHERE greatest(x1 - x0, sqrt(2)) > 0.2 * 120")
def long_boxes(docs):
    return masks.long_boxes(_slanted(docs), F.col("corners"), F.lit(120.0)).select("page_id", "box_id")


_SEGMENT = "sqrt(pow(px - ax - t * (qx - ax), 2) + pow(py - ay - t * (qy - ay), 2))"


@query(f"WITH {BOX}, e AS (SELECT page_id, box_id, x0 + 2 AS px, y0 + 0.25 AS py, unnest([x0, x1, x1 + 1, x0 + 1]) AS ax, unnest([y0, y0, y1, y1]) AS ay, unnest([x1, x1 + 1, x0 + 1, x0]) AS qx, unnest([y0, y1, y1, y0]) AS qy FROM box), t AS (SELECT *, CASE WHEN pow(qx - ax, 2) + pow(qy - ay, 2) > 0 THEN greatest(0, least(1, ((px - ax) * (qx - ax) + (py - ay) * (qy - ay)) / (pow(qx - ax, 2) + pow(qy - ay, 2)))) ELSE 0 END AS t FROM e) SELECT page_id, box_id, round(min({_SEGMENT}), 6) AS distance FROM t GROUP BY 1, 2")
def outline_distance(docs):
    return _slanted(docs).select("page_id", "box_id", F.round(masks.outline_distance(F.col("x0") + 2, F.col("y0") + 0.25, F.col("corners")), 6).alias("distance"))


@query(f"WITH {_INK}, s AS (SELECT page_id, count(*) AS n, degrees(atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)) / 2) AS a FROM ink GROUP BY 1) SELECT page_id, round(CASE WHEN n < 30 THEN 0 WHEN a < 0 THEN a + 180 ELSE a END, 6) AS angle FROM s", "embeddings")
def main_direction(vecs):
    return masks.main_direction(ink_lists(vecs), 30).withColumn("angle", rounded(F.col("angle"), 6))


@query(f"WITH {WORD}, c AS (SELECT page_id, count(*) AS n FROM word GROUP BY 1) SELECT page_id, CAST(CASE WHEN n < 50 THEN 3 WHEN n > 200 THEN 8 ELSE 7 END AS INTEGER) AS first, CAST(CASE WHEN n < 50 THEN 4 WHEN n > 200 THEN 11 ELSE 9 END AS INTEGER) AS second FROM c")
def vote_thresholds(docs):
    n = words(docs).groupBy("page_id").agg(F.count("*").alias("n"))
    first, second = masks.vote_thresholds(F.col("n"), 7, 9, 50, 200, (2, 4), (8, 12))
    return n.select("page_id", first.alias("first"), second.alias("second"))


@query(f"WITH {WORD}, c AS (SELECT page_id, w AS h, 1 + x % 7 AS w2, avg(w) OVER (PARTITION BY page_id) AS ah FROM word) SELECT page_id, CASE WHEN h >= 0.5 * ah AND h < 3 * ah AND w2 >= 2 THEN 1 WHEN h >= 3 * ah THEN 2 WHEN (h < 3 * ah AND w2 < 2) OR (h < 0.5 * ah AND w2 > 2) THEN 3 ELSE 1 END AS subset, count(*) AS n FROM c GROUP BY 1, 2")
def subset_relaxed(docs):
    """Word lengths stand for heights, and their places for widths."""
    rows = words(docs).withColumn("ah", F.avg("w").over(components.by("page_id")))
    kind = masks.relaxed_subset(1 + F.col("x") % 7, F.col("w"), F.col("ah"), F.lit(4.0))
    return rows.groupBy("page_id", kind.alias("subset")).agg(F.count("*").alias("n"))


@query(f"WITH {PAGE_LINE}, n AS (SELECT page_id, CAST(count(*) AS INTEGER) AS n FROM prof GROUP BY 1), k AS (SELECT page_id, greatest(3, least(8, n)) AS k FROM n) SELECT page_id, CAST(greatest(3, CASE WHEN k % 2 = 0 THEN k - 1 ELSE k END) AS INTEGER) AS k FROM k")
def odd_window(docs):
    n = views.page_lines(docs).groupBy("page_id").agg(F.count("*").cast("int").alias("n"))
    return n.select("page_id", masks.odd_window(F.lit(8), F.col("n")).alias("k"))


@query(f"WITH {TILE}, g AS (SELECT tile_id AS page_id, CAST(x // 4 AS INTEGER) AS part, CAST(y // 4 AS INTEGER) AS line, CAST(least(255, greatest(0, floor(128 + 400 * v))) AS DOUBLE) AS t FROM tile), s AS (SELECT page_id, line, part, t, count(*) AS n FROM g GROUP BY 1, 2, 3, 4), c AS (SELECT *, sum(n) OVER w AS n1, sum(n * t) OVER w AS s1, sum(n) OVER p AS a, sum(n * t) OVER p AS s FROM s WINDOW w AS (PARTITION BY page_id, line, part ORDER BY t), p AS (PARTITION BY page_id, line, part)), d AS (SELECT page_id, line, part, t, round(n1 / a * (a - n1) / a * pow(s1 / n1 - (s - s1) / (a - n1), 2), 9) AS k FROM c WHERE a > n1) SELECT page_id, line, part, arg_min(t, (-k, t)) AS threshold FROM d GROUP BY 1, 2, 3", "embeddings")
def line_part_otsu(vecs):
    """Two lines of a tile in two parts each, every part with its own threshold."""
    edges = [F.struct(F.lit(i).alias("box_id"), F.lit(0).alias("x0"), F.lit(4 * i).alias("y0"), F.lit(8).alias("x1"), F.lit(4 * i + 4).alias("y1")) for i in range(2)]
    boxes = vecs.select(F.col("vec_id").alias("page_id"), F.inline(F.array(*edges)))
    parts = masks.local_threshold_parts(as_pages(vecs).withColumn("v", 128 + 400 * F.col("v")), boxes, 2)
    keyed = parts.withColumn("page_id", F.struct("page_id", "box_id", "part"))
    return components.otsu(keyed, "v").select("page_id.page_id", F.col("page_id.box_id").alias("line"), "page_id.part", "threshold")


@query(f"WITH {TILE}, b AS (SELECT tile_id AS page_id, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM tile WHERE v > 0.2 GROUP BY 1) SELECT page_id, CAST(a.i AS INTEGER) AS y, CAST(c.i AS INTEGER) AS x FROM b, range(8) a(i), range(8) c(i) WHERE a.i BETWEEN y0 - 1 AND y1 + 1 AND c.i BETWEEN x0 - 1 AND x1 + 1", "embeddings")
def padded_regions(vecs):
    high = as_pages(vecs).where("v > 0.2").groupBy("page_id").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    return masks.padded_union(high, 1, 8, 8)


# --- datasets and runs


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)", "documents", "labels")
def labelled_semi_join(docs, rated):
    return etl.matched(docs.select("doc_id", "source"), rated, "doc_id")


@query("WITH f AS (SELECT url AS path, regexp_replace(string_split(url, '/')[-1], '\\.[^.]*$', '') AS stem FROM pages) SELECT stem, min(path) AS path, count(*) AS n FROM f GROUP BY 1", "pages")
def index_by_stem(pages):
    return etl.index_by_stem(pages.select(F.col("url").alias("path")))


@query("WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM labels)) SELECT doc_id, CASE WHEN k <= n - CASE WHEN n <= 150 AND n >= 3 THEN 2 ELSE greatest(0, n - 150) END THEN 'train' ELSE 'valid' END AS part FROM d", "labels")
def leading_split(rated):
    return etl.leading_split(rated.select("doc_id").distinct(), "doc_id", 150)


@query("SELECT count(*) AS available, count(l.doc_id) AS optimised, count(*) - count(l.doc_id) AS pending FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)", "documents", "labels")
def run_metadata(docs, rated):
    return etl.run_counts(docs, rated, "doc_id")


@query("SELECT 'documents' AS origin, doc_id AS id FROM documents UNION ALL SELECT 'pages', page_id FROM pages", "documents", "pages")
def stacked_sources(docs, pages):
    return etl.stacked({"documents": docs.select(F.col("doc_id").alias("id")), "pages": pages.select(F.col("page_id").alias("id"))})


@query("SELECT CASE WHEN event_id % 5 = 0 THEN 'valid' ELSE 'train' END AS part, count(*) AS n, round(avg(value), 6) AS oracle, round(avg(CASE WHEN event_type <> 'error' THEN value END), 6) AS predicted FROM events GROUP BY 1", "events")
def score_report(events):
    rows = events.select(F.when(F.col("event_id") % 5 == 0, "valid").otherwise("train").alias("part"), F.col("value").alias("oracle"), F.when(F.col("event_type") != "error", F.col("value")).alias("predicted"))
    found = etl.score_report(rows, "part", ["oracle", "predicted"])
    return found.withColumns({"oracle": F.round("oracle", 6), "predicted": F.round("predicted", 6)})


@query("SELECT category, count(*) AS n FROM (SELECT doc_id, unnest(['clean', 'photo', 'scan', 'text']) AS category FROM documents) GROUP BY 1")
def category_fan_out(docs):
    return etl.fan_out(docs.select("doc_id"), "doc_id", ["clean", "photo", "scan", "text"]).groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT user_id, unnest(['bounds.high', 'bounds.low', 'gap']) AS name, unnest([max(value), min(value), CAST(count(*) AS DOUBLE)]) AS value FROM events GROUP BY user_id", "events")
def flat_settings(events):
    nested = events.groupBy("user_id").agg(F.struct(F.min("value").alias("low"), F.max("value").alias("high")).alias("bounds"), F.count("*").alias("gap"))
    back = etl.nested_settings(etl.flat_settings(nested, "user_id"), "user_id")
    return back.select("user_id", F.explode("settings").alias("name", "value"))


@query(f"WITH {TILE}, cl AS (SELECT tile_id AS page_id, y, x, CASE WHEN y > 4 THEN 3 ELSE 1 END + CASE WHEN label % 2 = 0 THEN 1 ELSE 0 END AS class_id FROM tile WHERE v > 0) SELECT page_id, y, x, CAST(dense_rank() OVER (PARTITION BY page_id ORDER BY class_id) AS INTEGER) AS class_id FROM cl", "embeddings")
def consecutive_classes(vecs):
    cells = views.tile_ink(vecs).select(F.col("tile_id").alias("page_id"), "y", "x", (F.when(F.col("y") > 4, 3).otherwise(1) + F.when(F.col("label") % 2 == 0, 1).otherwise(0)).alias("class_id"))
    return seams.consecutive(cells).select("page_id", "y", "x", "class_id")

