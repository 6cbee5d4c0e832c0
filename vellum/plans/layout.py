"""Queries over pages and tiles: profiles, regions, morphology, components, seams, lines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.numeric import rounded
from vellum.operators import components, detectors, geometry, hough, metrics, profile, rectify, seams, synthesis
from vellum.plans.sql import BOX, PAGE_LINE, TILE, WORD, ZREGION
from vellum.runtime import table
from vellum.sources import views

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None, source: str = "documents"):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(table(spark, sf_dir, source))
        QUERIES[f.__name__].__doc__ = f.__doc__
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def lines(docs: DataFrame) -> DataFrame:
    return views.page_lines(docs).drop("line")


def z_regions(docs: DataFrame) -> DataFrame:
    return profile.regions(profile.zscore(lines(docs)), F.col("z") > 0)


def ink(vecs: DataFrame) -> DataFrame:
    return views.tile_ink(vecs).select(F.col("tile_id").alias("page_id"), "y", "x")


def ink_lists(vecs: DataFrame) -> DataFrame:
    return views.tile_cells(vecs).withColumnRenamed("tile_id", "page_id")


def as_pages(vecs: DataFrame) -> DataFrame:
    return views.tiles(vecs).select(F.col("tile_id").alias("page_id"), "y", "x", "v")


# --- profiles


@query(f"WITH {PAGE_LINE} SELECT page_id, y, hpp FROM prof")
def hpp_profile(docs):
    return lines(docs)


@query(f"WITH {PAGE_LINE} SELECT page_id, y, round(CASE WHEN max(hpp) OVER w - min(hpp) OVER w > 1e-9 THEN (hpp - min(hpp) OVER w) / (max(hpp) OVER w - min(hpp) OVER w) ELSE 0 END, 6) AS norm FROM prof WINDOW w AS (PARTITION BY page_id)")
def hpp_minmax(docs):
    return profile.minmax(lines(docs)).select("page_id", "y", F.round("norm", 6).alias("norm"))


@query(f"WITH {ZREGION} SELECT page_id, y, round(z, 6) AS z FROM zs")
def hpp_zscore(docs):
    return profile.zscore(lines(docs)).select("page_id", "y", F.round("z", 6).alias("z"))


@query(f"WITH {PAGE_LINE} SELECT page_id, y, round(sum(hpp) OVER (PARTITION BY page_id ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3, 6) AS smooth FROM prof")
def hpp_box_smooth(docs):
    return profile.box_smoothed(lines(docs), 3).select("page_id", "y", F.round("smooth", 6).alias("smooth"))


# --- regions


@query(f"WITH {ZREGION} SELECT page_id, count(*) AS n_lines, round(avg(y1 - y0 + 1), 6) AS mean_height FROM reg GROUP BY page_id")
def text_regions_zscore(docs):
    """The flagship: text rows above the page's mean, as lines per page and their mean height."""
    return z_regions(docs).groupBy("page_id").agg(F.count("*").alias("n_lines"), F.round(F.avg(F.col("y1") - F.col("y0") + 1), 6).alias("mean_height"))


_MERGED = """, g AS (SELECT *, CASE WHEN y0 - max(y1) OVER (PARTITION BY page_id ORDER BY y0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 <= 1 THEN 0 ELSE 1 END AS n FROM reg),
h AS (SELECT *, sum(n) OVER (PARTITION BY page_id ORDER BY y0) AS k FROM g),
mreg AS (SELECT page_id, min(y0) AS y0, max(y1) AS y1 FROM h GROUP BY page_id, k)"""


@query(f"WITH {ZREGION}{_MERGED} SELECT page_id, y0, y1 FROM mreg")
def text_regions_merge_gap(docs):
    return profile.merge_regions(z_regions(docs), 1)


@query(f"WITH {ZREGION}, s AS (SELECT *, avg(y1 - y0 + 1) OVER (PARTITION BY page_id) AS m, count(*) OVER (PARTITION BY page_id) AS n FROM reg) SELECT page_id, y0, y1 FROM s WHERE n <= 1 OR y1 - y0 + 1 >= m / 3")
def region_filter_mean_div3(docs):
    return profile.drop_thin(z_regions(docs))


@query(f"WITH {ZREGION}, k AS (SELECT *, y1 - y0 + 1 AS h, greatest(1, CAST(round_even((y1 - y0 + 1) * 0.5, 0) AS INTEGER)) AS s FROM reg) SELECT page_id, CAST(y0 + floor((h - s) / 2) AS INTEGER) AS y0, CAST(y0 + floor((h - s) / 2) + s - 1 AS INTEGER) AS y1 FROM k")
def region_shrink(docs):
    return profile.shrink(z_regions(docs))


@query(f"WITH {ZREGION}, b AS (SELECT page_id, y0, lag(y1) OVER (PARTITION BY page_id ORDER BY y0) AS p FROM reg) SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY y0) AS INTEGER) AS seam_id, CAST(round_even((y0 + p) / 2, 0) AS INTEGER) AS y FROM b WHERE p IS NOT NULL")
def seam_starts(docs):
    return profile.seam_starts(z_regions(docs))


@query(f"WITH {ZREGION}, b AS (SELECT page_id, y0, lag(y1) OVER (PARTITION BY page_id ORDER BY y0) AS p FROM reg) SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY y0) AS INTEGER) AS seam_id, CAST(floor((y0 + p) / 2) AS INTEGER) AS y FROM b WHERE p IS NOT NULL")
def seam_starts_floor(docs):
    return profile.seam_starts(z_regions(docs), floor=True)


@query(
    f"""WITH {PAGE_LINE}, c AS (SELECT page_id, y AS line, CAST(unnest(generate_series(0, length(line) - 1)) AS INTEGER) AS x, unnest(string_split(line, '')) AS ch FROM page_line WHERE line <> ''),
n AS (SELECT page_id, line, x, CASE WHEN x - lag(x) OVER (PARTITION BY page_id, line ORDER BY x) <= 1 THEN 0 ELSE 1 END AS n FROM c WHERE ch <> ' '),
g AS (SELECT *, sum(n) OVER (PARTITION BY page_id, line ORDER BY x) AS word FROM n)
SELECT page_id, line, CAST(min(x) AS INTEGER) AS x0, CAST(max(x) AS INTEGER) AS x1 FROM g GROUP BY page_id, line, word HAVING max(x) - min(x) + 1 >= 3"""
)
def word_spans(docs):
    runs = views.page_words(docs).select("page_id", F.col("y").alias("line"), F.col("x").alias("x0"), (F.col("x") + F.col("w") - 1).alias("x1"))
    return profile.word_spans(runs, gap=0).select("page_id", "line", "x0", "x1")


# --- morphology on tile rows


@query(
    f"""WITH {TILE}, a AS (SELECT *, max(hpp) OVER w AS v FROM tprof WINDOW w AS (PARTITION BY page_id ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
b AS (SELECT *, min(v) OVER w AS u FROM a WINDOW w AS (PARTITION BY page_id ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
c AS (SELECT *, min(u) OVER w AS t FROM b WINDOW w AS (PARTITION BY page_id ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT page_id, y, max(t) OVER (PARTITION BY page_id ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smooth FROM c""",
    "embeddings",
)
def morph_close_open(vecs):
    return profile.close_open(views.tile_profile(vecs), "hpp", 3).select("page_id", "y", "smooth")


_PLATEAU = """{q} AS (SELECT page_id, y, CASE WHEN max(hpp) OVER w - min(hpp) OVER w > 1e-9 THEN CAST(floor((hpp - min(hpp) OVER w) / (max(hpp) OVER w - min(hpp) OVER w) * 255) AS INTEGER) ELSE 0 END AS q FROM prof WINDOW w AS (PARTITION BY page_id))"""


def _smoothed(name: str, k: int) -> str:
    w = f"(PARTITION BY page_id ORDER BY y ROWS BETWEEN {k // 2} PRECEDING AND {k // 2} FOLLOWING)"
    return f"""{name}1 AS (SELECT page_id, y, max(q) OVER {w} AS v FROM qq), {name}2 AS (SELECT page_id, y, min(v) OVER {w} AS v FROM {name}1), {name}3 AS (SELECT page_id, y, min(v) OVER {w} AS v FROM {name}2), {name} AS (SELECT page_id, y, max(v) OVER {w} AS v FROM {name}3)"""


def _plateaus(name: str, of: str) -> str:
    return f"""{name}a AS (SELECT page_id, y, v, CASE WHEN v = lag(v) OVER (PARTITION BY page_id ORDER BY y) THEN 0 ELSE 1 END AS n FROM {of}),
{name}b AS (SELECT *, sum(n) OVER (PARTITION BY page_id ORDER BY y) AS r FROM {name}a),
{name}c AS (SELECT page_id, r, min(y) AS y0, max(y) AS y1, any_value(v) AS level FROM {name}b GROUP BY page_id, r),
{name}d AS (SELECT *, lag(level) OVER (PARTITION BY page_id ORDER BY r) AS p, lead(level) OVER (PARTITION BY page_id ORDER BY r) AS x FROM {name}c),
{name}l AS (SELECT page_id, r, level AS foot FROM {name}d WHERE p IS NULL OR p > level),
{name}r AS (SELECT page_id, r, level AS foot FROM {name}d WHERE x IS NULL OR x > level),
{name} AS (SELECT d.page_id, d.y0, d.y1, d.level FROM {name}d d
  WHERE d.level > 0 AND d.p < d.level AND d.x < d.level
  AND d.level - (SELECT arg_max(l.foot, l.r) FROM {name}l l WHERE l.page_id = d.page_id AND l.r <= d.r) >= 13
  AND d.level - (SELECT arg_min(l.foot, l.r) FROM {name}r l WHERE l.page_id = d.page_id AND l.r >= d.r) >= 13)"""


@query(f"WITH {PAGE_LINE}, {_PLATEAU.format(q='qq')}, {_smoothed('s', 3)}, {_plateaus('pl', 's')} SELECT page_id, y0, y1, level FROM pl")
def plateau_rows(docs):
    return profile.plateaus(profile.close_open(profile.quantised(lines(docs)), "q", 3, "s"), "s")


@query(
    f"""WITH {PAGE_LINE}, {_PLATEAU.format(q='qq')}, {_smoothed('s', 5)}, {_smoothed('t', 3)}, {_plateaus('pl', 's')}, {_plateaus('pm', 't')},
u AS (SELECT 0 AS kernel, * FROM pl UNION ALL SELECT 1, * FROM pm), n AS (SELECT *, count(*) OVER (PARTITION BY page_id, kernel) AS n FROM u),
k AS (SELECT *, first_value(kernel) OVER (PARTITION BY page_id ORDER BY n DESC, kernel) AS best FROM n)
SELECT page_id, kernel, y0, y1, level FROM k WHERE kernel = best"""
)
def two_kernel_select(docs):
    return profile.two_kernels(lines(docs), 5, 3)


# --- components


def words(docs: DataFrame) -> DataFrame:
    return views.page_words(docs)


@query(f"WITH {WORD}, c AS (SELECT page_id, w, count(*) AS n FROM word GROUP BY 1, 2) SELECT page_id, min(w) AS ah FROM (SELECT *, max(n) OVER (PARTITION BY page_id) AS m FROM c) WHERE n = m GROUP BY page_id")
def ah_mode(docs):
    return components.character_height(words(docs).select("page_id", F.col("w").alias("h")))


@query(f"WITH {WORD}, c AS (SELECT *, min(w) OVER (PARTITION BY page_id) AS a, max(w) OVER (PARTITION BY page_id) AS b FROM word) SELECT page_id, round(avg(w), 6) AS ah FROM c WHERE w > a OR a = b GROUP BY page_id")
def ah_skip_first_bin(docs):
    found = components.character_height_mean(words(docs).select("page_id", F.col("w").alias("h")))
    return found.select("page_id", F.round("ah", 6).alias("ah"))


@query(
    f"""WITH {WORD}, c AS (SELECT page_id, w AS h, 1 + x % 7 AS w2, avg(w) OVER (PARTITION BY page_id) AS ah, 4.0 AS aw FROM word)
SELECT page_id, CASE WHEN h >= 0.5 * ah AND h < 3 * ah AND w2 >= 0.5 * aw THEN 1 WHEN h >= 3 * ah THEN 2 WHEN (h < 3 * ah AND w2 < 0.5 * aw) OR (h < 0.5 * ah AND w2 >= 0.5 * aw) THEN 3 END AS subset, count(*) AS n FROM c GROUP BY 1, 2"""
)
def subset_partition(docs):
    """Word lengths stand for heights, and their places for widths."""
    rows = words(docs).withColumn("ah", F.avg("w").over(profile.by_page()))
    kind = components.subset(1 + F.col("x") % 7, F.col("w"), F.col("ah"), F.lit(4.0))
    return rows.groupBy("page_id", kind.alias("subset")).agg(F.count("*").alias("n"))


@query(f"WITH {TILE}, i AS (SELECT tile_id AS page_id, label AS comp_id, y, x FROM tile WHERE v > 0), b AS (SELECT *, CAST(floor((x - min(x) OVER (PARTITION BY page_id, comp_id)) / 3) AS INTEGER) AS block FROM i) SELECT page_id, comp_id, block, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, count(*) AS n FROM b GROUP BY 1, 2, 3", "embeddings")
def block_centers(vecs):
    cells = views.tile_ink(vecs).select(F.col("tile_id").alias("page_id"), F.col("label").alias("comp_id"), "y", "x")
    return components.block_centres(cells, F.lit(3)).select("page_id", "comp_id", "block", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "n")


_CENTRES = f"""{WORD}, pts AS (SELECT page_id, y * 100000 + x AS comp_id, x + w / 2 AS cx, CAST(8 * y AS DOUBLE) AS cy FROM word),
near0 AS (SELECT a.page_id, a.comp_id, min(sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2))) AS distance FROM pts a JOIN pts b ON a.page_id = b.page_id AND a.comp_id <> b.comp_id AND abs(a.cx - b.cx) <= 12 AND abs(a.cy - b.cy) <= 12 GROUP BY 1, 2),
far AS (SELECT a.page_id, a.comp_id, min(sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2))) AS distance FROM (SELECT * FROM pts ANTI JOIN (SELECT page_id, comp_id FROM near0 WHERE distance <= 12) USING (page_id, comp_id)) a JOIN pts b ON a.page_id = b.page_id AND a.comp_id <> b.comp_id GROUP BY 1, 2),
near AS (SELECT * FROM near0 WHERE distance <= 12 UNION ALL SELECT * FROM far)"""


def _word_points(batches):
    """Centres of the words of about 2 MB of texts at a time."""
    for batch in views.in_pieces(batches, "text", 1 << 21):
        row, y, x, w = views.words_of(batch["text"])
        yield batch["page_id"].to_numpy(zero_copy_only=False), row, y * 100000 + x, x + w / 2, 8.0 * y


def _nearest(docs):
    pages = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("page_id"), "text")
    return components.nearest_in_rows(pages, _word_points).withColumn("comp_id", F.col("comp_id").cast("int"))


@query(f"WITH {_CENTRES} SELECT page_id, comp_id, round(distance, 6) AS distance FROM near")
def nearest_component(docs):
    return _nearest(docs).select("page_id", "comp_id", F.round("distance", 6).alias("distance"))


@query(
    f"""WITH {_CENTRES}, v AS (SELECT page_id, round(distance, 3) AS t FROM near), s AS (SELECT page_id, t, count(*) AS n FROM v GROUP BY 1, 2),
c AS (SELECT page_id, t, sum(n) OVER w AS n1, sum(n * t) OVER w AS s1, sum(n) OVER (PARTITION BY page_id) AS a, sum(n * t) OVER (PARTITION BY page_id) AS s FROM s WINDOW w AS (PARTITION BY page_id ORDER BY t)),
d AS (SELECT page_id, t, round(n1 / a * (a - n1) / a * pow(s1 / n1 - (s - s1) / (a - n1), 2), 9) AS k FROM c WHERE a > n1),
b AS (SELECT page_id, arg_min(t, (-k, t)) AS t FROM d GROUP BY 1), m AS (SELECT page_id, median(t) AS m FROM v GROUP BY 1)
SELECT page_id, coalesce(b.t, m.m) AS threshold FROM m LEFT JOIN b USING (page_id)"""
)
def between_class_threshold(docs):
    return components.between_class_threshold(_nearest(docs).withColumn("distance", F.round("distance", 3)))


@query(None, "embeddings")
def connected_components(vecs):
    """No SQL twin: labelling is iterative. Tested against flood fill."""
    return components.components(ink(vecs))


@query(f"WITH {TILE}, i AS (SELECT tile_id, least(255, greatest(0, floor(128 + 400 * v))) AS t FROM tile), s AS (SELECT tile_id, CAST(t AS DOUBLE) AS t, count(*) AS n FROM i GROUP BY 1, 2), c AS (SELECT tile_id, t, sum(n) OVER w AS n1, sum(n * t) OVER w AS s1, sum(n) OVER (PARTITION BY tile_id) AS a, sum(n * t) OVER (PARTITION BY tile_id) AS s FROM s WINDOW w AS (PARTITION BY tile_id ORDER BY t)), d AS (SELECT tile_id, t, round(n1 / a * (a - n1) / a * pow(s1 / n1 - (s - s1) / (a - n1), 2), 9) AS k FROM c WHERE a > n1) SELECT tile_id AS page_id, arg_min(t, (-k, t)) AS threshold FROM d GROUP BY 1", "embeddings")
def otsu_threshold(vecs):
    return components.otsu(as_pages(vecs).withColumn("grey", 128 + 400 * F.col("v")), "grey")


# --- skew, lines


_ANGLES = [float(a) for a in range(-30, 31, 3)]


@query(
    f"""WITH {TILE}, a AS (SELECT CAST(unnest(generate_series(-30, 30, 3)) AS DOUBLE) AS angle), r AS (SELECT tile_id, angle, round_even(y - x * tan(radians(angle)), 0) AS r, count(*) AS n FROM tile, a WHERE v > 0 GROUP BY 1, 2, 3),
s AS (SELECT tile_id, angle, round(sum(n * n) / 8 - pow(sum(n) / 8, 2), 9) AS var FROM r GROUP BY 1, 2)
SELECT tile_id AS page_id, arg_min(angle, (-var, angle)) AS angle, max(var) AS var FROM s GROUP BY 1""",
    "embeddings",
)
def skew_argmax_var(vecs):
    return geometry.skew(ink(vecs), _ANGLES, 8)


_THETAS = [float(t) for t in range(85, 96)]


@query(
    f"""WITH {WORD}, p AS (SELECT page_id, y * 100000 + x AS id, CAST(x + w / 2 AS DOUBLE) AS x, CAST(4 * y AS DOUBLE) AS y FROM word), t AS (SELECT CAST(unnest(generate_series(0, 10)) AS INTEGER) AS i),
v AS (SELECT page_id, CAST(round_even((x * cos(radians(85 + i)) + y * sin(radians(85 + i)) + 1000) / 2, 0) AS INTEGER) AS rho, i AS theta, count(*) AS n, min(id) AS f FROM p, t GROUP BY 1, 2, 3)
SELECT page_id, rho, theta, n FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, f, theta) AS k FROM v) WHERE k = 1"""
)
def hough_votes_peak(docs):
    points = words(docs).select("page_id", (F.col("y") * 100000 + F.col("x")).alias("point_id"), (F.col("x") + F.col("w") / 2).alias("x"), (4.0 * F.col("y")).alias("y"))
    return hough.peak(hough.votes(points, _THETAS, 2.0, F.lit(-1000.0)))


@query()
def hough_lines(docs):
    """No SQL twin: peaks are taken one by one. Tested on drawn lines."""
    points = words(docs).select("page_id", (F.col("y") * 100000 + F.col("x")).alias("point_id"), F.col("y").alias("comp_id"), (F.col("x") + F.col("w") / 2).alias("x"), (12.0 * F.col("y")).alias("y"))
    found = hough.text_lines(points, 4000.0, 4000.0, 3.0)
    return found.select("page_id", "line_id", F.round("rho", 6).alias("rho"), "theta", F.size("comp_ids").alias("n_comps"))


_YMID = f"""{ZREGION}, ln AS (SELECT page_id, y0 AS line_id, (y0 + y1) / 2 AS y_mid FROM reg)"""


def _mids(docs):
    return z_regions(docs).select("page_id", F.col("y0").alias("line_id"), ((F.col("y0") + F.col("y1")) / 2).alias("y_mid"))


@query(
    f"""WITH {_YMID}, g AS (SELECT *, y_mid - lag(y_mid) OVER (PARTITION BY page_id ORDER BY y_mid, line_id) AS gap FROM ln), h AS (SELECT *, CASE WHEN gap < avg(gap) OVER (PARTITION BY page_id) THEN 0 ELSE 1 END AS n FROM g),
k AS (SELECT *, sum(n) OVER (PARTITION BY page_id ORDER BY y_mid, line_id) AS grp FROM h)
SELECT page_id, arg_min(line_id, (y_mid, line_id)) AS line_id, count(*) AS n, min(y_mid) AS y0, max(y_mid) AS y1 FROM k GROUP BY page_id, grp"""
)
def line_y_mid_merge(docs):
    return hough.merge_lines(_mids(docs))


@query(
    f"""WITH {ZREGION}, ln AS (SELECT page_id, y0 AS line_id, (y0 + y1) / 2 AS rho FROM reg), {WORD[len(PAGE_LINE) + 2 :]},
d AS (SELECT word.page_id, word.y * 100000 + word.x AS comp_id, line_id, abs(word.y - rho) AS d FROM word JOIN ln USING (page_id))
SELECT page_id, comp_id, arg_min(line_id, (d, line_id)) AS line_id, round(min(d), 6) AS distance FROM d GROUP BY 1, 2"""
)
def nearest_line(docs):
    points = words(docs).select("page_id", (F.col("y") * 100000 + F.col("x")).alias("comp_id"), F.lit(0.0).alias("x"), F.col("y").cast("double").alias("y"))
    found = hough.nearest_line(points, _mids(docs).select("page_id", "line_id", F.col("y_mid").alias("rho"), F.lit(90.0).alias("theta")))
    return found.withColumn("distance", F.round("distance", 6))


@query(f"WITH {TILE}, f AS (SELECT tile_id AS page_id, regr_slope(y, x) AS m, regr_intercept(y, x) AS b FROM tile WHERE v > 0 GROUP BY 1) SELECT page_id, round(b / sqrt(1 + m * m), 6) AS rho, round(degrees(atan2(1, -m)), 6) AS theta FROM f WHERE m IS NOT NULL AND NOT isnan(m)", "embeddings")
def line_fit(vecs):
    return hough.fitted(ink(vecs), "page_id").select("page_id", F.round("rho", 6).alias("rho"), F.round("theta", 6).alias("theta"))


@query(
    f"""WITH {TILE}, f AS (SELECT label AS page_id, tile_id AS line_id, degrees(atan2(1, -regr_slope(y, x))) AS theta FROM tile WHERE v > 0 GROUP BY 1, 2), g AS (SELECT page_id, line_id, round(theta, 6) AS theta FROM f WHERE theta IS NOT NULL AND NOT isnan(theta)),
m AS (SELECT page_id, median(theta) AS m, count(*) AS k FROM g GROUP BY 1)
SELECT page_id, line_id, theta FROM g JOIN m USING (page_id) WHERE k <= 1 OR abs(theta - m) <= 10""",
    "embeddings",
)
def lines_drop_skewed(vecs):
    cells = views.tile_ink(vecs).select(F.col("label").alias("page_id"), F.col("tile_id").alias("line_id"), "x", "y")
    fit = hough.fitted(cells, "page_id", "line_id").select("page_id", "line_id", F.round("theta", 6).alias("theta"))
    return hough.drop_skewed(fit, 10.0)


# --- boxes


@query(
    f"""WITH {TILE}, i AS (SELECT tile_id AS page_id, x, y FROM tile WHERE v > 0), s AS (SELECT page_id, count(*) AS n, avg(x) AS cx, avg(y) AS cy, atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)) / 2 AS a FROM i GROUP BY 1 HAVING count(*) >= 10),
l AS (SELECT page_id, n, a, (x - cx) * cos(a) + (y - cy) * sin(a) AS s, (y - cy) * cos(a) - (x - cx) * sin(a) AS t FROM i JOIN s USING (page_id))
SELECT page_id, any_value(n) AS n, round(any_value(a), 6) AS angle, round(quantile_cont(s, 0.01), 5) AS s0, round(quantile_cont(s, 0.99), 5) AS s1, round(quantile_cont(t, 0.05), 5) AS t0, round(quantile_cont(t, 0.95), 5) AS t1 FROM l GROUP BY 1""",
    "embeddings",
)
def pca_box(vecs):
    found = geometry.pca_box(ink_lists(vecs), "page_id")
    return found.select("page_id", "n", rounded(F.col("angle"), 6).alias("angle"), *[rounded(F.col(c), 5).alias(c) for c in ("s0", "s1", "t0", "t1")])


@query(None, "embeddings")
def min_area_rect(vecs):
    """No SQL twin: the hull is a geometric fold. Tested against all directions."""
    found = geometry.rectangles(ink(vecs), "page_id")
    area = geometry.shoelace("points")
    return found.withColumn("points", F.transform("corners", lambda c: F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y")))).select("page_id", F.round(area, 6).alias("area"))


@query(
    f"""WITH {ZREGION}, {_MERGED[2:]}, b AS (SELECT r.page_id, r.y0 AS box_id, CAST(r.y0 AS DOUBLE) AS y0, CAST(r.y1 + 1 AS DOUBLE) AS y1, sum(p.hpp * (p.y + 0.5)) / sum(p.hpp) AS mass FROM mreg r JOIN prof p ON p.page_id = r.page_id AND p.y BETWEEN r.y0 AND r.y1 GROUP BY 1, 2, 3, 4),
m AS (SELECT *, avg(y1 - y0) OVER (PARTITION BY page_id) AS mean FROM b),
s AS (SELECT *, greatest(y0, least(greatest(least(CASE WHEN mass - y0 <= y1 - mass THEN y0 ELSE y1 - mean END, mass), mass - mean), y1 - mean)) AS st FROM m)
SELECT page_id, box_id, round(CASE WHEN y1 - y0 > 1.2 * mean AND mean >= 2 THEN st ELSE y0 END, 6) AS n0, round(CASE WHEN y1 - y0 > 1.2 * mean AND mean >= 2 THEN st + mean ELSE y1 END, 6) AS n1 FROM s"""
)
def tall_box_crop(docs):
    found = profile.merge_regions(z_regions(docs), 1)
    rows = lines(docs).join(found, "page_id").where("y between y0 and y1")
    boxes = rows.groupBy("page_id", "y0", "y1").agg((F.sum(F.col("hpp") * (F.col("y") + 0.5)) / F.sum("hpp")).alias("mass"))
    boxes = boxes.select("page_id", F.col("y0").alias("box_id"), F.col("y0").cast("double").alias("y0"), (F.col("y1") + 1).cast("double").alias("y1"), "mass")
    return geometry.crop_tall(boxes).select("page_id", "box_id", F.round("n0", 6).alias("n0"), F.round("n1", 6).alias("n1"))


@query(
    f"""WITH RECURSIVE {WORD}, v AS (SELECT page_id, CAST(w AS DOUBLE) AS v FROM word), s AS (SELECT page_id, 0 AS k, min(v) AS a, max(v) AS b, false AS done FROM v GROUP BY 1
UNION ALL SELECT page_id, k + 1, CASE WHEN done THEN a ELSE na END, CASE WHEN done THEN b ELSE nb END, done OR (abs(na - a) <= 1e-3 AND abs(nb - b) <= 1e-3) FROM (
  SELECT s.page_id, k, a, b, done, coalesce(avg(v) FILTER (abs(v - a) <= abs(v - b)), a) AS na, coalesce(avg(v) FILTER (abs(v - a) > abs(v - b)), b) AS nb FROM s JOIN v USING (page_id) WHERE k < 30 AND NOT done GROUP BY s.page_id, k, a, b, done)),
l AS (SELECT page_id, arg_max(a, k) AS a, arg_max(b, k) AS b FROM s GROUP BY 1)
SELECT page_id, round(any_value(a), 6) AS low, round(any_value(b), 6) AS high, count(*) FILTER (abs(v - a) <= abs(v - b)) AS n_low, count(*) FILTER (abs(v - a) > abs(v - b)) AS n_high FROM l JOIN v USING (page_id) GROUP BY 1"""
)
def kmeans_1d(docs):
    found = geometry.two_means(words(docs), "w", "page_id")
    return found.select("page_id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n_low", "n_high")


@query(f"WITH {BOX} SELECT page_id, box_id, x0, y0, x1, y1, (x1 - x0) * (y1 - y0) AS area FROM box")
def line_boxes(docs):
    found = views.line_boxes(docs)
    corners = F.array(*[F.struct(F.col(a).alias("x"), F.col(b).alias("y")) for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    return found.withColumn("points", corners).select("page_id", "box_id", "x0", "y0", "x1", "y1", geometry.shoelace("points").alias("area"))


# --- seams


_ENERGY = f"{TILE}, en AS (SELECT tile_id AS page_id, y, x, round(abs(v), 6) AS e FROM tile)"


def _energy(vecs):
    return as_pages(vecs).select("page_id", "y", "x", F.round(F.abs("v"), 6).alias("energy"))


@query(
    f"""WITH RECURSIVE {_ENERGY}, c AS (SELECT page_id, x, list(e ORDER BY y) AS e FROM en GROUP BY 1, 2),
p AS (SELECT page_id, x, e AS d FROM c WHERE x = 0 UNION ALL SELECT c.page_id, c.x, [c.e[i] + least(p.d[i], CASE WHEN i > 1 THEN p.d[i - 1] END, CASE WHEN i < 8 THEN p.d[i + 1] END) FOR i IN range(1, 9)] FROM p JOIN c ON c.page_id = p.page_id AND c.x = p.x + 1)
SELECT page_id, round(list_min(d), 6) AS least, round(d[1], 6) AS top, round(list_sum(d), 3) AS total FROM p WHERE x = 7""",
    "embeddings",
)
def dp_min_energy(vecs):
    found = seams.least_paths(seams.column_arrays(_energy(vecs)))
    total = F.aggregate("costs", F.lit(0.0), lambda s, c: s + c)
    return found.select("page_id", F.round(F.array_min("costs"), 6).alias("least"), F.round(F.element_at("costs", 1), 6).alias("top"), F.round(total, 3).alias("total"))


@query(None, "embeddings")
def a_star_seam(vecs):
    """No SQL twin: a search with walls. Tested against all paths of small grids."""
    starts = vecs.select(F.col("vec_id").alias("page_id"), F.explode(F.array(F.lit(2), F.lit(5))).alias("y")).withColumn("seam_id", F.col("y"))
    cells = _energy(vecs).withColumn("blocked", F.col("energy") > 0.3)
    found = seams.seams(cells, starts, search=True, drift=0.05)
    cost = found.join(_energy(vecs), ["page_id", "y", "x"])
    return cost.groupBy("page_id", "seam_id").agg(F.count("*").alias("n"), F.round(F.sum("energy"), 6).alias("energy"))


def _flat_seams(vecs):
    """A seam that bends by column, for tiles: y = 3, and 5 from column 4 on."""
    x = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("x")
    one = vecs.select(F.col("vec_id").alias("page_id"), x)
    return one.select("page_id", F.lit(1).alias("seam_id"), "x", F.when(F.col("x") < 4, 2).otherwise(3).alias("y")).unionAll(
        one.select("page_id", F.lit(2).alias("seam_id"), "x", F.when(F.col("x") < 4, 5).otherwise(6).alias("y"))
    )


_CLASS = f"{TILE}, cl AS (SELECT tile_id AS page_id, y, x, 1 + CAST(y > CASE WHEN x < 4 THEN 2 ELSE 3 END AS INTEGER) + CAST(y > CASE WHEN x < 4 THEN 5 ELSE 6 END AS INTEGER) AS class_id FROM tile WHERE v > 0)"


@query(f"WITH {_CLASS} SELECT page_id, y, x, class_id FROM cl", "embeddings")
def class_from_seams(vecs):
    return seams.classes(ink(vecs), _flat_seams(vecs)).select("page_id", "y", "x", "class_id")


@query(f"WITH {_CLASS} SELECT page_id, y, x, class_id FROM cl WHERE y <> CASE WHEN x < 4 THEN 2 ELSE 3 END AND y <> CASE WHEN x < 4 THEN 5 ELSE 6 END", "embeddings")
def pixels_between_seams(vecs):
    return seams.between(ink(vecs), _flat_seams(vecs)).select("page_id", "y", "x", "class_id")


@query(f"WITH {_CLASS} SELECT page_id, class_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS n, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM cl GROUP BY 1, 2", "embeddings")
def class_bbox_stats(vecs):
    found = seams.class_boxes(seams.classes(ink(vecs), _flat_seams(vecs)))
    return found.withColumns({"cx": F.round("cx", 6), "cy": F.round("cy", 6)})


@query(
    f"""WITH {_CLASS}, m AS (SELECT page_id, CAST(floor(y / 2) AS INTEGER) AS iy, CAST(floor(x / 2) AS INTEGER) AS ix, y, x, class_id FROM cl) SELECT page_id, iy, ix, arg_max(class_id, y * 8 + x) AS class_id FROM m GROUP BY 1, 2, 3""",
    "embeddings",
)
def restore_by_map_join(vecs):
    cells = seams.classes(ink(vecs), _flat_seams(vecs))
    mapping = as_pages(vecs).select("page_id", "y", "x", F.floor(F.col("y") / 2).cast("int").alias("iy"), F.floor(F.col("x") / 2).cast("int").alias("ix"))
    return seams.restored(cells, mapping)


@query(
    f"""WITH {_CLASS}, p AS (SELECT page_id // 2 AS sheet_id, page_id % 2 AS page_no, y, x, class_id FROM cl), o AS (SELECT sheet_id, max(class_id) AS top FROM p WHERE page_no = 0 GROUP BY 1)
SELECT sheet_id, y, CAST(x + 10 * page_no AS INTEGER) AS x, CAST(class_id + CASE WHEN page_no = 1 THEN coalesce(top, 0) ELSE 0 END AS BIGINT) AS class_id FROM p LEFT JOIN o USING (sheet_id)""",
    "embeddings",
)
def paste_pages(vecs):
    cells = seams.classes(ink(vecs), _flat_seams(vecs)).select(F.expr("page_id div 2").alias("sheet_id"), (F.col("page_id") % 2).alias("page_no"), "y", "x", "class_id")
    windows = cells.select("sheet_id", "page_no").distinct().select("sheet_id", "page_no", (10 * F.col("page_no")).cast("int").alias("x"), F.lit(0).alias("y"))
    return seams.pasted(cells, windows).withColumn("class_id", F.col("class_id").cast("bigint"))


@query(
    f"""WITH {TILE}, p AS (SELECT tile_id AS page_id, y, x, 128 + 100 * v AS v FROM tile), n AS (SELECT a.page_id, a.y, a.x, a.v, b.v AS w, dy, dx FROM p a, (SELECT unnest([-1, 0, 1]) AS dy) , (SELECT unnest([-1, 0, 1]) AS dx), p b
  WHERE b.page_id = a.page_id AND b.y = CASE WHEN a.y + dy < 0 THEN 1 WHEN a.y + dy > 7 THEN 6 ELSE a.y + dy END AND b.x = CASE WHEN a.x + dx < 0 THEN 1 WHEN a.x + dx > 7 THEN 6 ELSE a.x + dx END),
g AS (SELECT page_id, y, x, any_value(v) AS v, sum(dx * (2 - abs(dy)) * w) AS gx, sum(dy * (2 - abs(dx)) * w) AS gy FROM n GROUP BY 1, 2, 3)
SELECT page_id, y, x, round(10 * (255 - v) + 0.5 * sqrt(gx * gx + gy * gy), 4) AS energy FROM g""",
    "embeddings",
)
def energy_matrix(vecs):
    cells = as_pages(vecs).withColumn("v", 128 + 100 * F.col("v"))
    return seams.energy(cells).select("page_id", "y", "x", F.round("energy", 4).alias("energy"))


# --- displacement


@query(f"WITH {TILE} SELECT tile_id AS page_id, x, y, round(0.5 * y + max(3 * abs(v) + y - 0.5 * y) OVER (PARTITION BY tile_id, x ORDER BY y), 6) AS m FROM tile", "embeddings")
def monotone_map(vecs):
    cells = as_pages(vecs).select("page_id", "x", "y", (3 * F.abs("v") + F.col("y")).alias("c"))
    return geometry.monotone(cells, 0.5).select("page_id", "x", "y", F.round("m", 6).alias("m"))


@query(f"WITH {TILE}, s AS (SELECT tile_id AS page_id, x, CAST(y + round_even(2.0 * sin(2 * {math.pi!r} * x / 8.0), 0) AS INTEGER) AS y FROM tile WHERE v > 0) SELECT page_id, y, x FROM s WHERE y BETWEEN 0 AND 7", "embeddings")
def vertical_warp(vecs):
    return geometry.warp(ink(vecs), geometry.displacement("sine", F.col("x"), 8.0, 2.0), 8).select("page_id", "y", "x")


# --- polygons, crops, distances


@query(
    f"""WITH {TILE}, p AS (SELECT tile_id AS page_id, y, x FROM tile WHERE v > 0)
SELECT page_id, y, x, CAST(CASE WHEN y > 1.5 AND y < 6.5 AND x > 2.5 AND x < 7.5 THEN 2 ELSE 1 END AS INTEGER) AS class_id FROM p WHERE (y > 1.5 AND y < 6.5 AND x > 2.5 AND x < 7.5) OR (x > 0.5 AND y > 0.5 AND x + y < 6.25)""",
    "embeddings",
)
def polygon_classes(vecs):
    """A triangle and, over it, a rectangle; where they overlap the rectangle counts."""
    corners = lambda *ps: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ps])
    shapes = F.array(F.struct(F.lit(1).alias("class_id"), corners((0.5, 0.5), (5.75, 0.5), (0.5, 5.75)).alias("points")), F.struct(F.lit(2).alias("class_id"), corners((2.5, 1.5), (7.5, 1.5), (7.5, 6.5), (2.5, 6.5)).alias("points")))
    return geometry.in_polygons(ink(vecs), vecs.select(F.col("vec_id").alias("page_id"), F.inline(shapes)))


@query(
    f"""WITH {ZREGION}, b AS (SELECT r.page_id, r.y0 AS box_id, CAST(r.y0 AS DOUBLE) AS y0, CAST(r.y1 + 1 AS DOUBLE) AS y1, sum(p.hpp * (p.y + 0.5)) / sum(p.hpp) AS mass FROM reg r JOIN prof p ON p.page_id = r.page_id AND p.y BETWEEN r.y0 AND r.y1 GROUP BY 1, 2, 3, 4), h AS (SELECT *, least(mass - y0, y1 - mass) AS h FROM b)
SELECT page_id, box_id, round(CASE WHEN 2 * h >= 2 THEN mass - h ELSE y0 END, 6) AS n0, round(CASE WHEN 2 * h >= 2 THEN mass + h ELSE y1 END, 6) AS n1 FROM h"""
)
def center_mass_crop(docs):
    rows = lines(docs).join(z_regions(docs), "page_id").where("y between y0 and y1")
    boxes = rows.groupBy("page_id", "y0", "y1").agg((F.sum(F.col("hpp") * (F.col("y") + 0.5)) / F.sum("hpp")).alias("mass"))
    boxes = boxes.select("page_id", F.col("y0").alias("box_id"), F.col("y0").cast("double").alias("y0"), (F.col("y1") + 1).cast("double").alias("y1"), "mass")
    return geometry.crop_to_mass(boxes).select("page_id", "box_id", F.round("n0", 6).alias("n0"), F.round("n1", 6).alias("n1"))


@query(f"WITH {_CLASS} SELECT page_id, class_id, min(x) AS x0, max(x) AS x1, round(quantile_cont(y, 0.1), 6) AS y0, CAST(max(y) AS DOUBLE) AS y1, count(*) AS n FROM cl GROUP BY 1, 2", "embeddings")
def top_share_boxes(vecs):
    found = geometry.top_by_share(seams.classes(ink(vecs), _flat_seams(vecs)), 0.9, "page_id", "class_id")
    return found.withColumn("y0", F.round("y0", 6))


@query(
    f"""WITH RECURSIVE {BOX}, v AS (SELECT page_id, x0 AS v FROM box UNION ALL SELECT page_id, x1 FROM box), s AS (SELECT page_id, 0 AS k, min(v) AS a, max(v) AS b, false AS done FROM v GROUP BY 1
UNION ALL SELECT page_id, k + 1, na, nb, abs(na - a) <= 1e-3 AND abs(nb - b) <= 1e-3 FROM (
  SELECT s.page_id, k, a, b, coalesce(avg(v) FILTER (abs(v - a) <= abs(v - b)), a) AS na, coalesce(avg(v) FILTER (abs(v - a) > abs(v - b)), b) AS nb FROM s JOIN v USING (page_id) WHERE k < 30 AND NOT done GROUP BY s.page_id, k, a, b)),
l AS (SELECT page_id, arg_max(a, k) AS a, arg_max(b, k) AS b FROM s GROUP BY 1),
c AS (SELECT page_id, a, b, count(*) FILTER (abs(v - a) <= abs(v - b)) AS n, count(*) FILTER (abs(v - a) > abs(v - b)) AS m, avg(least(abs(v - a), abs(v - b))) AS spread FROM l JOIN v USING (page_id) GROUP BY 1, 2, 3),
t AS (SELECT page_id, (a + b) / 2 AS cut, n < m AS toleft FROM c WHERE least(n, m) / (n + m) BETWEEN 0.05 AND 0.35 AND b - a > spread)
SELECT page_id, box_id, round(CASE WHEN toleft AND x0 < cut AND cut < x1 AND x1 - cut >= 3 THEN cut ELSE x0 END, 6) AS n0, round(CASE WHEN NOT toleft AND x0 < cut AND cut < x1 AND cut - x0 >= 3 THEN cut ELSE x1 END, 6) AS n1 FROM box LEFT JOIN t USING (page_id)"""
)
def side_noise_cut(docs):
    return geometry.side_noise(views.line_boxes(docs)).select("page_id", "box_id", F.round("n0", 6).alias("n0"), F.round("n1", 6).alias("n1"))


@query(
    f"""WITH {TILE}, a AS (SELECT tile_id AS page_id, y, x FROM tile WHERE v > 0), b AS (SELECT tile_id AS page_id, y, x FROM tile WHERE v > 0.2),
t AS (SELECT a.page_id, a.y, a.x, min(sqrt(pow(a.y - b.y, 2) + pow(a.x - b.x, 2))) AS d FROM a JOIN b USING (page_id) GROUP BY 1, 2, 3), u AS (SELECT b.page_id, b.y, b.x, min(sqrt(pow(a.y - b.y, 2) + pow(a.x - b.x, 2))) AS d FROM b JOIN a USING (page_id) GROUP BY 1, 2, 3),
p AS (SELECT DISTINCT page_id FROM a UNION SELECT page_id FROM b), m AS (SELECT page_id, avg(d) AS d FROM t GROUP BY 1), n AS (SELECT page_id, avg(d) AS d FROM u GROUP BY 1)
SELECT page_id, round(coalesce((m.d + n.d) / 2, 8), 6) AS chamfer FROM p LEFT JOIN m USING (page_id) LEFT JOIN n USING (page_id)""",
    "embeddings",
)
def chamfer_distance(vecs):
    """Exact distances; the side of a tile where one of the masks is empty."""
    two = [views.tiles(vecs).where(F.col("v") > low).select(F.col("tile_id").alias("page_id"), "y", "x") for low in (0.0, 0.2)]
    return metrics.chamfer(*two, 2.0, 8.0).select("page_id", F.round("chamfer", 6).alias("chamfer"))


# --- rectification


_CELL = f"{TILE}, ce AS (SELECT tile_id AS page_id, y, x, CAST(y >= 4 AS INTEGER) AS gy, CAST(x >= 4 AS INTEGER) AS gx FROM tile WHERE v > 0)"

_CELL_ANGLE = f"""{_CELL}, an AS (SELECT CAST(unnest(generate_series(-30, 30, 10)) AS DOUBLE) AS angle), cr AS (SELECT page_id, gy, gx, angle, round_even(y - x * tan(radians(angle)), 0) AS r, count(*) AS n FROM ce, an GROUP BY 1, 2, 3, 4, 5),
cs AS (SELECT page_id, gy, gx, angle, round(sum(n * n) / 4 - pow(sum(n) / 4, 2), 9) AS var, sum(n) AS ink FROM cr GROUP BY 1, 2, 3, 4),
ca AS (SELECT page_id, gy, gx, CASE WHEN max(ink) < 4 THEN 0 ELSE greatest(-20, least(20, arg_min(angle, (-var, abs(angle), angle)))) END AS angle FROM cs GROUP BY 1, 2, 3)"""


def _cell_angles(vecs):
    return rectify.cell_angles(ink(vecs), [float(a) for a in range(-30, 31, 10)], 2, 2, 8, 8, least=4, most=20.0)


@query(f"WITH {_CELL_ANGLE} SELECT page_id, gy, gx, CAST(angle AS DOUBLE) AS angle FROM ca", "embeddings")
def grid_cell_angles(vecs):
    return _cell_angles(vecs)


@query(f"WITH {_CELL_ANGLE} SELECT page_id, CAST(round_even(y - (x - gx * 4) * CASE WHEN abs(angle) <= 0.25 THEN 0 ELSE tan(radians(angle)) END, 0) AS INTEGER) AS y, count(*) AS hpp FROM ce JOIN ca USING (page_id, gy, gx) GROUP BY 1, 2", "embeddings")
def slanted_hpp(vecs):
    return rectify.slanted_profile(ink(vecs), _cell_angles(vecs), 2, 2, 8, 8)


@query(None, "embeddings")
def local_warp(vecs):
    """No SQL twin: cubic resampling and a running sum by row. Tested on sheared lines."""
    moved = rectify.straightened(ink(vecs), _cell_angles(vecs), 2, 2, 8, 8)
    return moved.groupBy("page_id", "y").agg(F.count("*").alias("hpp"))


@query(
    f"""WITH {TILE}, g AS (SELECT tile_id AS page_id, y, x, CAST(least(255, greatest(0, round_even(128 + 400 * v, 0))) AS INTEGER) AS v, y // 4 AS ty, x // 4 AS tx FROM tile), n AS (SELECT page_id, ty, tx, v, count(*) AS n FROM g GROUP BY 1, 2, 3, 4),
k AS (SELECT *, least(n, 1.0) AS kept FROM n), c AS (SELECT *, sum(kept) OVER (PARTITION BY page_id, ty, tx ORDER BY v) + sum(n - kept) OVER (PARTITION BY page_id, ty, tx) * (v + 1) / 256 AS below, sum(n) OVER (PARTITION BY page_id, ty, tx) AS total FROM k),
e AS (SELECT page_id, ty, tx, v, round_even(255 * least(1, below / total), 0) AS e FROM c)
SELECT page_id, y, x, CAST(round_even(255 * pow(e.e / 255, 0.8), 0) AS INTEGER) AS v FROM g JOIN e USING (page_id, ty, tx, v)""",
    "embeddings",
)
def contrast_by_tile(vecs):
    grey = as_pages(vecs).withColumn("v", F.least(F.lit(255), F.greatest(F.lit(0), F.rint(128 + 400 * F.col("v")))).cast("int"))
    return rectify.equalised(grey, clip=2.0, tiles=2, gamma=0.8, height=8, width=8)


@query(
    f"""WITH {TILE}, i AS (SELECT tile_id AS page_id, y, x FROM tile WHERE v > 0), p AS (SELECT 0 AS angle, page_id, y AS k, count(*) AS n FROM i GROUP BY 2, 3 UNION ALL SELECT 90, page_id, x, count(*) FROM i GROUP BY 2, 3),
q AS (SELECT *, CASE WHEN lag(k) OVER w = k - 1 THEN lag(n) OVER w ELSE 0 END AS a, CASE WHEN lead(k) OVER w = k + 1 THEN lead(n) OVER w ELSE 0 END AS b, max(n) OVER (PARTITION BY angle, page_id) AS m FROM p WINDOW w AS (PARTITION BY angle, page_id ORDER BY k)),
c AS (SELECT page_id, angle, count(*) FILTER (n - greatest(a, b) >= 0.1 * m) AS peaks FROM q GROUP BY 1, 2)
SELECT page_id, CAST(arg_min(angle, (-peaks, angle)) AS INTEGER) AS angle FROM c GROUP BY 1""",
    "embeddings",
)
def best_orientation(vecs):
    return rectify.orientation(ink(vecs))


# --- folds over a page's lines


@query(
    f"""WITH RECURSIVE {_YMID}, o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y_mid, line_id) AS k FROM ln),
f AS (SELECT page_id, k, line_id AS anchor, y_mid AS first FROM o WHERE k = 1 UNION ALL SELECT o.page_id, o.k, CASE WHEN o.y_mid - f.first < 6 THEN f.anchor ELSE o.line_id END, CASE WHEN o.y_mid - f.first < 6 THEN f.first ELSE o.y_mid END FROM f JOIN o ON o.page_id = f.page_id AND o.k = f.k + 1)
SELECT page_id, CAST(anchor AS BIGINT) AS line_id, any_value(first) AS first, CAST(count(*) AS INTEGER) AS n FROM f GROUP BY page_id, anchor"""
)
def anchored_merge(docs):
    return hough.anchored_groups(_mids(docs).withColumn("most", F.lit(6.0)), F.col("most"))


@query()
def running_mean_groups(docs):
    """No SQL twin: each row is compared with the mean of its group so far. Tested by hand."""
    rows = z_regions(docs).select("page_id", F.col("y0").alias("comp_id"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    return hough.mean_groups(rows, 3.0).select("page_id", "group", F.round("mean", 6).alias("mean"), F.size("comp_ids").alias("n"))


def _height_bins(name: str, of: str) -> str:
    return f"""{name}h AS (SELECT page_id, w AS h, count(*) OVER p AS n, min(w) OVER p AS a, max(w) OVER p AS b FROM {of} WINDOW p AS (PARTITION BY page_id)),
{name}k AS (SELECT *, floor(n / 10) AS bins, (b - a) / floor(n / 10) AS w FROM {name}h WHERE n >= 20 AND b > a), {name}c AS (SELECT page_id, least(bins - 1, floor((h - a) / w)) AS k, a, w, count(*) AS c FROM {name}k GROUP BY ALL),
{name} AS (SELECT page_id, arg_min(a + (k + 0.5) * w, (-c, k)) AS ah FROM {name}c WHERE k > 0 GROUP BY 1)"""


@query(f"WITH {WORD}, {_height_bins('hi', '(SELECT * FROM word WHERE w > 4)')}, {_height_bins('al', 'word')}, m AS (SELECT page_id, avg(w) AS mean FROM word GROUP BY 1) SELECT page_id, round(coalesce(hi.ah, al.ah, mean), 6) AS ah FROM m LEFT JOIN hi USING (page_id) LEFT JOIN al USING (page_id)")
def ah_histogram(docs):
    found = components.character_height_bins(words(docs).select("page_id", F.col("w").alias("h")))
    return found.select("page_id", F.round("ah", 6).alias("ah"))


@query(None, "embeddings")
def detect_tile_lines(vecs):
    """No SQL twin: profile, regions, traced seams, classes and boxes of every tile. Tested on
    generated pages."""
    return detectors.by_profile(ink(vecs), 8, 8)


@query(None, "embeddings")
def detect_tile_lines_two_kernels(vecs):
    """No SQL twin: searched seams. Tested on generated pages."""
    return detectors.by_two_kernels(ink(vecs), 8, 8, 5, 3, least=2)


@query(None, "embeddings")
def detect_tile_lines_hough(vecs):
    """No SQL twin: labelling and peaks. Tested on generated pages."""
    return detectors.by_hough(ink(vecs), 8, 8, block=2, step=1.0, least=2, second=2)


def detector_scores(spark, sf_dir: str) -> DataFrame:
    """Generated pages through the three detectors: micro-averaged figures by detector. No table
    is read and no SQL twin exists."""
    made = synthesis.pages(spark, 12, width=160, height=200, lines=(5, 9))
    cells = made.select("page_id", "y", "x").distinct()
    box = lambda c, plus: (c + plus).cast("double")
    targets = made.groupBy("page_id", F.col("line_id").cast("bigint").alias("box_id")).agg(box(F.min("x"), 0).alias("x0"), box(F.min("y"), 0).alias("y0"), box(F.max("x"), 1).alias("x1"), box(F.max("y"), 1).alias("y1"))
    found = {
        "profile": detectors.by_profile(cells, 200, 160), "two kernels": detectors.by_two_kernels(cells, 200, 160, 5, 3, tall=9.0),
        "hough": detectors.by_hough(cells, 200, 160, fraction=0.3, radius=3),
    }
    rows = [detectors.evaluated(b, targets).select(F.lit(k).alias("detector"), "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "hmean")]) for k, b in found.items()]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


QUERIES["detector_scores"] = detector_scores


def synthetic_distortion(spark, sf_dir: str) -> DataFrame:
    """Generated pages, distorted and straightened again: the share of ink that comes back, by
    kind. No table is read and no SQL twin exists."""
    made = synthesis.pages(spark, 20).drop("line_id", "y0", "y1").distinct()
    out = None
    for kind in synthesis.KINDS:
        back = synthesis.straightened(synthesis.distorted(made, kind, 256, 320), kind, 256, 320)
        both = made.join(back.distinct(), ["page_id", "x", "y"]).agg(F.count("*").alias("same"))
        row = made.agg(F.count("*").alias("n")).crossJoin(both).select(F.lit(kind).alias("kind"), F.round(F.col("same") / F.col("n"), 6).alias("restored"))
        out = row if out is None else out.unionAll(row)
    return out


QUERIES["synthetic_distortion"] = synthetic_distortion
