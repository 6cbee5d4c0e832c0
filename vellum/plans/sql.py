"""Fragments of DuckDB SQL that the oracles share: the raster views of vellum.sources.views."""

from __future__ import annotations

PAGE_LINE = """page_line AS (SELECT doc_id AS page_id, CAST(unnest(generate_series(0, len(l) - 1)) AS INTEGER) AS y, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
prof AS (SELECT page_id, y, line, CAST(length(replace(line, ' ', '')) AS INTEGER) AS hpp FROM page_line)"""

TILE = """tile AS (SELECT vec_id AS tile_id, label, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(embedding[i + 1] AS DOUBLE) AS v FROM (SELECT vec_id, label, embedding, unnest(generate_series(0, 63)) AS i FROM embeddings)),
tprof AS (SELECT tile_id AS page_id, y, CAST(count(*) FILTER (v > 0) AS INTEGER) AS hpp FROM tile GROUP BY 1, 2)"""

ZREGION = (
    PAGE_LINE
    + """,
zs AS (SELECT page_id, y, hpp, CASE WHEN stddev_pop(hpp) OVER (PARTITION BY page_id) > 1e-9 THEN (hpp - avg(hpp) OVER (PARTITION BY page_id)) / stddev_pop(hpp) OVER (PARTITION BY page_id) ELSE 0 END AS z FROM prof),
isl AS (SELECT page_id, y, y - row_number() OVER (PARTITION BY page_id ORDER BY y) AS r FROM zs WHERE z > 0),
reg AS (SELECT page_id, CAST(min(y) AS INTEGER) AS y0, CAST(max(y) AS INTEGER) AS y1 FROM isl GROUP BY page_id, r)"""
)

BOX = (
    PAGE_LINE
    + """,
box AS (SELECT page_id, y AS box_id, CAST(length(line) - length(ltrim(line, ' ')) AS DOUBLE) AS x0, CAST(y AS DOUBLE) AS y0, CAST(length(rtrim(line, ' ')) AS DOUBLE) AS x1, CAST(y + 1 AS DOUBLE) AS y1 FROM prof WHERE hpp > 0)"""
)

WORD = (
    PAGE_LINE
    + """,
parts AS (SELECT page_id, y, string_split(line, ' ') AS p FROM page_line),
cut AS (SELECT page_id, y, CAST(unnest(generate_series(0, len(p) - 1)) AS INTEGER) AS i, unnest(p) AS word FROM parts),
word AS (SELECT page_id, y, CAST(off AS INTEGER) AS x, CAST(length(word) AS INTEGER) AS w FROM (SELECT page_id, y, i, word, coalesce(sum(length(word) + 1) OVER (PARTITION BY page_id, y ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM cut) WHERE word <> '')"""
)
