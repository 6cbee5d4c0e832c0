"""Raster views: the given tables read as pages, tiles, boxes and components.

A page is a text document: a line is a row of pixels and every character but the space is ink. A
profile needs a count per row only, so characters aren't exploded for it. A tile is an embedding
of 64 numbers as 8 rows of 8 values, ink where the value is above zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TILE = 8


def page_lines(documents: DataFrame) -> DataFrame:
    """(page_id, y, line, hpp): hpp is the number of ink characters of the row."""
    rows = documents.select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n", -1)).alias("y", "line"))
    return rows.withColumn("hpp", F.length(F.replace("line", F.lit(" "), F.lit(""))))


def page_ink(documents: DataFrame) -> DataFrame:
    """(page_id, y, x), one row per ink character. For operators that need x only."""
    chars = page_lines(documents).select("page_id", "y", F.posexplode(F.split("line", "")).alias("x", "c"))
    return chars.where("c <> ' ' and c <> ''").select("page_id", "y", "x")


def page_words(documents: DataFrame) -> DataFrame:
    """(page_id, y, x, w, h, area): the words of a line as components one row high. x is a running
    sum of the lengths before, by a window: linear in the words of a line, however long it is."""
    parts = page_lines(documents).select("page_id", "y", F.posexplode(F.split("line", " ", -1)).alias("i", "word"))
    before = Window.partitionBy("page_id", "y").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("word")
    placed = parts.withColumn("x", F.coalesce(F.sum(size + 1).over(before), F.lit(0)).cast("int"))
    return placed.where(size > 0).select("page_id", "y", "x", size.alias("w"), F.lit(1).alias("h"), size.alias("area"))


def in_pieces(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut where the bytes of a column of texts pass `most`; a longer text stands alone."""
    for batch in batches:
        ends = np.cumsum(pa.compute.binary_length(batch[text]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            held = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, held + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def words_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, y, x, w) of the words of whole texts, as page_words has them, in order; null has none.
    In an Arrow function it takes the place of that window, which shuffles every word."""
    text = text.fill_null("").cast(pa.large_binary())
    _, ends, data = text.buffers()
    at = np.frombuffer(ends, np.int64)[text.offset : text.offset + len(text) + 1]
    b = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    full = at[:-1] < at[1:]
    blank = (b == 32) | (b == 10)
    first, last = np.ones(len(b), bool), np.ones(len(b), bool)
    first[1:], last[:-1] = blank[:-1], blank[1:]
    first[at[:-1][full]] = last[at[1:][full] - 1] = True
    starts, stops = np.flatnonzero(first & ~blank), np.flatnonzero(last & ~blank) + 1
    # characters before each byte: those that go on a character count for none
    chars = np.zeros(len(b) + 1, np.int64)
    np.cumsum((b & 0xC0) != 0x80, out=chars[1:])
    breaks = np.flatnonzero(b == 10)
    row = np.searchsorted(at, starts, "right") - 1
    before = np.searchsorted(breaks, starts)
    line = np.maximum(at[row], np.concatenate([[0], breaks + 1])[before])
    return row, before - np.searchsorted(breaks, at[:-1])[row], chars[starts] - chars[line], chars[stops] - chars[starts]


def tiles(embeddings: DataFrame) -> DataFrame:
    """(tile_id, label, y, x, v)."""
    cells = embeddings.select(F.col("vec_id").alias("tile_id"), "label", F.posexplode("embedding").alias("i", "v"))
    return cells.select("tile_id", "label", (F.floor(F.col("i") / TILE)).cast("int").alias("y"), (F.col("i") % TILE).alias("x"), F.col("v").cast("double").alias("v"))


def tile_ink(embeddings: DataFrame) -> DataFrame:
    return tiles(embeddings).where("v > 0").select("tile_id", "label", "y", "x")


def tile_cells(embeddings: DataFrame) -> DataFrame:
    """(tile_id, cells): the ink of a tile as one list, straight from the array."""
    cell = lambda v, i: F.when(v > 0, F.struct(F.floor(i / TILE).cast("int").alias("y"), (i % TILE).alias("x")))
    cells = F.filter(F.transform("embedding", cell), lambda c: c.isNotNull())
    return embeddings.select(F.col("vec_id").alias("tile_id"), cells.alias("cells")).where(F.size("cells") > 0)


def tile_profile(embeddings: DataFrame) -> DataFrame:
    """(page_id, y, hpp): ink cells of each tile row, zeros included, straight from the array."""
    row = lambda y: F.size(F.filter(F.slice("embedding", y * TILE + 1, TILE), lambda v: v > 0))
    rows = F.transform(F.sequence(F.lit(0), F.lit(TILE - 1)), row)
    return embeddings.select(F.col("vec_id").alias("page_id"), F.posexplode(rows).alias("y", "hpp"))


def line_boxes(documents: DataFrame) -> DataFrame:
    """(page_id, box_id, x0, y0, x1, y1): the ink extent of each line that has any."""
    lines = page_lines(documents).where("hpp > 0")
    left = F.length("line") - F.length(F.ltrim("line"))
    return lines.select("page_id", F.col("y").alias("box_id"), left.cast("double").alias("x0"), F.col("y").cast("double").alias("y0"), F.length(F.rtrim("line")).cast("double").alias("x1"), (F.col("y") + 1).cast("double").alias("y1"))
