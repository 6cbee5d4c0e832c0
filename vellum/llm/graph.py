"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum import runtime


CHUNK_EDGES = 1 << 20
LEAST_TASKS, MERGED, SALTS = 8, 16, 16
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _stars(edges: np.ndarray) -> np.ndarray:
    """Edges (2 rows) from each node to the smallest one that these edges let it reach."""
    nodes, ends = np.unique(edges, return_inverse=True)
    a, b = ends.reshape(edges.shape)
    root = np.arange(len(nodes))
    while (low := np.minimum(root[a], root[b]) < np.maximum(root[a], root[b])).any():
        a, b = a[low], b[low]
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
    tied = np.flatnonzero(root != np.arange(len(nodes)))
    return np.stack([nodes[tied], nodes[root[tied]]])


def _thinned(batches, chunk: int):
    """A task's edges as stars of the same connections. Holds about two chunks of edges: where
    their stars are half a chunk or more, these go out and the next ones start anew."""
    held, n = [np.zeros((2, 0), np.int64)], 0
    for batch in batches:
        held.append(np.stack([np.asarray(c, np.int64) for c in batch.columns]))
        n += batch.num_rows
        if n >= chunk:
            stars = _stars(np.concatenate(held, axis=1))
            if full := 2 * stars.shape[1] >= chunk:
                yield pa.record_batch([*map(pa.array, stars)], schema=_EDGES)
            held, n = ([], 0) if full else ([stars], stars.shape[1])
    if n:
        yield pa.record_batch([*map(pa.array, _stars(np.concatenate(held, axis=1)))], schema=_EDGES)


def _large_star(edges: DataFrame) -> DataFrame:
    """edges(a > b): every a is tied to the smallest neighbour of its b, or to b itself. Only
    nodes that are some edge's smaller end and have a smaller neighbour are looked up, `SALTS`
    times each, so a hub's edges go to as many tasks."""
    smaller = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "c")
    lows = edges.select(F.col("b").alias("c")).distinct()
    moving = smaller.join(lows, "c", "left_semi").select(F.col("c").alias("b"), "m", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("s"))
    salted = edges.withColumn("s", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
    return salted.join(moving, ["b", "s"], "left").select("a", F.coalesce("m", "b").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges(a > b): the smaller neighbours of a, and a, are tied to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, chunk: int = CHUNK_EDGES) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node it reaches. First each
    task replaces its part of the edges, where it lies, by stars that connect the same nodes, so
    what many edges say of one group costs about its nodes; such a task takes `MERGED` shuffle
    partitions. Each round is written to the shared folder, by one task for each quarter of a
    chunk of edges; there are about as many rounds as the logarithm of the nodes.
    Null ends and loops are ignored. A hub's edges are summed on the map side and joined in
    salted parts."""
    spark = edges.sparkSession
    runtime.ship(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    thin = lambda batches: _thinned(batches, chunk)
    edges = runtime.stored(ends.coalesce(max(LEAST_TASKS, partitions // MERGED)).mapInArrow(thin, "a bigint, b bigint"), "thinned")
    sign, n = None, edges.count()
    while n:
        edges = runtime.stored(_small_star(_large_star(edges)).coalesce(max(LEAST_TASKS, 4 * n // chunk)), "stars")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == sign:
            break
        sign, n = now, now[0]
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionAll(stars.select(F.col("root").alias("node"), "root").distinct())
