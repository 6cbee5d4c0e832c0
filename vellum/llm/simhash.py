"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

A document's 64-bit fingerprint has a bit set where more than half of the XXH64 values of its
word shingles have it. Two documents are linked where at most `radius` bits differ.

Links are found through structured masks. Every bit place gets a vector of radius+1 binary
digits, not all zero. For every non-zero v of such digits there is a table, whose mask keeps the
places with an odd inner product with v. The vectors of at most `radius` differing places lie in
a space of at most `radius` dimensions, so some v is orthogonal to all of them, and in its table
the pair shares a key: no pair within the radius is missed, whatever the data.

Equal fingerprints are one node from the start, so exact copies cost one row. A table's bucket
yields the edges of a spanning forest, found by growing components over the nodes not reached
yet, never the list of its pairs. A bucket of more than `most` fingerprints is dealt into
chunks; each pair of chunks is one group, so no task holds more than two chunks, and no pair of
fingerprints goes uncompared.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; a null id
is passed over for the smallest id (the component of null ids alone is null); repeated rows
appear as often as they came; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum import runtime
from vellum.llm.common import LOWER_ASCII, columns, doc_key, fresh, utf8
from vellum.llm.graph import components

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
BUCKET_MOST = 100_000


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of every word shingle, in order; a shorter text is one shingle, one without words has none."""
    words = text.translate(LOWER_ASCII).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends)), np.uint64, n)


def fingerprint(text: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    hashes = shingle_hashes(text, shingle)
    n = len(hashes)
    if not n:
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, n, 65536):  # bounds the unpacked bits of a very long text
        total += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, key, fp): key parts rows of one id with different texts; fp is the fingerprint's
    bits as a signed long."""
    runtime.ship(docs.sparkSession)
    arrow = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in utf8(batch.column(2))], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found)], schema=arrow)

    rows = columns(docs, doc_id=docs[id_col].cast("bigint"), key=doc_key(docs[text_col]), text=text_col)
    return rows.mapInArrow(run, "doc_id bigint, key bigint, fp bigint")


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """One mask per table; 2^(radius+1) - 1 tables."""
    vectors = [1 + i % ((2 << radius) - 1) for i in range(bits)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, 2 << radius)]


def _forest(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that tie each component of the points (distinct, linked within the radius) to its
    first point. Every point is compared with those not reached when its turn comes."""
    left = points
    tied, roots = [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        turn = [root]
        while turn and len(left):
            near = np.bitwise_count(left ^ turn.pop()) <= radius
            if near.any():
                reached, left = left[near], left[~near]
                tied.append(reached)
                roots.append(np.full(len(reached), root))
                turn.extend(reached)
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(tied), np.concatenate(roots)) if tied else (empty, empty)


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _bucket_edges(batches, radius: int):
    """batches: (bucket columns..., fp), sorted by bucket. Emits edges; holds one bucket at most."""
    keys, fps = None, np.zeros(0, np.uint64)
    for batch in batches:
        more = np.stack([np.asarray(batch.column(i), np.int64) for i in range(batch.num_columns - 1)])
        keys = more if keys is None else np.concatenate([keys, more], axis=1)
        fps = np.concatenate([fps, np.asarray(batch.column(batch.num_columns - 1), np.int64).view(np.uint64)])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        if len(cuts):  # the last bucket may go on in the next batch
            yield _forests(fps, np.concatenate([[0], cuts]), radius)
            keys, fps = keys[:, cuts[-1] :], fps[cuts[-1] :]
    yield _forests(fps, np.array([0, len(fps)]), radius)


def _forests(fps: np.ndarray, runs: np.ndarray, radius: int) -> pa.RecordBatch:
    found = [_forest(np.unique(fps[runs[i] : runs[i + 1]]), radius) for i in np.flatnonzero(np.diff(runs) > 1)]
    ends = [np.concatenate([np.zeros(0, np.uint64), *x]) for x in zip(*found)] or [np.zeros(0, np.uint64)] * 2
    return pa.record_batch([pa.array(x.view(np.int64)) for x in ends], schema=_EDGES)


def links(points: DataFrame, radius: int = RADIUS, most: int = BUCKET_MOST) -> DataFrame:
    """Edges (a, b) over the distinct longs of points(fp), such that all that lie within the
    radius of each other are connected."""
    spark = points.sparkSession
    runtime.ship(spark)
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m - (1 << 64) if m >> 63 else m).alias("m")) for t, m in enumerate(masks(radius))]))
    keyed = points.select("fp", tables.alias("x")).select(F.col("x.t").cast("bigint").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"), "fp")
    large = runtime.stored(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > most), "buckets")
    run = lambda batches: _bucket_edges(batches, radius)
    if large.isEmpty():
        return keyed.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(run, "a bigint, b bigint")
    small = keyed.join(large, ["t", "key"], "left_anti")
    chunks = F.ceil(F.col("n") / most).cast("bigint")
    dealt = keyed.join(large, ["t", "key"]).withColumn("n", chunks).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("n")))
    others = F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), lambda o: F.struct(F.least("c", o).alias("lo"), F.greatest("c", o).alias("hi"))))
    pairs = dealt.select("t", "key", others.alias("p"), "fp").select("t", "key", "p.lo", "p.hi", "fp")
    parts = [df.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a bigint, b bigint") for df, by in ((small, ["t", "key"]), (pairs, ["t", "key", "lo", "hi"]))]
    return parts[0].unionAll(parts[1])


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, radius: int = RADIUS, most: int = BUCKET_MOST) -> DataFrame:
    """(doc_id, key, fp, root, component_id) per row of docs: root is the component's smallest
    fingerprint as a signed long, component_id its smallest doc_id."""
    prints = runtime.stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    points = runtime.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    found = components(links(points.select("fp"), radius, most))
    rooted = points.join(found, points["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.select("fp", "root").join(smallest, "root")
    return prints.join(classes, "fp").select("doc_id", "key", "fp", "root", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op2(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group, with all its columns: the one of the smallest doc_id (null comes
    last; among rows of one id, the one whose text has the smallest hash; among rows of one id
    and text, the one whose other columns have)."""
    return first_rows(docs, groups(docs))


def first_rows(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The rows of docs that come first in their root of grouped(doc_id, key, root)."""
    id_, key, tie = fresh(docs, "id", "key", "tie")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    kept = grouped.groupBy("root").agg(first.alias("x")).select(F.coalesce("x.doc_id", "x.key").alias(id_), F.col("x.key").alias(key))
    keyed = docs.withColumn(key, doc_key(docs["text"])).withColumn(id_, F.coalesce(docs["doc_id"].cast("bigint"), F.col(key)))
    chosen = keyed.join(kept, [id_, key], "left_semi")
    others = [docs[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString() and f.name != "text"]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    least = chosen.withColumn(tie, F.xxhash64(*others)).groupBy(id_, key).agg(F.min_by(whole, F.col(tie)).alias(tie))
    return least.select(*[F.col(tie)[c].alias(c) for c in docs.columns])
