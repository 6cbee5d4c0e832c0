"""SimHash near-dedup of whole corpora: covering tables over wide fingerprints, and every group
checked on the shingles themselves.

Two documents are linked where the Jaccard similarity of their sets of 5-word shingles is 0.8 or
more. At that similarity about 15 % of SimHash bits differ, far more than the 4 of 64 that
operator 2's digests allow. So the same method runs over a fingerprint of 256 bits:

1. The fingerprint's bits are dealt into `PIECES` pieces of `PIECE_BITS` bits (a bit can be in
   several). Each piece has the structured masks of `simhash.masks`: every pair that differs in at
   most `RADIUS` bits of any piece shares a key, whatever the data. Of pairs at a similarity of
   exactly 0.8, 1.1 % share none (0.1 % at 0.85, none of 4000 at 0.9; simulated). A key has about
   17 bits; for corpora much beyond 10^9 documents take longer pieces, and more of them.
2. In a bucket, those whose first 128 bits differ in at most `MOST_BITS` are candidates (pairs at
   0.8 differ in 19, standard deviation 4; unrelated ones in 64, deviation 6). A bucket yields a
   spanning forest, not its pairs; one of more than about `bucket` fingerprints is dealt into
   chunks, and each pair of chunks is one group.
3. Components of candidates are groups. Their texts meet once, and the links are decided by the
   shingle sets: no pair below the threshold is linked, and members that shared no key are still
   compared. A group of more than `most` shingles is dealt into chunks; what they leave apart is
   compared by one member of each part, and then whole: the largest part's chunks against all
   others, and these among themselves. Chunks of one part needn't meet.

Equal sets are one node from the start, so exact copies cost one row.

Defined cases: texts without words are one group; a text shorter than a shingle is one shingle;
ids, repeated rows and other columns as in `simhash`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum import runtime
from vellum.llm.common import columns, doc_key, in_pieces, utf8
from vellum.llm.graph import components
from vellum.llm.simhash import first_rows, masks, shingle_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
PIECES, PIECE_BITS, RADIUS = 22, 30, 2
MOST_BITS = 36
BUCKET_MOST = 100_000
#: Buckets are sized up on one point in so many.
SIZED = 64
GROUP_SHINGLES = 2_000_000
TEXT_BYTES = 4 << 20
_WORDS = 4
_ODD = np.random.RandomState(42).randint(0, 1 << 63, _WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE_WORDS))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """256 bits as four words: a bit is set where more than half of the hashes have it."""
    total = np.zeros(64 * _WORDS, np.int64)
    for i in range(0, len(hashes), 16384):  # bounds the unpacked bits of a very long text
        words = _mixed(hashes[i : i + 16384, None] * _ODD)
        total += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")


def _point(f0: np.ndarray, f1: np.ndarray) -> np.ndarray:
    """A number for the first 128 bits."""
    return _mixed(_mixed(f0) * np.uint64(0xBF58476D1CE4E5B9) + f1)


def tables(pieces: int = PIECES, bits: int = PIECE_BITS, radius: int = RADIUS) -> np.ndarray:
    """The masks of all tables, each as four words."""
    r, out = np.random.RandomState(7), []
    for _ in range(pieces):
        places = r.permutation(64 * _WORDS)[:bits]
        for mask in masks(radius, bits):
            chosen = np.zeros(64 * _WORDS, np.uint8)
            chosen[places[[b for b in range(bits) if mask >> b & 1]]] = 1
            out.append(np.packbits(chosen, bitorder="little").view("<u8"))
    return np.array(out)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, key, node, n, f0 .. f3, point) per row of docs: node stands for its set of n shingles."""
    runtime.ship(docs.sparkSession)
    names = ["doc_id", "key", "node", "n", "f0", "f1", "f2", "f3", "point"]

    def run(batches):
        for batch in in_pieces(batches, 2, TEXT_BYTES):
            sets = [shingle_set(t) for t in utf8(batch.column(2))]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64)
            prints = np.array([wide_fingerprint(s) for s in sets], np.uint64).reshape(-1, _WORDS)
            made = [nodes.view(np.int64), np.array([len(s) for s in sets]), *np.ascontiguousarray(prints.T).view(np.int64), _point(prints[:, 0], prints[:, 1]).view(np.int64)]
            yield pa.record_batch([batch.column(0), batch.column(1), *map(pa.array, made)], names=names)

    rows = columns(docs, doc_id=docs["doc_id"].cast("bigint"), key=doc_key(docs["text"]), text="text")
    return rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def _near(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    return np.bitwise_count(f ^ g).sum(axis=-1, dtype=np.int32) <= MOST_BITS


def _forest(points: np.ndarray) -> list[tuple[int, int]]:
    """Edges between row numbers of points that tie each candidate component to its first point."""
    left, edges = np.arange(len(points)), []
    while len(left) > 1:
        root, left = left[0], left[1:]
        turn = [root]
        while turn and len(left):
            near = _near(points[left], points[turn.pop()])
            turn.extend(left[near].tolist())
            edges += [(root, i) for i in left[near].tolist()]
            left = left[~near]
    return edges


def _bucket_pairs(keys: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) of one bucket that are candidates: all pairs of small buckets, found over all
    buckets at once by the distance between rows, and a forest of each larger one."""
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    runs = np.concatenate([[0], cuts, [len(keys)]])
    size = np.diff(runs)
    left, right = [], []
    of = np.repeat(size, size)
    small = np.flatnonzero((of > 1) & (of <= 8))
    if len(small):
        k, p = keys[small], points[small]
        for lag in range(1, 8):
            same = np.flatnonzero(k[lag:] == k[:-lag])
            if not len(same):
                break
            same = same[_near(p[same], p[same + lag])]
            left.append(small[same])
            right.append(small[same + lag])
    for r in np.flatnonzero(size > 8):
        a, b = runs[r], runs[r + 1]
        distinct = np.unique(points[a:b], axis=0, return_index=True)[1]
        if edges := _forest(points[a:b][distinct]):
            left.append(a + distinct[[x for x, _ in edges]])
            right.append(a + distinct[[y for _, y in edges]])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _bucket_edges(batches):
    """batches: (key, f0, f1), sorted by key, to candidate edges between points."""
    rows = np.zeros((3, 0), np.int64)

    def edges(done: np.ndarray) -> pa.RecordBatch:
        points = np.ascontiguousarray(done[1:].T).view(np.uint64)
        numbers = _point(points[:, 0], points[:, 1]).view(np.int64)
        a, b = _bucket_pairs(done[0], points)
        pairs = np.stack([np.minimum(numbers[a], numbers[b]), np.maximum(numbers[a], numbers[b])])
        pairs = np.unique(pairs[:, pairs[0] != pairs[1]], axis=1)
        return pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], schema=_EDGES)

    held: list[np.ndarray] = []
    n = 0
    for batch in batches:
        held.append(np.stack([np.asarray(c, np.int64) for c in batch.columns]))
        n += batch.num_rows
        if n >= 1 << 18 and held[-1][0, -1] != held[0][0, 0]:  # the last bucket may go on
            rows = np.concatenate(held, axis=1)
            cut = np.searchsorted(rows[0], rows[0, -1])
            yield edges(rows[:, :cut])
            held, n = [rows[:, cut:]], rows.shape[1] - cut
    if held:
        yield edges(np.concatenate(held, axis=1))


def candidates(points: DataFrame, bucket: int = BUCKET_MOST) -> DataFrame:
    """Edges (a, b) between the numbers of points(f0 .. f3)."""
    signed = [[int(w) for w in t] for t in tables().view(np.int64)]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), *[F.lit(w).alias(f"m{j}") for j, w in enumerate(t)]) for i, t in enumerate(signed)]))
    masked = [F.col(f"f{j}").bitwiseAND(F.col(f"x.m{j}")) for j in range(_WORDS)]

    def keyed(some: DataFrame) -> DataFrame:
        return some.select("f0", "f1", "f2", "f3", each.alias("x")).select(F.xxhash64(F.col("x.t"), *masked).alias("k"), "f0", "f1")

    def met(rows: DataFrame) -> DataFrame:
        return rows.repartition("k").sortWithinPartitions("k").mapInArrow(_bucket_edges, "a bigint, b bigint")

    share = max(1, min(SIZED, bucket // 16))
    sized = keyed(points.where(F.pmod(F.xxhash64("f0", "f1"), F.lit(share)) == 0)).groupBy("k").agg((F.count("*") * share).alias("n"))
    large = runtime.stored(sized.where(F.col("n") > bucket // 2), "buckets")
    if large.isEmpty():
        return met(keyed(points))
    rows = keyed(points)
    dealt = rows.join(large, "k").withColumn("n", F.ceil(F.col("n") * 2 / bucket)).withColumn("c", F.pmod(F.xxhash64("f0", "f1"), F.col("n")))
    others = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("o")
    pairs = dealt.select("k", "c", "f0", "f1", others).select(F.xxhash64("k", F.least("c", "o"), F.greatest("c", "o")).alias("k"), "f0", "f1")
    return met(rows.join(large, "k", "left_anti")).unionAll(met(pairs))


def forest(nodes: list[int], sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Edges that tie each component of the sets (sorted, distinct) to its first node. Shared
    shingles are counted through the list of sets that hold each shingle."""
    sizes = np.array([len(s) for s in sets])
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(place, kind="stable")]
    until = np.cumsum(np.bincount(place))
    own = np.split(place, np.cumsum(sizes)[:-1])
    left = np.ones(len(sets), bool)
    edges = []
    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root] = False
        turn = [root]
        while turn and left.any():
            x = turn.pop()
            held = [owner[(until[i - 1] if i else 0) : until[i]] for i in own[x].tolist()]
            common = np.bincount(np.concatenate(held), minlength=len(sets))
            near = np.flatnonzero(left & (common >= similarity * (sizes + sizes[x] - common)))
            left[near] = False
            turn.extend(near.tolist())
            edges += [(nodes[root], nodes[i]) for i in near]
    return edges


def _checked_edges(batches):
    """(part, node, text), sorted by part, to edges; holds one part's sets at most."""
    now, nodes, sets = None, [], []
    for batch in in_pieces(batches, 2, TEXT_BYTES):
        found = []
        for part, node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
            if part != now:
                found += forest(nodes, sets) if len(nodes) > 1 else []
                now, nodes, sets = part, [], []
            nodes.append(node)
            sets.append(shingle_set(text))
        yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*found) if found else ((), ()))], schema=_EDGES)
    found = forest(nodes, sets) if len(nodes) > 1 else []
    yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*found) if found else ((), ()))], schema=_EDGES)


def _checked(parts: DataFrame, texts: DataFrame) -> DataFrame:
    """parts(part, node, key): the edges between nodes of a part."""
    met = parts.join(texts, "key").select("part", "node", "text").repartition("part").sortWithinPartitions("part")
    return met.mapInArrow(_checked_edges, "a bigint, b bigint")


def _chunk(name, total: str, most: int):
    return F.pmod(F.xxhash64(name), F.ceil(F.col(total) / most))


def _labelled(members: DataFrame, edges: DataFrame) -> DataFrame:
    found = components(edges)
    return members.join(found, "node", "left").select("g", "node", "n", "key", F.coalesce("root", "node").alias("label"))


def _links(members: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """members(g, node, n, key, total): edges that connect all members of a group g whose
    similarity links them."""
    edges = _checked(members.select(F.xxhash64("g", _chunk("node", "total", most)).alias("part"), "node", "key"), texts)
    large = members.where(F.col("total") > most)
    if large.isEmpty():
        return edges
    edges = runtime.stored(edges, "links")
    # one member of each part that chunks have left
    firsts = _labelled(large, edges).where("node = label")
    sizes = firsts.groupBy("g").agg(F.sum("n").alias("total"), F.count("*").alias("parts")).where("parts > 1")
    edges = runtime.stored(edges.unionAll(_checked(firsts.join(sizes, "g").select(F.xxhash64("g", _chunk("node", "total", most)).alias("part"), "node", "key"), texts)), "links")
    # what is still apart, whole
    rows = runtime.stored(_labelled(large, edges), "parts")
    sums = rows.groupBy("g", "label").agg(F.sum("n").alias("s")).groupBy("g")
    main = sums.agg(F.max_by("label", F.struct("s", "label")).alias("main"), F.max("s").alias("own"), (F.sum("s") - F.max("s")).alias("rest"), F.count("*").alias("parts")).where("parts > 1")
    apart = rows.join(main, "g").withColumn("first", F.col("label") == F.col("main"))
    here = F.when(F.col("first"), _chunk("node", "own", most)).otherwise(_chunk("node", "rest", most))
    upto = lambda total: F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col(total) / most) - 1)
    against = lambda i, j: F.xxhash64("g", F.lit(0), i, j)
    among = lambda i, j: F.xxhash64("g", F.lit(1), F.least(i, j), F.greatest(i, j))
    parts = F.when(F.col("first"), F.transform(upto("rest"), lambda j: against(F.col("c"), j))).otherwise(
        F.concat(F.transform(upto("own"), lambda i: against(i, F.col("c"))), F.transform(upto("rest"), lambda j: among(F.col("c"), j)))
    )
    return edges.unionAll(_checked(apart.withColumn("c", here).select(F.explode(parts).alias("part"), "node", "key"), texts))


def groups(docs: DataFrame, most: int = GROUP_SHINGLES, bucket: int = BUCKET_MOST) -> DataFrame:
    """(doc_id, key, root) per row of docs: rows of one component share a root."""
    prints = runtime.stored(signatures(docs), "signatures")
    full = prints.where("n > 0")
    candidate = components(candidates(full.select("f0", "f1", "f2", "f3").distinct(), bucket)).withColumnRenamed("node", "point")
    sets = full.groupBy("node").agg(F.min(F.struct("key", "n", "point")).alias("x")).select("node", "x.*")
    grouped = sets.join(candidate, "point", "left").select(F.coalesce("root", "point").alias("g"), "node", "n", "key")
    sizes = grouped.groupBy("g").agg(F.sum("n").alias("total"), F.count("*").alias("many")).where("many > 1").drop("many")
    members = runtime.stored(grouped.join(sizes, "g"), "members")
    texts = columns(docs, key=doc_key(docs["text"]), text="text").join(members.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    found = components(_links(members, texts, most))
    rows = prints.select("doc_id", "key", "node")
    return rows.join(found, "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group, with all its columns, chosen as `simhash.one_of_each` does."""
    return first_rows(docs, groups(docs))
