"""Benchmark decontamination by a distributed positional inverted index.

The training documents are dealt into segments. A segment is one stored row: its documents,
its terms, and for each term the sorted positions at which it stands (one number line per
segment, on which a document is an interval). A search sends the benchmark's phrases to every
segment; there the lists of a phrase's terms are intersected from the rarest on, each list
moved back by the term's offset in the phrase. No posting is ever shuffled, and a frequent
term or a hot source costs no more than its share of each segment.

The phrases of a benchmark are sent in blocks of bounded size; every block meets all segments.

Defined cases: a null or empty text has no words and no hits; a null id stays null, and rows
that share an id are judged one by one; an item without id counts for hits but isn't listed;
an empty benchmark hits nothing; an empty documents table gives no rows; columns other than
the named ones are ignored.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum import runtime
from vellum.llm.common import alnum_words, columns, doc_key, fresh, in_pieces, utf8

WINDOW_WORDS = 13
#: How far a term may be off its place in a proximity match.
SLOP = 2
SEGMENT_BYTES = 8 << 20
BLOCK_BYTES = 4 << 20
#: A document is contaminated if a 20th of its words or more are hit.
HIT_SHARE = 20

INDEX_SCHEMA = "segment string, doc_ids array<bigint>, doc_words array<int>, terms binary, counts binary, positions binary"
HITS_SCHEMA = (
    "segment string, doc_no int, doc_id bigint, n_words bigint, "
    "hits array<struct<start:int,stop:int>>, items array<bigint>, n_near bigint"
)


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers, all first bytes before all second ones: this compresses well."""
    return numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(data: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1)[:, start:stop].T.copy().view("<i4").ravel()


def _index_batches(batches, segment_bytes: int):
    arrow = pa.schema(
        [("segment", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("doc_words", pa.list_(pa.int32())),
         ("terms", pa.binary()), ("counts", pa.binary()), ("positions", pa.binary())]
    )
    for batch in in_pieces(batches, 1, segment_bytes):
        ids: dict[bytes, int] = defaultdict(count().__next__)
        words, lengths = [], []
        for text in utf8(batch.column(1)):
            found = alnum_words(text)
            lengths.append(len(found))
            words.append(np.fromiter(map(ids.__getitem__, found), np.int32, len(found)))
        terms = np.concatenate(words)
        positions = np.argsort(terms, kind="stable")
        counts = np.bincount(terms, minlength=len(ids))
        steps = np.diff(positions, prepend=0)
        first = np.cumsum(counts) - counts
        steps[first] = positions[first]  # each term's list can be read on its own
        row = (
            [uuid.uuid4().hex], [batch.column(0).to_pylist()], [lengths], [b"\n".join(ids)],
            [_planes(counts)], [_planes(steps)],
        )
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(row, arrow)], schema=arrow)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The stored index of every document, one row per segment of about segment_bytes of text."""
    runtime.ship(docs.sparkSession)
    rows = columns(docs, id=docs[id_col].cast("bigint"), text=text_col)
    return runtime.stored(rows.mapInArrow(lambda b: _index_batches(b, segment_bytes), INDEX_SCHEMA), "postings")


class Phrases:
    """A block of the benchmark: distinct phrases as rows of term numbers, and their items."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int):
        vocabulary: dict[bytes, int] = defaultdict(count().__next__)
        found: dict[tuple[int, ...], set] = defaultdict(set)
        for item, text in items:
            words = [vocabulary[w] for w in alnum_words(text)]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                found[tuple(words[i : i + window])].add(item)
        self.vocabulary = dict(vocabulary)
        self.items = [sorted(x for x in s if x is not None) for s in found.values()]
        self.lengths = np.array([len(x) for x in found], np.int64)
        self.terms = np.full((len(found), window), len(vocabulary), np.int32)  # one more term stands for none
        for row, phrase in zip(self.terms, found):
            row[: len(phrase)] = phrase


def _find(phrase: np.ndarray, order: np.ndarray, lists: list[np.ndarray], starts: np.ndarray, ends: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers and first positions at which all terms stand in their places, or each up
    to slop words off its own. order: the terms' places, rarest first."""
    first = order[0]
    at = lists[phrase[first]]
    doc = np.searchsorted(starts, at, "right") - 1
    at = at - first
    if slop:
        at, doc = (at[:, None] + np.arange(-slop, slop + 1)).ravel(), np.repeat(doc, 2 * slop + 1)
    for place in order[1:]:
        if not len(at):
            break
        other = lists[phrase[place]]
        low = np.maximum(at + place - slop, starts[doc])
        high = np.minimum(at + place + slop, ends[doc] - 1)
        i = np.searchsorted(other, low)
        ok = (i < len(other)) & (low <= high)
        ok[ok] = other[i[ok]] <= high[ok]
        at, doc = at[ok], doc[ok]
    return doc, at


def _search_segment(row: dict, phrases: Phrases, slop: int) -> list[tuple]:
    lengths = np.array(row["doc_words"], np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    # documents without words hold no position; the search below sees the others only
    full = np.flatnonzero(lengths)
    counts = _unplaned(row["counts"])
    lists = [np.zeros(0, np.int64)] * len(phrases.vocabulary)
    size = np.zeros(len(phrases.vocabulary) + 1, np.int64)
    if len(counts):
        for term, n, stop in zip(row["terms"].split(b"\n"), counts.tolist(), np.cumsum(counts, dtype=np.int64).tolist()):
            if (q := phrases.vocabulary.get(term)) is not None:  # no other list is unpacked
                lists[q], size[q] = np.cumsum(_unplaned(row["positions"], stop - n, stop), dtype=np.int64), n
    size[-1] = 1 << 62
    sizes = size[phrases.terms]
    hit = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int32)
    items, near = defaultdict(set), np.zeros(len(lengths), np.int64)
    for k in np.flatnonzero((sizes > 0).all(axis=1)):
        n = int(phrases.lengths[k])
        order = np.argsort(sizes[k, :n], kind="stable")
        doc, at = _find(phrases.terms[k], order, lists, starts[full], ends[full], 0)
        np.add.at(hit, at, 1)
        np.add.at(hit, at + n, -1)
        for d in set(full[doc].tolist()):
            items[d].update(phrases.items[k])
        if slop:
            loose, _ = _find(phrases.terms[k], order, lists, starts[full], ends[full], slop)
            for d in set(full[loose].tolist()) - set(full[doc].tolist()):
                near[d] += 1
    covered = np.cumsum(hit[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    spans = defaultdict(list)
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        d = int(np.searchsorted(ends, a, "right"))
        while a < b:  # a run may pass from one document to the next
            stop = min(b, int(ends[d]))
            if a < stop:
                spans[d].append({"start": a - int(starts[d]), "stop": stop - int(starts[d])})
            a, d = max(a, stop), d + 1
    return [
        (row["segment"], d, row["doc_ids"][d], int(lengths[d]), spans.get(d, []), sorted(items.get(d, ())), int(near[d]))
        for d in range(len(lengths))
    ]


_ARROW_HITS = pa.schema(
    [("segment", pa.string()), ("doc_no", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
     ("hits", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("items", pa.list_(pa.int64())), ("n_near", pa.int64())]
)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """The benchmark in blocks of at most block_bytes of text and one item more."""
    items = columns(benchmark, item=benchmark[id_col].cast("bigint"), text=text_col).where("text is not null").distinct()
    size = F.octet_length("text")
    total, largest = items.agg(F.sum(size), F.max(size)).first()
    n = max(1, -(-(total or 0) // block_bytes))
    dealt = lambda: items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    while n > 1 and dealt().groupBy("block").agg(F.sum(size).alias("b")).agg(F.max("b")).first()[0] > block_bytes + largest:
        n *= 2
    for b in range(n):
        yield [(r[0], r[1].encode()) for r in dealt().where(F.col("block") == b).select("item", "text").toLocalIterator()]


def search(index: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW_WORDS, slop: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per indexed document: its words, the word spans inside exact occurrences of a
    window of `window` consecutive item words (a shorter item is one window), the items whose
    windows occur, and, with slop > 0, the number of windows that occur only loosely: there is a
    place from which every term stands within slop words of its own, and none where all fit."""
    spark = index.sparkSession
    runtime.ship(spark)
    found = None
    for items in _blocks(benchmark, id_col, text_col, block_bytes):
        phrases = spark.sparkContext.broadcast(Phrases(items, window))

        def run(batches, phrases=phrases):
            for batch in batches:
                for i in range(batch.num_rows):
                    rows = _search_segment(batch.slice(i, 1).to_pylist()[0], phrases.value, slop)
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW_HITS)], schema=_ARROW_HITS)

        block = index.mapInArrow(run, HITS_SCHEMA)
        found = block if found is None else found.unionAll(block)
        n_blocks = 1 if found is block else 2
    if n_blocks == 1:
        return found.drop("segment", "doc_no")
    merged = found.groupBy("segment", "doc_no").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.sum("n_near").alias("n_near"),
    )
    # sorted spans to disjoint ones
    spans = F.aggregate(
        "hits",
        F.array().cast("array<struct<start:int,stop:int>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["stop"] >= x["start"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["stop"], x["stop"]).alias("stop"))),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )
    return merged.withColumn("hits", spans).drop("segment", "doc_no")


def contamination(docs: DataFrame, benchmark: DataFrame, slop: int = 0, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items, n_near and whether it is contaminated."""
    index = build_index(docs, **{k: v for k, v in options.items() if k == "segment_bytes"})
    hits = search(index, benchmark, slop=slop, **{k: v for k, v in options.items() if k in ("window", "block_bytes")})
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, x: n + x["stop"] - x["start"])
    return hits.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * HIT_SHARE >= F.col("n_words"))
    )


def op1(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    items = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return contamination(docs, benchmark, slop=SLOP).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"), "contaminated", "n_near",
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns. A row's text decides,
    so rows go by the text's hash: others of the same or of no id stay."""
    texts = columns(docs, doc_id=doc_key(docs["text"]), text="text")
    (name,) = fresh(docs, "bad")
    bad = contamination(texts, benchmark).where("contaminated").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, doc_key(docs["text"]) == bad[name], "left_anti")


_TEXT_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_TEXT_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_TEXT_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, list_slice(w, i, i + least(len(w), 13) - 1) AS ws, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS s FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
dw AS (SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT r, i, n, s, item_id FROM dw JOIN p USING (n, s)),
c AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS k FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY r),
win AS (SELECT row_number() OVER () AS k, s, n, ws FROM (SELECT DISTINCT s, n, ws FROM p)),
pos AS (SELECT r, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM d),
term AS (SELECT k, n, unnest(ws) AS word, unnest(generate_series(1, n)) AS j FROM win),
need AS (SELECT k, count(DISTINCT word) AS m FROM term GROUP BY k),
hold AS (SELECT r, k FROM (SELECT DISTINCT r, word FROM pos) JOIN (SELECT DISTINCT k, word FROM term) USING (word) JOIN need USING (k) GROUP BY r, k, m HAVING count(*) = m),
loose AS (SELECT DISTINCT r, k FROM (SELECT r, k, n, i - j + e AS a FROM hold JOIN term USING (k) JOIN pos USING (r, word), (SELECT unnest([-2, -1, 0, 1, 2]) AS e) GROUP BY r, k, n, i - j + e HAVING count(DISTINCT j) = n)),
near AS (SELECT r, count(*) AS n_near FROM loose JOIN win USING (k) ANTI JOIN h ON h.r = loose.r AND h.s = win.s GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r) LEFT JOIN near USING (r)
"""
