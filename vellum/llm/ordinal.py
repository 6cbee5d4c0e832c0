"""Quality by ordinal regression: a cumulative-link model on hashed text.

One weight vector w over hashed features is shared by all grades; ordered thresholds t_1 < t_2 <
... part them: P(grade <= k) = sigmoid(t_k - w.x). The expected grade ranks documents, the tail
probability P(grade >= wanted) selects them.

Features are present or not: words and word beginnings, in lower case, and, for the shares of
capitals, symbols, repeated neighbours and repeated lines, each step that the share exceeds.

The model is fitted on the driver on at most about `fit_rows` rated rows, chosen by hashes of id,
grade and text, by limited-memory BFGS from zero weights: the same rows give the same model. Scoring covers
every row and its whole text.

Defined cases: rows without a grade don't enter the fit; with no rated row at all, or with one
grade only, every text gets this grade (the highest of `grades` if there is none); a null text is
scored as empty; a rating that repeats id and grade counts once, a repeated document again; a document's prediction uses its text alone.
"""

from __future__ import annotations

import math
import operator
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum import runtime
from vellum.llm.common import columns, fresh, in_pieces, utf8

FIT_ROWS = 12_000
BITS = 20
LEAST_DOCS = 5
TELLING = 4.0
STEPS = (0.02, 0.05, 0.1, 0.2, 0.4, 0.7)
ROUNDS = 150
PENALTY = 1.0
START = 5
TEXT_BYTES = 4 << 20
_WORD = re.compile(r"\w+")
_SYMBOLS = "#*$%&|<>!?@~^{}[]\\/=+"


def features(text: str) -> np.ndarray:
    """Sorted distinct feature numbers below 2^BITS."""
    words = set(_WORD.findall(text.lower()))
    names = words | {f"^{w[:n]}" for w in words for n in (START - 1, START) if len(w) > n}
    tokens = text.split()
    n, lines = len(tokens), [x for x in text.split("\n") if x.strip()]
    if n:
        shares = {
            "caps": sum(map(str.isupper, tokens)) / n,
            "symbols": sum(map(text.count, _SYMBOLS)) / len(text) * 5,
            "twice": sum(map(operator.eq, tokens, tokens[1:])) / n,
            "lines": 1 - len(set(lines)) / len(lines),
            "same": 1 - len(set(tokens)) / n,
        }
        names |= {f" {k}>{s}" for k, x in shares.items() for s in STEPS if x > s}
    names.add(f" size {int(math.log2(n + 1))}")
    return np.unique(np.fromiter((zlib.crc32(x.encode("utf-8", "replace")) for x in names), np.uint32, len(names)) & np.uint32((1 << BITS) - 1))


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, grades: int):
        self.weights, self.thresholds, self.grades = weights, thresholds, grades

    def tails(self, texts: list[str]) -> np.ndarray:
        """P(grade >= k) for k = 1 .. grades-1: a row per text."""
        scores = np.array([self.weights[features(t)].sum(dtype=np.float64) for t in texts])
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def _telling(rows: list[np.ndarray], grades: np.ndarray) -> np.ndarray:
    """Features of enough texts, where the share of some grade is off its share in all texts by
    TELLING standard errors: the others would only add noise, most of all in long texts."""
    n, off = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for r in rows:
        n[r] += 1
    for k in np.unique(grades):
        share, total = (grades == k).mean(), np.zeros(1 << BITS)
        for r, g in zip(rows, grades == k):
            total[r] += g - share
        off = np.maximum(off, np.abs(total) / math.sqrt(share * (1 - share)))
    return (n >= min(LEAST_DOCS, max(1, len(rows) // 20))) & (off >= TELLING * np.sqrt(n))


def _minimised(f, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with halved steps; f gives value and gradient."""
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d = -g
        weights = []
        for s, y in reversed(past):
            weights.append((s @ d) / (s @ y))
            d = d - weights[-1] * y
        if past:
            d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]))
        else:
            d = d / max(1.0, float(np.abs(d).sum()))
        for (s, y), a in zip(past, reversed(weights)):
            d = d + (a - (y @ d) / (s @ y)) * s
        slope, size = float(g @ d), 1.0
        for _ in range(30):
            new, after = f(x + size * d)
            if new <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = size * d, after - g
        if s @ y > 1e-12:
            past = [*past[1 - memory :], (s, y)]
        done = value - new <= 1e-7 * abs(value)
        x, value, g = x + s, new, after
        if done:
            break
    return x


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, rounds: int = ROUNDS, penalty: float = PENALTY) -> Model:
    """rows: the feature numbers of each text. Maximum likelihood, with an L2 penalty on weights."""
    flat = np.zeros(1 << BITS, np.float32)
    seen = np.bincount(grades, minlength=n_grades)
    if np.count_nonzero(seen) < 2:
        only = int(seen.argmax()) if len(grades) else n_grades - 1
        return Model(flat, np.where(np.arange(1, n_grades) <= only, -60.0, 60.0), n_grades)
    kept = _telling(rows, grades)
    names = np.flatnonzero(kept)
    chosen = [np.searchsorted(names, r[kept[r]]) for r in rows]
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(c) for c in chosen])
    place = np.concatenate(chosen).astype(np.int32)
    k, n, at = len(names), len(rows), np.arange(len(rows))
    below = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def loss(x):
        """x: weights, the first threshold, logarithms of the gaps between thresholds."""
        w, gaps = x[:k], np.exp(np.clip(x[k + 1 :], -20, 20))
        t = x[k] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = np.bincount(row, w[place], n)
        c = np.concatenate([np.zeros((n, 1)), below(t[None, :] - s[:, None]), np.ones((n, 1))], axis=1)
        d = c * (1 - c)
        p = np.maximum(c[at, grades + 1] - c[at, grades], 1e-12)
        up, down = d[at, grades + 1] / p, d[at, grades] / p
        by_t = np.zeros((n, n_grades + 1))
        by_t[at, grades + 1] -= up
        by_t[at, grades] += down
        by_t = by_t[:, 1:-1].sum(axis=0)
        later = np.cumsum(by_t[::-1])[::-1]
        g = np.concatenate([np.bincount(place, (up - down)[row], k) + penalty * w, later[:1], gaps * later[1:]])
        return float(penalty / 2 * (w @ w) - np.log(p).sum()), g

    share = np.clip(np.cumsum(seen)[:-1] / n, 1e-3, 1 - 1e-3)
    t = np.log(share / (1 - share))
    x = _minimised(loss, np.concatenate([np.zeros(k), t[:1], np.log(np.maximum(np.diff(t), 1e-2))]), rounds)
    flat[names] = x[:k]
    return Model(flat, x[k] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(x[k + 1 :], -20, 20)))]), n_grades)


def _share(share: float, *names: str) -> Column:
    """Whether a row is of the share of all that a hash of the columns picks."""
    return F.pmod(F.xxhash64(*names), F.lit(1 << 20)) < int((1 << 20) * min(1.0, share))


def train(docs: DataFrame, ratings: DataFrame, grade: Column, n_grades: int, fit_rows: int = FIT_ROWS) -> Model:
    """ratings(doc_id, ...): `grade` is a column over it, 0 to n_grades - 1 or null."""
    runtime.ship(docs.sparkSession)
    rated = columns(ratings, rated=ratings["doc_id"].cast("bigint"), grade=grade.cast("int")).where(f"rated is not null and grade between 0 and {n_grades - 1}")
    # about fit_rows ratings of two numbers are broadcast, whatever the corpus; where one id has
    # many documents, a hash of id and text thins out what they bring
    rated = rated.distinct()
    n = rated.count()
    chosen = F.broadcast(rated.where(_share(fit_rows / max(n, 1), "rated", "grade")))
    ids = columns(docs, id=docs["doc_id"].cast("bigint"))
    met = ids.join(chosen, F.col("id") == F.col("rated")).count()
    texts = columns(docs, id=docs["doc_id"].cast("bigint"), text="text")
    sample = texts.where(_share(fit_rows / max(met, 1), "id", "text")).join(chosen, F.col("id") == F.col("rated")).select("id", "grade", "text")

    def run(batches):
        for batch in in_pieces(batches, 2, TEXT_BYTES):
            found = [features(t.decode(errors="replace") if t else "").astype(np.int32) for t in utf8(batch.column(2))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["id", "grade", "found"])

    got = sample.mapInArrow(run, "id bigint, grade int, found array<int>").toArrow()
    ids, grades, found = np.asarray(got["id"]), np.asarray(got["grade"], np.int64), got["found"].combine_chunks()
    offsets, values = np.asarray(found.offsets), np.asarray(found.values)
    rows = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], grades[i], len(rows[i]), zlib.crc32(rows[i].tobytes())))
    return fit([rows[i] for i in order], grades[order], n_grades)


def scored(docs: DataFrame, model: Model, wanted: int, expected: str = "expected_grade", tail: str = "tail_probability") -> DataFrame:
    """docs with the expected grade and the probability of `wanted` or more after its columns."""
    spark = docs.sparkSession
    runtime.ship(spark)
    known = spark.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def run(batches):
        for batch in in_pieces(batches, text, TEXT_BYTES):
            tails = known.value.tails([t.decode(errors="replace") if t else "" for t in utf8(batch.column(text))])
            yield pa.record_batch([*batch.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, wanted - 1])], names=[*batch.schema.names, expected, tail])

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(expected), F.lit(0.0).alias(tail)).schema)


#: Grades of the labels: toxic 0, poor 1, good 2.
N_GRADES = 3


def grade_of(labels: DataFrame) -> Column:
    return F.when(labels["toxic"] == 1, 0).when(labels["quality"] == 0, 1).when(labels["quality"] == 1, 2)


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels, grade_of(labels), N_GRADES)
    rows = scored(columns(docs, doc_id=docs["doc_id"].cast("bigint"), text="text"), model, 2)
    return rows.select("doc_id", "expected_grade", F.col("tail_probability").alias("p_good"), (F.col("tail_probability") >= 0.5).alias("kept"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are good with a probability of a half or more, with all their columns."""
    model = train(docs, labels, grade_of(labels), N_GRADES)
    names = fresh(docs, "expected", "tail")
    return scored(docs, model, 2, *names).where(F.col(names[1]) >= 0.5).drop(*names)
