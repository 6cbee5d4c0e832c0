"""Language identification with bit-sliced Bloom filters of n-grams.

Every language has a Bloom filter of the n-grams (of bytes, inside lower-cased words with one
space around each) that enough of its documents hold. The filters have the same size and hash
functions and are stored bit-sliced: slot s holds one bit per language. Looking an n-gram up is
the AND of its slots' masks: all languages that contain it, at once. Over a text, the count of a
language's bit, as a share of the text's n-grams, overstates its share by the false positives:
of the n-grams it lacks, the fraction fill^k passes by chance. The corrected share
(share - f) / (1 - f) decides; the score is the winner's part of all corrected shares.

The filters are learned from at most about `per_language` documents of each language, chosen by
a hash of id and text. Their size in bytes is slots times the smallest of 1, 2, 4, 8, 16 ... that has
a bit per language: a few MB, however large the corpus. Prediction covers whole texts.

Defined cases: a null text, or one without a letter, is `und` with score 0; a text with letters
of which no n-gram is known gets the language with most learned documents and score 0 (ties: the
first by name); with nothing to learn from, all is `und`; rows without a lang aren't learned from;
a null id is not held out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum import runtime
from vellum.llm.common import columns, in_pieces, utf8

SIZES = (3, 5)
SLOT_BITS = 21
HASHES = 3
PER_LANGUAGE = 4000
#: An n-gram belongs to a language if this share of its learned documents hold it, and 2 at least.
LEAST_SHARE = 0.002
TEXT_BYTES = 2 << 20
_LETTER = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]")
_PART = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def letters(text: str) -> bytes | None:
    """The words with one space around each, or None without a letter."""
    if not (_LETTER.search(text) or any(map(str.isalpha, text))):
        return None
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_PART).split()) + b" "


def grams(line: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash for the n-gram at each place."""
    n = max(0, len(line) - size + 1)
    x = np.full(n, size, np.uint64)
    for j in range(size):
        x = (x << np.uint64(8)) | line[j : n + j]
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def slots(hashes: np.ndarray, k: int) -> np.ndarray:
    return (hashes >> np.uint64(SLOT_BITS * k)) & np.uint64((1 << SLOT_BITS) - 1)


class Filters:
    def __init__(self, languages: list[str], usual: int, masks: np.ndarray):
        """masks: (words of 64 languages, slots)."""
        self.languages, self.usual = languages, usual
        fill = [np.count_nonzero(masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)) / masks.shape[1] for i in range(len(languages))]
        self.chance = np.minimum(np.array(fill) ** HASHES, 0.999)
        width = next(w for w in (8, 16, 32, 64) if len(languages) <= w or w == 64)
        self.masks = masks.astype(f"u{width // 8}")

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lines = [letters(t) if t is not None else None for t in texts]
        known = [x or b"" for x in lines]
        ends = np.cumsum([len(x) for x in known])
        line = np.frombuffer(b"".join(known), np.uint8)
        hits = np.zeros((len(self.languages), len(texts)))
        total = np.zeros(len(texts))
        for size in SIZES:
            hashes = grams(line, size)
            first = np.minimum(np.concatenate([[0], ends[:-1]]), len(hashes))
            last = np.clip(ends - size + 1, first, len(hashes))
            total += last - first
            full = np.flatnonzero(last > first)
            if not len(full):
                continue
            # of the places between two texts' ranges, reduceat makes ranges of their own
            cuts = np.stack([first[full], last[full]], axis=1).ravel()
            drop = len(cuts) - (cuts[-1] >= len(hashes))
            for w, word in enumerate(self.masks):
                found = word[slots(hashes, 0)]
                for k in range(1, HASHES):
                    found &= word[slots(hashes, k)]
                for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                    bit = (found >> found.dtype.type(i % 64)) & found.dtype.type(1)
                    hits[i, full] += np.add.reduceat(bit, cuts[:drop], dtype=np.int64)[::2]
        share = hits / np.maximum(total, 1)
        share = np.maximum(0, (share - self.chance[:, None]) / (1 - self.chance[:, None]))
        whole = share.sum(axis=0)
        best = share.argmax(axis=0) if self.languages else whole
        names, scores = [], []
        for i, text in enumerate(lines):
            if text is None or not self.languages:
                names.append("und")
                scores.append(0.0)
            elif whole[i] <= 0:
                names.append(self.languages[self.usual])
                scores.append(0.0)
            else:
                names.append(self.languages[best[i]])
                scores.append(float(share[best[i], i] / whole[i]))
        return names, scores


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Filters:
    """docs(doc_id, text, lang): filters of the languages in it. The driver gets one row per
    language and one per occupied slot, of which there are 2^SLOT_BITS at most."""
    spark = docs.sparkSession
    runtime.ship(spark)
    rows = docs.where("text is not null and lang is not null")
    seen = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator())
    if not seen:
        return Filters([], 0, np.zeros((1, 1 << SLOT_BITS), np.uint64))
    names = [x[0] for x in seen]
    least = F.element_at(F.array(*[F.lit(max(2.0, LEAST_SHARE * min(n, per_language))) for _, n in seen]), F.col("i") + 1)
    # the languages are literals of the filter, so only chosen texts leave the scan
    known = F.map_from_arrays(F.lit(names), F.array(*[F.struct(F.lit(i).alias("i"), F.lit(min(1.0, per_language / n)).alias("share")) for i, (_, n) in enumerate(seen)]))
    mine = rows.select("doc_id", "text", known[F.col("lang")].alias("x"))
    chosen = mine.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.col("x.share") * (1 << 20)).select(F.col("x.i").alias("i"), "text")

    def run(batches):
        for batch in in_pieces(batches, 1, TEXT_BYTES):
            langs, found = np.asarray(batch.column(0)), {}
            for i, text in zip(langs.tolist(), utf8(batch.column(1))):
                line = letters(text.decode(errors="replace"))
                if line:
                    raw = np.frombuffer(line, np.uint8)
                    found.setdefault(i, []).extend(np.unique(grams(raw, s)) for s in SIZES)
            for i, parts in found.items():
                values, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.record_batch([pa.array(np.full(len(values), i, np.int32)), pa.array(values.view(np.int64)), pa.array(n)], names=["i", "gram", "n"])

    counted = chosen.mapInArrow(run, "i int, gram bigint, n bigint").groupBy("i", "gram").agg(F.sum("n").alias("n"))
    kept = counted.where(F.col("n") >= least)
    place = F.explode(F.array(*[F.shiftrightunsigned("gram", SLOT_BITS * k).bitwiseAND((1 << SLOT_BITS) - 1) for k in range(HASHES)]))
    sliced = kept.select(F.expr("i div 64").alias("word"), F.expr("shiftleft(1L, cast(i % 64 as int))").alias("bit"), place.alias("slot"))
    got = sliced.groupBy("word", "slot").agg(F.bit_or("bit").alias("mask")).toArrow()
    masks = np.zeros((-(-len(names) // 64), 1 << SLOT_BITS), np.uint64)
    masks[np.asarray(got["word"]), np.asarray(got["slot"])] = np.asarray(got["mask"]).view(np.uint64)
    return Filters(names, max(range(len(seen)), key=lambda i: (seen[i][1], -i)), masks)


def predicted(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs."""
    spark = docs.sparkSession
    runtime.ship(spark)
    known = spark.sparkContext.broadcast(filters)
    arrow = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for batch in in_pieces(batches, 1, TEXT_BYTES):
            names, scores = known.value.predict([t.decode(errors="replace") if t is not None else None for t in utf8(batch.column(1))])
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=arrow)

    return columns(docs, doc_id=docs[id_col].cast("bigint"), text=text_col).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op5(docs: DataFrame) -> DataFrame:
    filters = learn(docs.where(~held_out(docs["doc_id"])).select("doc_id", "text", "lang"))
    return predicted(docs, filters).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
