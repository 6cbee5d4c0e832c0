"""Substring deduplication: repeats of `window` words or more, by partitioned suffix trees.

A suffix tree of all word sequences would tell every repeat: a node at a depth of `window` words
or more with several leaves is one. The tree is built in parts that fit in memory, cut down to
that depth:

1. A suffix's first `window` words contain an anchor, the `gram`-word sequence with the smallest
   hash in them. It depends on these words alone, so equal prefixes have equal anchors, and
   consecutive suffixes mostly share one: they travel as one stretch of text. An anchor that
   occurs once in the corpus can stand under no deep node; its suffixes are dropped at once.
2. The remaining suffixes are dealt into groups by prefix. The prefix has variable length: the
   anchor's words, or, where an anchor has more than `most` stretches, all `window` words.
3. In a group (held in memory, one at a time), suffixes are sorted by their words. Neighbours
   whose common prefix reaches `window` words are leaves of one deep node. All its leaves but
   the first in corpus order start a repeated window. Consecutive repeated windows of a document
   make a maximal span, which is what the operator returns.

Copies that one batch of documents holds are settled in the batch, and only the first goes on;
so a passage that a third of all rows share brings one row per batch to its group.

Defined cases: a null or empty text, or one of fewer than `window` words, has no window and
loses nothing; rows without an id come first, in the order of their texts' hashes; rows that
repeat both id and text stand at the same place, so they are treated alike and don't count as each
other's copies; rows of one id with different texts are ordered by place in the text; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum import runtime
from vellum.llm.common import columns, doc_key, fresh, in_pieces, utf8

WINDOW_WORDS = 20
GRAM_WORDS = 8
GROUP_MOST = 50_000
BATCH_BYTES = 4 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_ANCHORS = "gram bigint, id bigint, n int, more array<bigint>"
_ANCHORS_ARROW = pa.schema([("gram", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("more", pa.list_(pa.int64()))])
_STRETCHES = "kind int, part bigint, id bigint, start int, key bigint, words binary"
_STRETCHES_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("id", pa.int64()), ("start", pa.int32()), ("key", pa.int64()), ("words", pa.binary())])
_MARKS = "id bigint, key bigint, starts binary"
_MARKS_ARROW = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("starts", pa.binary())])
#: Powers of the base; they start again in longer words, which only makes these hashes weaker.
_POWERS = 1 << 12


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE, np.uint64)]))


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    reach = 1
    while reach * 2 <= width:
        x = np.minimum(x[: len(x) - reach], x[reach:])
        reach *= 2
    over = width - reach
    return np.minimum(x[: len(x) - over], x[over:])


class Stretches:
    """The stretches of some documents: maximal runs of window starts that share an anchor."""

    def __init__(self, texts: list[bytes | None], window: int, gram: int):
        lines = [b" ".join(t.split()) if t else b"" for t in texts]
        self.counts = np.array([x.count(b" ") + 1 if x else 0 for x in lines], np.int64)
        self.data = b"\n".join(x for x in lines if x) + b"\n"
        raw = np.frombuffer(self.data, np.uint8)
        self.ends = np.flatnonzero((raw == 32) | (raw == 10)) if self.counts.any() else np.zeros(0, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]) if len(self.ends) else self.ends
        self.first = np.cumsum(self.counts) - self.counts  # the first word of each document
        n = len(self.ends)
        none = np.zeros(0, np.int64)
        self.doc, self.begin, self.size, self.gram = none, none, none, none
        if n < window:
            return
        grams = _word_hashes(raw, self.starts, self.ends)
        total = np.zeros(n - gram + 1, np.uint64)
        for j in range(gram):
            total = total * _BASE + grams[j : n - gram + 1 + j]
        total = _mixed(total)
        # smallest hash, then leftmost: hash above, place below
        spread = window - gram + 1
        place = max(1, int(n).bit_length())
        low = (total >> np.uint64(place) << np.uint64(place)) | np.arange(len(total), dtype=np.uint64)
        anchor = (_sliding_least(low, spread) & np.uint64((1 << place) - 1)).astype(np.int64)
        # where the place took bits that tell two hashes apart, look again
        for i in np.flatnonzero(total[anchor] != _sliding_least(total, spread)).tolist():
            anchor[i] = i + int(total[i : i + spread].argmin())
        doc = np.repeat(np.arange(len(self.counts)), self.counts)[: n - window + 1]
        valid = np.arange(n - window + 1) + window <= (self.first + self.counts)[doc]
        at = np.flatnonzero(valid)
        if not len(at):
            return
        new = np.concatenate([[True], (anchor[at[1:]] != anchor[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])])
        runs = np.flatnonzero(new)
        self.begin = at[runs]
        self.size = np.diff(np.concatenate([runs, [len(at)]]))
        self.doc = doc[self.begin]
        self.gram = total[anchor[self.begin]].view(np.int64)

    def words(self, begin: int, n: int) -> bytes:
        return self.data[self.starts[begin] : self.ends[begin + n - 1]]


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word. Equal hashes only bring words to the same place; what counts
    as equal is decided on the words."""
    lengths = ends - starts
    before = np.cumsum(lengths) - lengths
    inside = np.ones(len(raw), bool)
    inside[ends] = False
    letters = raw[inside]
    place = (np.arange(len(letters)) - np.repeat(before, lengths)) % _POWERS
    terms = _mixed(np.arange(1, 257, dtype=np.uint64))[letters] * _powers(_POWERS)[place]
    return _mixed(np.add.reduceat(terms, before) + lengths.astype(np.uint64))


def _anchor_rows(batches, window: int, gram: int):
    """One row for each anchor of a batch: the document of its first stretch, how many stretches
    there are, the documents of the others."""
    for batch in in_pieces(batches, 2, BATCH_BYTES):
        s = Stretches(utf8(batch.column(2)), window, gram)
        if not len(s.gram):
            continue
        order = np.argsort(s.gram, kind="stable")
        grams, ids = s.gram[order], np.asarray(batch.column(0), np.int64)[s.doc[order]]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        n = np.diff(np.concatenate([first, [len(grams)]]))
        others = np.ones(len(grams), bool)
        others[first] = False
        offsets = np.concatenate([[0], np.cumsum(n - 1)]).astype(np.int32)
        more = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[others]), mask=pa.array(n == 1))
        yield pa.record_batch([pa.array(grams[first]), pa.array(ids[first]), pa.array(n.astype(np.int32)), more], schema=_ANCHORS_ARROW)


def _stretch_rows(batches, window: int, gram: int):
    """batches: id, key, text, the anchors to send, those of them that go window by window.
    kind 0: a stretch for the group `part`; kind 1: starts of windows that stand earlier in this
    very batch."""
    for batch in in_pieces(batches, 2, BATCH_BYTES):
        ids, keys = (batch.column(i).to_pylist() for i in (0, 1))
        s = Stretches(utf8(batch.column(2)), window, gram)
        if not len(s.gram):
            continue
        bounds = np.searchsorted(s.doc, np.arange(batch.num_rows + 1))
        seen: dict[bytes, tuple] = {}
        out: list[tuple] = []
        for i in sorted(range(batch.num_rows), key=ids.__getitem__):
            low, high = bounds[i], bounds[i + 1]
            send = np.flatnonzero(np.isin(s.gram[low:high], batch.column(3)[i].as_py()))
            singly = set(batch.column(4)[i].as_py())
            first, own = int(s.first[i]), []
            for r in (low + send).tolist():
                begin, n, part = int(s.begin[r]), int(s.size[r]), int(s.gram[r])
                if alone := part in singly:
                    pieces = [(b, 1) for b in range(begin, begin + n)]
                else:
                    pieces = [(begin, n)]
                for b, m in pieces:
                    words = s.words(b, m + window - 1)
                    place = (ids[i], b - first)
                    had = seen.setdefault(words, (place, keys[i]))
                    if had[0] < place:
                        own += range(b - first, b - first + m)
                    elif had[0] is place or had[1] != keys[i]:
                        group = int.from_bytes(hashlib.blake2b(words, digest_size=8).digest(), "little", signed=True) if alone else part
                        out.append((0, group, ids[i], b - first, keys[i], words))
            if own:
                out.append((1, keys[i], ids[i], -1, keys[i], np.array(own, "<i4").tobytes()))
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), _STRETCHES_ARROW)], schema=_STRETCHES_ARROW)


def deep_nodes(suffixes: list[tuple[bytes, int, int, int]]):
    """suffixes: (its first `window` words, id, start, row), sorted. The nodes at full depth with
    several leaves, as slices: neighbours that share all these words."""
    low = 0
    for i in range(1, len(suffixes) + 1):
        if i == len(suffixes) or suffixes[i][0] != suffixes[low][0]:
            if i - low > 1:
                yield low, i
            low = i


def _suffixes(rows: list[tuple], window: int) -> list[tuple]:
    """(first window words, id, start, row number) of every suffix in the stretches."""
    out = []
    for r, (_, id_, start, _, words) in enumerate(rows):
        ends = list(accumulate((len(w) + 1 for w in words.split(b" ")), initial=0))
        out += [(words[ends[j] : ends[j + window] - 1], id_, start + j, r) for j in range(len(ends) - window)]
    return out


def _marks(batches, window: int, most: int):
    """batches: stretches sorted by kind, part, id and start. Emits the starts of windows that
    stand earlier, by document."""

    def settle(rows: list[tuple], firsts: dict) -> pa.RecordBatch:
        found: dict[int, list[int]] = {}
        suffixes = sorted(_suffixes(rows, window))
        if firsts:  # the part goes on from an earlier piece, whose places are all smaller
            for words, id_, start, r in suffixes:
                if words in firsts and firsts[words] < (id_, start):
                    found.setdefault(r, []).append(start)
        for low, high in deep_nodes(suffixes):
            words, id_, start, _ = suffixes[low]
            if words not in firsts:
                for _, other, at, r in suffixes[low + 1 : high]:
                    if (other, at) > (id_, start):
                        found.setdefault(r, []).append(at)
        got = [(rows[r][1], rows[r][3], np.array(x, "<i4").tobytes()) for r, x in found.items()]
        return pa.record_batch([pa.array([x[i] for x in got], f.type) for i, f in enumerate(_MARKS_ARROW)], schema=_MARKS_ARROW)

    held: list[tuple] = []
    firsts: dict[bytes, tuple[int, int]] = {}
    part = None
    for batch in batches:
        cut = int(np.searchsorted(np.asarray(batch.column(0)), 1))
        if cut < batch.num_rows:
            done = batch.slice(cut)
            yield pa.record_batch([done.column(2), done.column(4), done.column(5)], schema=_MARKS_ARROW)
        if not cut:
            continue
        rows = list(zip(*(batch.column(i).slice(0, cut).to_pylist() for i in range(1, 6))))
        if part is not None and rows[0][0] != part:
            yield settle(held, firsts)
            held, firsts = [], {}
        rows = held + rows
        part = rows[-1][0]
        whole = next((i + 1 for i in range(len(rows) - 1, -1, -1) if rows[i][0] != part), 0)
        if whole:
            yield settle(rows[:whole], firsts)
            firsts = {}
        held = rows[whole:]
        if len(held) >= most:  # a part at full depth: nearly all its rows have the same words
            yield settle(held, firsts)
            for words, id_, start, _ in _suffixes(held, window):
                firsts[words] = min(firsts.get(words, (id_, start)), (id_, start))
            held = []
    yield settle(held, firsts)


def _placed(docs: DataFrame, id_col: str, text_col: str):
    """A document's place in the corpus: its id, or for a null id a place before all others."""
    key = doc_key(docs[text_col])
    return F.coalesce(docs[id_col].cast("bigint"), F.lit(-(1 << 62)) - F.shiftrightunsigned(key, 2)), key


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS, gram: int = GRAM_WORDS, most: int = GROUP_MOST) -> DataFrame:
    """(id, marks): for each place in the corpus that has windows which start earlier too, their
    first words' numbers (32-bit, by the key of the row's text)."""
    return _repeated(_rows(docs, id_col, text_col), window, gram, most)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    place, key = _placed(docs, id_col, text_col)
    return columns(docs, id=place, key=key, text=text_col, doc_id=docs[id_col].cast("bigint"))


def _repeated(rows: DataFrame, window: int, gram: int, most: int) -> DataFrame:
    runtime.ship(rows.sparkSession)
    anchors = rows.select("id", "key", "text").mapInArrow(lambda b: _anchor_rows(b, window, gram), _ANCHORS)
    counted = anchors.withColumn("total", F.sum("n").over(Window.partitionBy("gram"))).where("total > 1")
    places = F.explode(F.concat(F.array("id"), F.coalesce("more", F.array().cast("array<bigint>"))))
    asked = (
        counted.select("gram", (F.col("total") > most).alias("hot"), places.alias("id"))
        .groupBy("id")
        .agg(F.collect_set("gram").alias("grams"), F.collect_set(F.when(F.col("hot"), F.col("gram"))).alias("singly"))
    )
    sent = rows.join(asked, "id").select("id", "key", "text", "grams", "singly", "doc_id")
    stretches = sent.mapInArrow(lambda b: _stretch_rows(b, window, gram), _STRETCHES)
    dealt = stretches.repartition("kind", "part").sortWithinPartitions("kind", "part", "id", "start")
    marks = dealt.mapInArrow(lambda b: _marks(b, window, most), _MARKS)
    return marks.groupBy("id").agg(F.collect_list(F.struct("key", "starts")).alias("marks"))


_WORD = re.compile(rb"[^ \t\n\v\f\r]+")


def _cut(text: bytes | None, starts: np.ndarray, window: int, keep_layout: bool) -> tuple[bytes | None, int, list]:
    """The text without the words in the windows, its number of words, the removed spans. With
    keep_layout, kept words keep the white space before them."""
    if not len(starts):
        if keep_layout or text is None:
            return (text if keep_layout else b""), len(text.split()) if text else 0, []
        words = text.split()
        return b" ".join(words), len(words), []
    words = text.split()
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    gone = np.cumsum(cover[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).tolist()
    spans = [{"start": a, "stop": b} for a, b in zip(edges[::2], edges[1::2])]
    if not keep_layout:
        return b" ".join(w for w, g in zip(words, gone.tolist()) if not g), len(words), spans
    at = [m.span() for m in _WORD.finditer(text)]
    out, end = [], 0
    for a, b in zip(edges[::2], edges[1::2]):
        out.append(text[end : at[a][0]])
        end = at[b - 1][1]
    out.append(text[end:])
    return b"".join(out), len(words), spans


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _starts(marks: list | None, key: int) -> np.ndarray:
    own = [np.frombuffer(m["starts"], "<i4") for m in marks or () if m["key"] == key]
    return np.concatenate(own) if own else np.zeros(0, np.int32)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS, gram: int = GRAM_WORDS, most: int = GROUP_MOST) -> DataFrame:
    """Per row of docs: doc_id, n_words, the removed spans (of word numbers), and `kept`: the
    words that stay, joined by one space."""
    rows = _rows(docs, id_col, text_col)
    marked = rows.join(_repeated(rows, window, gram, most), "id", "left").select("doc_id", "key", "text", "marks")
    arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("removed", _SPANS), ("kept", pa.string())])

    def run(batches):
        for batch in in_pieces(batches, 2, BATCH_BYTES):
            keys = batch.column(1).to_pylist()
            got = [_cut(t, _starts(m, k), window, False) for t, m, k in zip(utf8(batch.column(2)), batch.column(3).to_pylist(), keys)]
            yield pa.record_batch(
                [batch.column(0), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], _SPANS), pa.array([x[0] for x in got], pa.binary()).cast(pa.string())],
                schema=arrow,
            )

    return marked.mapInArrow(run, "doc_id bigint, n_words bigint, removed array<struct<start:int,stop:int>>, kept string")


def cut_documents(docs: DataFrame, window: int = WINDOW_WORDS, gram: int = GRAM_WORDS, most: int = GROUP_MOST) -> DataFrame:
    """docs with the repeated words cut out of `text`, the white space between kept words left as
    it is, `n_chars` (where there is one) set anew where words went; all other columns as they
    are. No row goes, even if nothing of its text is left."""
    key_col, place_col, id_col, marks_col = fresh(docs, "key", "place", "id", "marks")
    marks = repeated_windows(docs, window=window, gram=gram, most=most).select(F.col("id").alias(id_col), F.col("marks").alias(marks_col))
    place, key = _placed(docs, "doc_id", "text")
    marked = docs.withColumns({key_col: key, place_col: place})
    marked = marked.join(marks, marked[place_col] == marks[id_col], "left").drop(id_col, place_col)
    at = {f.name: i for i, f in enumerate(marked.schema)}
    text = at["text"]

    def run(batches):
        for batch in in_pieces(batches, text, BATCH_BYTES):
            cols = list(batch.columns)
            keys, marks = batch.column(at[key_col]).to_pylist(), batch.column(at[marks_col]).to_pylist()
            texts = utf8(batch.column(text))
            new = [t if not m else _cut(t, _starts(m, k), window, True)[0] for t, m, k in zip(texts, marks, keys)]
            cols[text] = pa.array(new, pa.binary()).cast(pa.string())
            if (n := at.get("n_chars")) is not None:
                sizes = [x if a is b or a is None else len(a.decode(errors="replace")) for a, b, x in zip(new, texts, cols[n].to_pylist())]
                cols[n] = pa.array(sizes, cols[n].type)
            names = [f for f in at if f not in (key_col, marks_col)]
            yield pa.record_batch([cols[at[f]] for f in names], names=names)

    return marked.mapInArrow(run, docs.schema)


def op9(docs: DataFrame) -> DataFrame:
    n_removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, x: n + x["stop"] - x["start"])
    return without_repeats(docs).select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT r, doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS s FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
f AS (SELECT s, min((doc_id, i)) AS place FROM s GROUP BY s HAVING count(*) > 1),
g AS (SELECT DISTINCT r, unnest(generate_series(i, i + 19)) AS k FROM s JOIN f USING (s) WHERE (doc_id, i) > place),
m AS (SELECT r, count(*) AS n, list(k) AS ks FROM g GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(ks, k)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN m USING (r)
"""
