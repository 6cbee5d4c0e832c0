"""N-best segmentation over the piece lattice of a SentencePiece model, and its inverse.

A text's lattice has an edge for every vocabulary piece at every place, scored by the model; a
character that no piece covers has an edge with a penalty, which is encoded as its bytes. The
forward pass is Viterbi: the best score of every prefix. The backward search is A-star from the
end: a partial segmentation of a suffix is ranked by its own score plus the forward score of the
prefix that is left. That heuristic is exact, so segmentations leave the queue best first, and
nothing off the n best paths is expanded to its end.

No piece has a space mark after another character, and no piece has a line feed in it. So the
lattice falls apart at the start of every run of spaces and at line feeds: units. A unit's best
are found once and remembered (up to a fixed number of units), as the best one and the step down
to the next. A text's best is the sum over its units; for the n best, the n-1 units with the
smallest steps are enough, and the same search runs over their ranked lists.

The scores of a merge (BPE) model are the ranks of its merges, not logarithms of probabilities. Its
library applies merges in order and ignores them, so a text's best segmentation here mostly isn't
the library's. `Lattice.library` gives the library's ids, and `segmented` returns them beside; these are what the model's own
tokenizer gives, and what a trainer of such a model should take.

Text is encoded with one space put before it, spaces as the mark. The mark itself in a text is
encoded as bytes, so decoding gives the same text for every text.

Defined cases: a null text counts as empty; the empty text has one segmentation, of no pieces; a
text with fewer than n segmentations has them all; ties go to the segmentation with the longer
last piece, then the one before; rows are kept one for one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from bisect import insort
from operator import itemgetter
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum import runtime
from vellum.llm.common import columns, in_pieces, utf8

N_BEST = 3
MARK = "▁"
#: What a character without a piece costs beyond the worst piece.
UNKNOWN = 10.0
TEXT_BYTES = 2 << 20
#: Units that a worker remembers in each of two generations, and of the library's ids; ranked lists
#: are a tenth of that at most.
REMEMBERED = 500_000
REMEMBERED_CHARS = 40
_UNIT = re.compile(" *[^ \n]+| +|\n")
NOTHING = float("-inf")
_SCORE, _IDS, _STEP = map(itemgetter, range(3))


class Lattice:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        id_of = lambda i: i.to_bytes(4, "little")
        self.pieces = {model.id_to_piece(i).replace(MARK, " "): (id_of(i), model.get_score(i)) for i in plain}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): id_of(i) for i in range(n) if model.is_byte(i)}
        spelled = [b""] * n
        for piece, (i, _) in self.pieces.items():
            spelled[int.from_bytes(i, "little")] = piece.encode()
        for byte, i in self.bytes.items():
            spelled[int.from_bytes(i, "little")] = bytes([byte])
        self.letters = np.frombuffer(b"".join(spelled), np.uint8)
        self.sizes = np.array([len(x) for x in spelled], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        if len(self.bytes) != 256 or any("\n" in p or " " in p.lstrip(" ") for p in self.pieces):
            raise ValueError("units need a model with byte pieces and without pieces that go on after a space")
        self.longest = max(map(len, self.pieces))
        self.unknown = min(s for _, s in self.pieces.values() if s > -1e8) - UNKNOWN
        #: By letter: (the same of the next letter, ids, score) of what was spelled so far; no piece has no ids.
        self.trie: dict = {}
        for piece, (ids, score) in self.pieces.items():
            children = self.trie
            for letter in piece[:-1]:
                children = children.setdefault(letter, ({}, b"", 0.0))[0]
            children[piece[-1]] = (children.get(piece[-1], ({},))[0], ids, score)
        self.encode_ids = model.encode
        self.most = REMEMBERED
        #: The library's ids of units.
        self.merges: dict[str, bytes] = {}
        #: Remembered units, in two generations, and their ranked lists.
        self.lists: dict[tuple[str, int], list] = {}
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def keep(self, most: int) -> None:
        """From now on remember `most` units. What is held beyond that is forgotten: Spark uses a
        worker again, so it would stay through the stages of all later work."""
        self.most = most
        for held in (self.merges, self.known, self.older):
            if len(held) > most:
                held.clear()
        if len(self.lists) > most // 10:
            self.lists.clear()

    def lattice(self, unit: str) -> tuple[list[float], list | None]:
        """The forward pass: the best score of each prefix, and for a short unit the edges into each
        place. Those of a long one aren't kept; they are looked up again where the search comes."""
        n, root, pieces, longest = len(unit), self.trie, self.pieces, self.longest
        best = [NOTHING] * (n + 1)
        best[0] = 0.0
        into = [[] for _ in best] if n <= REMEMBERED_CHARS else None
        for start in range(n):
            here, end, children = best[start], start, root
            if unit[start] not in pieces:
                ids, score = self.spelled(unit[start])
                best[start + 1] = max(best[start + 1], here + score)
                if into:
                    into[start + 1].append((here + score, start, score, ids))
            for letter in unit[start : start + longest]:
                got = children.get(letter)
                if got is None:
                    break
                end += 1
                children, ids, score = got
                if ids:
                    through = here + score
                    if through > best[end]:
                        best[end] = through
                    if into:
                        into[end].append((through, start, score, ids))
        return best, into

    def spelled(self, letter: str) -> tuple[bytes, float]:
        """The edge of a character that is no piece."""
        return b"".join(self.bytes[b] for b in letter.encode("utf-8", "replace")), self.unknown

    def edges(self, unit: str, end: int, best: list[float]) -> list[tuple[float, int, float, bytes]]:
        """The edges into a place as (best score through it, start, own score, ids), longest piece first."""
        get, out = self.pieces.get, []
        for start in range(max(0, end - self.longest), end):
            if (got := get(unit[start:end])) is not None:
                out.append((best[start] + got[1], start, got[1], got[0]))
            elif start == end - 1:  # a character that is no piece
                ids, score = self.spelled(unit[start])
                out.append((best[start] + score, start, score, ids))
        return out

    def n_best(self, unit: str, n: int = N_BEST) -> list[tuple[float, bytes]]:
        """The n best segmentations as (score, 32-bit ids), best first.

        Every queued suffix stands for at least one whole segmentation, of exactly the score that
        ranks it, and no two for the same one. So of the queue only as many entries as are still
        wanted can be of use, and it is a short sorted list. A suffix points to the one it prolongs."""
        best, into = self.lattice(unit)
        # (minus the whole score, order of discovery, place, own score, (ids, the suffix after them))
        queue: list[tuple] = [(-best[-1], 0, len(unit), 0.0, None)]
        found: list[tuple[float, bytes]] = []
        number = 0
        while queue:
            _, _, end, own, suffix = queue.pop(0)
            if not end:
                parts = []
                while suffix is not None:
                    parts.append(suffix[0])
                    suffix = suffix[1]
                found.append((own, b"".join(parts)))
                if len(found) == n:
                    break
                continue
            room = n - len(found)
            for through, start, score, ids in into[end] if into else self.edges(unit, end, best):
                number += 1
                rank = -(own + through)
                if len(queue) < room:
                    insort(queue, (rank, number, start, own + score, (ids, suffix)))
                elif rank < queue[-1][0]:
                    queue.pop()
                    insort(queue, (rank, number, start, own + score, (ids, suffix)))
        return found

    def library(self, text: str) -> bytes:
        """The 32-bit ids that the library gives the whole text: it applies merges in order, and
        none crosses units. The line feed before a unit keeps it from putting a space there."""
        units = self.units(text)
        if new := [u for u in dict.fromkeys(units) if u not in self.merges]:
            if len(self.merges) + len(new) > self.most:
                self.merges.clear()
                new = list(dict.fromkeys(units))
            self.merges.update((u, pack(f"<{len(x) - 2}i", *x[2:])) for u, x in zip(new, self.encode_ids(["\n" + u for u in new], num_threads=1)))
        ids = b"".join(map(self.merges.__getitem__, units))
        for u in new:
            if len(u) > REMEMBERED_CHARS:
                del self.merges[u]
        if len(self.merges) > self.most:  # one text's units
            self.merges.clear()
        return ids

    def units(self, text: str) -> list[str]:
        return _UNIT.findall(" " + text) if text else []

    def remembered(self, unit: str) -> tuple[float, bytes, float]:
        """Score and ids of a unit's best segmentation, and the step down to the next one."""
        got = self.known.get(unit)
        if got is None:
            got = self.older.get(unit)
            if got is None:
                found = self.n_best(unit, 2)
                got = (*found[0], found[0][0] - found[1][0] if len(found) > 1 else -NOTHING)
            if len(self.known) >= self.most:  # what was met since the last change stays
                self.known, self.older = {}, self.known
            if len(unit) <= REMEMBERED_CHARS:
                self.known[unit] = got
        return got

    def ranked(self, unit: str, n: int) -> list[tuple[float, bytes]]:
        """n_best, remembered."""
        if (got := self.lists.get((unit, n))) is None:
            got = self.n_best(unit, n)
            if len(unit) <= REMEMBERED_CHARS:
                if len(self.lists) >= self.most // 10:
                    self.lists.clear()
                self.lists[unit, n] = got
        return got

    def encode(self, text: str, n: int = N_BEST) -> list[tuple[float, bytes]]:
        """The n best segmentations of the whole text as (score, 32-bit ids), best first."""
        units = self.units(text)
        firsts = list(map(self.known.get, units))
        if None in firsts:
            firsts = [x or self.remembered(u) for x, u in zip(firsts, units)]
        ids = list(map(_IDS, firsts))
        found = [(sum(map(_SCORE, firsts)), b"".join(ids))]
        if n == 1 or not units:
            return found
        # the units with the smallest steps down, and their ranked segmentations
        steps, chosen = np.fromiter(map(_STEP, firsts), float, len(firsts)), []
        while len(chosen) < n - 1 and steps[i := int(steps.argmin())] < -NOTHING:
            chosen.append(i)
            steps[i] = -NOTHING
        lists = [self.ranked(units[i], n) for i in chosen]
        # the same search over the ranks taken in these units
        queue, seen = [(0.0, (0,) * len(chosen))], set()
        while queue and len(found) < n:
            loss, ranks = heapq.heappop(queue)
            if ranks in seen:
                continue
            seen.add(ranks)
            if any(ranks):
                other = ids.copy()
                for i, rank, ranked in zip(chosen, ranks, lists):
                    other[i] = ranked[rank][1]
                found.append((found[0][0] - loss, b"".join(other)))
            for k, ranked in enumerate(lists):
                if ranks[k] + 1 < len(ranked):
                    heapq.heappush(queue, (loss + ranked[ranks[k]][0] - ranked[ranks[k] + 1][0], (*ranks[:k], ranks[k] + 1, *ranks[k + 1 :])))
        return found

    def decode(self, ids: bytes) -> str:
        """The text of 32-bit ids."""
        pieces = np.frombuffer(ids, "<i4")
        sizes = self.sizes[pieces]
        ends = np.cumsum(sizes)
        at = np.repeat(self.begins[pieces] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.letters[at].tobytes().decode("utf-8", "replace")[1:]


_LOADED: dict[str, Lattice] = {}


def load(path: str) -> Lattice:
    if path not in _LOADED:
        _LOADED[path] = Lattice(path)
    return _LOADED[path]


_BEST = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.binary())]))


def encoded(docs: DataFrame, path: str, n: int = N_BEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, best): the n best segmentations of every row's whole text, best first, as scores
    and 32-bit little-endian ids."""
    runtime.ship(docs.sparkSession)
    arrow = pa.schema([("doc_id", pa.int64()), ("best", _BEST)])

    def run(batches):
        lattice = load(path)
        for batch in in_pieces(batches, 1, TEXT_BYTES):
            rows = [[{"score": s, "ids": i} for s, i in lattice.encode(t.decode(errors="replace") if t else "", n)] for t in utf8(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(rows, _BEST)], schema=arrow)

    return columns(docs, doc_id=docs[id_col].cast("bigint"), text=text_col).mapInArrow(run, "doc_id bigint, best array<struct<score:double,ids:binary>>")


def decoded(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of encoded rows; null ids give null."""
    runtime.ship(rows.sparkSession)
    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        lattice = load(path)
        for batch in in_pieces(batches, 1, TEXT_BYTES):
            texts = [lattice.decode(x) if x is not None else None for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], schema=arrow)

    return columns(rows, doc_id=rows[id_col].cast("bigint"), ids=ids_col).mapInArrow(run, "doc_id bigint, text string")


def segmented(docs: DataFrame, path: str, n: int = N_BEST, keep_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """Per row of docs: n_pieces, the scores of the n best, the digest of the best ids, whether they
    decode to the text; with keep_ids the best ids themselves and the library's. Encoding and decoding run in one pass, so ids needn't travel.
    `remembered` bounds a worker's memory for units; it costs time only, no result depends on it."""
    runtime.ship(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("n_best", pa.int64()), ("scores", pa.list_(pa.float64())), ("ids_sha256", pa.string()), ("round_trip", pa.bool_())]
    schema = "doc_id bigint, n_pieces bigint, n_best bigint, scores array<double>, ids_sha256 string, round_trip boolean"
    arrow = pa.schema([*fields, *[("ids", pa.binary()), ("library_ids", pa.binary())] * keep_ids])

    def run(batches):
        lattice = load(path)
        lattice.keep(remembered)
        for batch in in_pieces(batches, 1, TEXT_BYTES):
            rows = []
            for id_, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                text = raw.decode(errors="replace") if raw else ""
                best = lattice.encode(text, n)
                ids = best[0][1]
                whole = [ids, lattice.library(text)] if keep_ids else []
                rows.append((id_, len(ids) // 4, len(best), [s for s, _ in best], hashlib.sha256(ids).hexdigest(), lattice.decode(ids) == text, *whole))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return columns(docs, doc_id=docs["doc_id"].cast("bigint"), text="text").mapInArrow(run, schema + ", ids binary, library_ids binary" * keep_ids)


def op4(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    rows = segmented(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_pieces", "n_best", F.element_at("scores", 1).alias("score"), (F.col("scores")[0] - F.element_at("scores", -1)).alias("spread"), "ids_sha256", "round_trip")
