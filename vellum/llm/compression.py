"""Quality rules with compression bands.

A text's bytes are compressed by zstandard as a whole and in chunks of 256 bytes and of 2 KB. Text
of a kind and length has its usual ratio (bytes before by bytes after): well above it the text
repeats itself, well below it it is no language. Limits go by length, as short texts compress
less. The whole text must be inside its band, and of the chunks of each size at most
`chunk_share` may be outside theirs: none of fewer than 50. Chunks cover all bytes; the last one
ends with the text and overlaps the one before.

Texts below the shortest band say too little about themselves. Windows of 64 bytes are judged by
their size under a fixed prior of letters: words of a script cost few bits a byte, changes of case
inside a word, digits and signs many. Bytes beyond ASCII cost what usual letters do.

Before that come plain counts: words, symbols, repeated lines and repeated 5-word windows.

Defined cases: a null or empty text has no words and fails the base rules; rows are kept one for one; other columns
are ignored.
"""

from __future__ import annotations

import io
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from vellum import runtime
from vellum.llm.common import columns, in_pieces, utf8
from vellum.llm.repeats import _word_hashes

#: (bytes from, least ratio, greatest ratio)
BANDS = ((256, 1.15, 2.2), (512, 1.3, 2.5), (1024, 1.4, 2.8), (4096, 1.5, 3.2), (16384, 1.6, 3.6), (65536, 1.7, 4.2))
CHUNK_BYTES = (256, 2048)
CHUNK_SHARE = 0.02
#: Below the shortest band: window, and least ratio of its bits to those under the prior.
PRIOR_BYTES, PRIOR_LEAST = 64, 1.38
LEVEL = 3
REPEAT_WINDOW = 5
SYMBOLS = b"#*$%&|<>"
TEXT_BYTES = 4 << 20
#: Above this length a text's windows are counted in arrays.
LONG_BYTES = 256 << 10


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    symbols = sum(map(text.count, (bytes([c]) for c in SYMBOLS)))
    if len(text) > LONG_BYTES:
        n, chars, repeated = _long_counts(text)
        return n, chars, symbols, _repeated_lines(io.BytesIO(text)), repeated
    words = text.split()
    chars = len(b"".join(words).decode(errors="replace"))
    repeated = 0
    if len(words) > REPEAT_WINDOW:
        windows = list(zip(*(words[i:] for i in range(REPEAT_WINDOW))))
        n = Counter(windows)
        if len(n) < len(windows):
            repeated = _covered([i for i, w in enumerate(windows) if n[w] > 1])
    return len(words), chars, symbols, _repeated_lines(text.split(b"\n")), repeated


def _repeated_lines(lines) -> int:
    seen: set[bytes] = set()
    n = 0
    for line in lines:
        line = line.rstrip(b"\n")
        if line.strip():
            n += 1
            seen.add(line)
    return n - len(seen)


def _covered(starts: list[int]) -> int:
    """Number of words in windows that start there, in order."""
    covered = until = 0
    for i in starts:
        covered += i + REPEAT_WINDOW - max(i, until)
        until = i + REPEAT_WINDOW
    return covered


def _long_counts(text: bytes) -> tuple[int, int, int]:
    """n_words, word_chars and n_repeat_words, in a few numbers per word: windows are sorted by a
    hash, and those of equal hashes are compared by their words."""
    raw = np.frombuffer(text, np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    chars = int(np.count_nonzero(~space & ((raw & 0xC0) != 0x80)))
    kept = ~space
    kept[1:] |= space[1:] & ~space[:-1]  # one space after each word
    kept[0] &= not space[0]
    line = raw[kept]
    line = np.where(space[kept], np.uint8(32), line)
    if not len(line):
        return 0, 0, 0
    if line[-1] != 32:
        line = np.append(line, np.uint8(32))
    ends = np.flatnonzero(line == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(ends) - REPEAT_WINDOW + 1
    if n < 2:
        return len(ends), chars, 0
    hashes = np.empty(len(ends), np.uint64)
    for i in range(0, len(ends), 1 << 16):
        first, last = starts[i : i + (1 << 16)], ends[i : i + (1 << 16)]
        hashes[i : i + (1 << 16)] = _word_hashes(line[first[0] : last[-1] + 1], first - first[0], last - first[0])
    windows = np.zeros(n, np.uint64)
    for j in range(REPEAT_WINDOW):
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + hashes[j : n + j]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    met = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    new = np.concatenate([[True], ~same])[met]
    data, found, seen = line.tobytes(), [], {}
    for i, first in zip(order[met].tolist(), new.tolist()):
        if first:
            seen = {}
        words = data[starts[i] : ends[i + REPEAT_WINDOW - 1]]
        if words not in seen:
            seen[words] = i
            continue
        if seen[words] is not None:
            found.append(seen[words])
            seen[words] = None
        found.append(i)
    return len(ends), chars, _covered(sorted(found))


def _prior() -> np.ndarray:
    """Bits by (class of the byte before, byte): after no letter, after a capital, after a small letter."""
    letters = dict(zip("etaoinshrdlucmfwypvbgkjqxz", (3.3, 3.7, 3.9, 4.0, 4.1, 4.1, 4.2, 4.2, 4.3, 4.8, 4.8, 5.2, 5.2, 5.3, 5.4, 5.5, 5.5, 5.6, 6.0, 6.0, 5.6, 6.5, 8.0, 8.5, 8.0, 7.5)))
    bits = np.full((3, 256), 7.0)
    bits[:, 128:] = 4.5
    bits[:, [32, 10]] = 2.7
    bits[:, [44, 46]] = 5.5
    for letter, n in letters.items():
        bits[:, ord(letter)] = n
        bits[:, ord(letter) - 32] = n + np.array([2.0, 1.0, 6.0])
    bits[0, 48:58], bits[1:, 48:58] = 6.0, 9.0
    return bits


_BITS = _prior()
_CLASS = np.array([1 if 65 <= c <= 90 else 2 if 97 <= c <= 122 or c >= 128 else 0 for c in range(256)])


def starts(length: int, chunk: int) -> list[int]:
    """Where chunks that cover every byte start; the last one ends with the text."""
    return [*range(0, length - chunk, chunk), length - chunk] if length > chunk else [0]


class Bands:
    def __init__(self, bands=BANDS, chunks: tuple[int, ...] = CHUNK_BYTES, share: float = CHUNK_SHARE, level: int = LEVEL):
        self.bands, self.chunks, self.share = bands, chunks, share
        self.lengths = [b[0] for b in bands]
        self.compress = zstandard.ZstdCompressor(level=level, write_content_size=False).compress

    def ratio(self, data: bytes) -> float:
        return len(data) / len(self.compress(data)) if data else 1.0

    def place(self, length: int, ratio: float) -> int:
        """-1 below the band, 1 above it, 0 inside it or where there is none."""
        k = bisect_right(self.lengths, length) - 1
        if k < 0:
            return 0
        _, low, high = self.bands[k]
        return -1 if ratio < low else int(ratio > high)

    def unlike(self, text: bytes) -> tuple[int, int]:
        """Number of windows of a short text, of those that the prior holds for no language."""
        codes = np.frombuffer(text, np.uint8)
        bits = _BITS[np.concatenate([[0], _CLASS[codes[:-1]]]), codes]
        at = starts(len(text), PRIOR_BYTES)
        return len(at), sum(8 * len(w) < PRIOR_LEAST * w.sum() for w in (bits[i : i + PRIOR_BYTES] for i in at))

    def judge(self, text: bytes | None) -> tuple[float, int, int, bool]:
        """Ratio of the whole, number of chunks, of those outside their band, verdict."""
        if not text:
            return 1.0, 0, 0, True
        whole = self.ratio(text)
        if len(text) < self.lengths[0]:
            n, outside = self.unlike(text)
            return whole, n, outside, outside == 0
        fine, n, outside = self.place(len(text), whole) == 0, 0, 0
        for size in self.chunks:
            if len(text) >= size:
                at = starts(len(text), size)
                out = sum(self.place(size, self.ratio(text[i : i + size])) != 0 for i in at)
                fine = fine and out <= self.share * len(at)
                n, outside = n + len(at), outside + out
        return whole, n, outside, fine


_ARROW = pa.schema(
    [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()),
     ("kept", pa.bool_()), ("ratio", pa.float64()), ("n_chunks", pa.int64()), ("n_chunks_outside", pa.int64())]
)
SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, ratio double, n_chunks bigint, n_chunks_outside bigint"


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bands) -> DataFrame:
    """The counts, the ratio and the verdict for every row of docs."""
    runtime.ship(docs.sparkSession)

    def run(batches):
        rules = Bands(**bands)
        for batch in in_pieces(batches, 1, TEXT_BYTES):
            rows = []
            for id_, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                base = base_counts(text)
                failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
                ratio, chunks, outside, fine = rules.judge(text)
                rows.append((id_, *base, failed, not failed and fine, ratio, chunks, outside))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return columns(docs, doc_id=docs[id_col].cast("bigint"), text=text_col).mapInArrow(run, SCHEMA)


def op8(docs: DataFrame) -> DataFrame:
    return quality_rules(docs)
