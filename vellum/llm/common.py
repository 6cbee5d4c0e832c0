"""What the operators of this folder share: words, batches and result types."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII bytes that part words; bytes of 0x80 and more belong to characters beyond ASCII.
SPACE = b" \t\n\v\f\r"
_LOWER = bytes(range(65, 91)), bytes(range(97, 123))
LOWER_ASCII = bytes.maketrans(*_LOWER)
#: For words of letters and digits: A-Z become a-z, all other ASCII but a-z and 0-9 becomes a space.
ALNUM_LOWER = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-case words of ASCII letters, digits and characters beyond ASCII; null has none."""
    return text.translate(ALNUM_LOWER).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, unchanged; null has none."""
    return text.split() if text else []


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def in_pieces(batches: Iterator[pa.RecordBatch], text: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut where the bytes of column number `text` reach `most`; a longer text
    stands alone. Bounds what a Python worker holds, however long the texts are."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def columns(df: DataFrame, **named: str | Column) -> DataFrame:
    """Only the named columns, so that no other column's name can clash."""
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(k) for k, c in named.items()])


def result(schema: pa.Schema, **columns: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def doc_key(text: Column) -> Column:
    """Parts rows that share an id but not a text."""
    return F.xxhash64(text)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names that no column of df has, whatever the case of its letters."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name in have:
            name += "_"
        have.add(name)
        out.append(name)
    return out
