"""Token counts of whole texts by a public tokenizer, without keeping a token.

Texts are cut at ASCII white space, which no pre-token, special string or merge of the
vocabulary crosses, so a text's count is the sum of its pieces' counts. Long pieces are cut on,
between an ASCII digit and the ASCII letter or digit beside it, where such a tokenizer's
pre-tokens end too. So a long text isn't encoded as a whole, unless it is one pre-token to the
library itself. Pieces not met before are encoded in batches of balanced bytes; a worker remembers
the counts of short ones, up to a fixed number.

Whether a tokenizer's cuts are safe is checked when it is loaded: BPE over pre-tokens that drop
white space, and for the second cut single digits. Any other tokenizer gets whole texts, in the
same balanced batches.

Defined cases: a null text counts as empty; empty texts have no tokens; rows are kept one for one,
in any order and however often they repeat; other columns are ignored.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum import runtime
from vellum.llm.common import columns, in_pieces, utf8

OVER = 2048
BATCH_BYTES = 1 << 18
TEXT_BYTES = 4 << 20
REMEMBERED = 400_000
REMEMBERED_CHARS = 48

#: ASCII white space only: the library's patterns know it as white space under any rule.
_CUT = re.compile(r"[ \t\n\r\f\v]+")
#: Beside a digit, both sides ASCII: neither normalisation nor a special string goes over it.
_DIGIT = re.compile(r"(?<=[0-9])(?=[A-Za-z0-9])|(?<=[A-Za-z])(?=[0-9])")
LONG_CHARS = 4096
_LOADED: dict[str, tuple] = {}


def _cuts_are_safe(spec: dict) -> bool:
    normal, pre = json.dumps(spec.get("normalizer")), json.dumps(spec.get("pre_tokenizer"))
    drops = '"behavior": "Removed", "invert": true' in pre and "^\\\\s" in pre
    no_space = not any(any(c.isspace() for c in t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []))
    known = not set(re.findall(r'"type": "(\w+)"', normal)) - {"Sequence", "NFC", "Replace", "Lowercase"}
    return spec["model"]["type"] == "BPE" and drops and no_space and known and spec["model"].get("dropout") is None


def _digits_are_alone(spec: dict) -> bool:
    """Pre-tokens of letters only or of one digit, and special strings without digits."""
    pre = json.dumps(spec.get("pre_tokenizer"))
    return r"[\\p{L}]+|[\\p{N}]|" in pre and not any(any(c.isdigit() for c in t["content"]) for t in spec.get("added_tokens", []))


def _pieces(text: str, digits: bool) -> list[str]:
    found = _CUT.split(text)
    if digits and max(map(len, found)) > LONG_CHARS:
        found = [p for f in found for p in (_DIGIT.split(f) if len(f) > LONG_CHARS else (f,))]
    return found


def load(path: str) -> tuple:
    """(encode a list of texts to lengths, whether cuts at white space are safe, remembered counts, whether cuts at digits are)"""
    if path not in _LOADED:
        if path.endswith(".json"):
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            safe = _cuts_are_safe(spec)
            _LOADED[path] = (lambda texts: [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)], safe, {}, safe and _digits_are_alone(spec))
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], False, {}, False)
    return _LOADED[path]


def _in_batches(texts: list[str], encode, most: int):
    """Lengths of the texts, encoded in batches of about `most` bytes."""
    found, batch, held = [], [], 0
    for t in texts:
        batch.append(t)
        held += len(t) if t.isascii() else len(t.encode("utf-8", "replace"))
        if held >= most:
            found += encode(batch)
            batch, held = [], 0
    return found + encode(batch) if batch else found


def count_tokens(texts: list[str], path: str, batch_bytes: int = BATCH_BYTES) -> list[int]:
    encode, safe, known, digits = load(path)
    if not safe:
        return _in_batches(texts, encode, batch_bytes)
    pieces = [_pieces(t, digits) for t in texts]
    new = list({p for ps in pieces for p in ps if p not in known})
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        new = list({p for ps in pieces for p in ps})
    known.update(zip(new, _in_batches(new, encode, batch_bytes)))
    counts = [sum(map(known.__getitem__, ps)) for ps in pieces]
    for p in new:
        if len(p) > REMEMBERED_CHARS:
            del known[p]
    return counts


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", over: int = OVER, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs."""
    runtime.ship(docs.sparkSession)
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        for batch in in_pieces(batches, 1, TEXT_BYTES):
            texts = [t or b"" for t in utf8(batch.column(1))]
            counts = count_tokens([t.decode(errors="replace") for t in texts], path, batch_bytes)
            yield pa.record_batch([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(counts, pa.int64())], schema=arrow)

    counted = columns(docs, doc_id=docs[id_col].cast("bigint"), text=text_col).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > over)


def op3(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
