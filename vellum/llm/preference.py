"""Preference formatting of paired conversations.

A chosen and a rejected conversation are compared turn by turn. The longest prefix of equal turns
(role and text) is the prompt, rendered once. What follows in either conversation is its
completion. Only assistant text is to be learned: each completion comes with the character spans
of its assistant turns, end mark included; all else in it is masked.

All of it is DataFrame expressions; a conversation's turns are gathered by its id, and pairs meet
by id. A pair is one training example, so its turns meet in one row.

Defined cases: turns are put in order of turn, role and text, and exact repeats of a turn are one;
null roles and texts equal each other and are rendered as empty; conversations without an id are
left out; where a conversation is a prefix of the other its completion is empty, where both are
equal both are; a pair is usable if its completions differ and each has an assistant turn; a pair
without a rejected conversation has null in its place and isn't usable; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import columns

#: The template: a turn is OPEN role LINE text CLOSE.
OPEN, LINE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
LEARNED = "assistant"
TURNS = "array<struct<role:string,text:string>>"


def conversations(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turns) of a table with a row per turn."""
    rows = columns(turns, id=turns[id_col].cast("bigint"), turn=turns["turn"].cast("bigint"), role="role", text="text").where("id is not null")
    gathered = rows.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    return gathered.select("id", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def _text(x: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(x["role"], F.lit("")), F.lit(LINE), F.coalesce(x["text"], F.lit("")), F.lit(CLOSE))


def common_turns(a: Column, b: Column) -> Column:
    """The number of equal turns at the start."""
    different = F.array_position(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: ~x["a"].eqNullSafe(x["b"])), True)
    return F.when(different == 0, F.size(a)).otherwise(different - 1).cast("int")


def _spans(turns: Column) -> Column:
    """[start, stop) characters of the assistant's text and end mark in the rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(done, x):
        head = done["at"] + len(OPEN) + F.char_length(F.coalesce(x["role"], F.lit(""))) + len(LINE)
        stop = head + F.char_length(F.coalesce(x["text"], F.lit(""))) + len(CLOSE.rstrip("\n"))
        after = stop + len(CLOSE) - len(CLOSE.rstrip("\n"))
        own = F.array(F.struct(head.cast("int").alias("start"), stop.cast("int").alias("stop")))
        return F.struct(after.alias("at"), F.when(x["role"] == LEARNED, F.concat(done["spans"], own)).otherwise(done["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda x: x["spans"])


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """chosen(id, turns) and rejected(id, turns): one formatted row per id of chosen."""
    return formatted(chosen.select("id", F.col("turns").alias("c")).join(rejected.select("id", F.col("turns").alias("r")), "id", "left"))


def formatted(pairs: DataFrame) -> DataFrame:
    """pairs(id, c, r): arrays of turns, r may be null. Rows of n_common, prompt, chosen, rejected,
    chosen_spans, rejected_spans and usable."""
    n = F.when(F.col("r").isNull(), F.lit(0)).otherwise(common_turns(F.col("c"), F.col("r")))
    parted = pairs.withColumn("n", n).select(
        "id", "n", F.slice("c", 1, F.col("n")).alias("p"),
        F.slice("c", F.col("n") + 1, F.size("c")).alias("c"), F.slice("r", F.col("n") + 1, F.greatest(F.size("r"), F.lit(0))).alias("r"),
    )
    rendered = lambda x: F.array_join(F.transform(x, _text), "")
    learned = lambda x: F.exists(x, lambda t: t["role"].eqNullSafe(F.lit(LEARNED)))
    return parted.select(
        "id", F.col("n").alias("n_common"), rendered("p").alias("prompt"), rendered("c").alias("chosen"), rendered("r").alias("rejected"),
        _spans(F.col("c")).alias("chosen_spans"), _spans(F.col("r")).alias("rejected_spans"),
        F.coalesce(F.col("r").isNotNull() & learned("c") & learned("r") & (rendered("c") != rendered("r")), F.lit(False)).alias("usable"),
    )


def beside_neighbours(chosen: DataFrame) -> DataFrame:
    """(id, c, r): each conversation, and as rejected its turns before its last assistant turn,
    then the last assistant turn of the conversation whose id differs in the last bit; null where
    either has no assistant turn. Only the replies travel to their neighbours."""
    replies = F.filter("turns", lambda t: t["role"] == LEARNED)
    after = F.array_position(F.reverse(F.transform("turns", lambda t: F.coalesce(t["role"] == LEARNED, F.lit(False)))), True).cast("int")
    sent = chosen.select(F.col("id").bitwiseXOR(F.lit(1).cast("bigint")).alias("id"), F.try_element_at(replies, F.lit(-1)).alias("reply")).where("reply is not null")
    both = chosen.withColumn("before", F.size("turns") - after).join(sent, "id", "left")
    spliced = F.when(F.col("reply").isNotNull() & (F.col("before") < F.size("turns")), F.concat(F.slice("turns", 1, F.col("before")), F.array("reply")))
    return both.select("id", F.col("turns").alias("c"), spliced.alias("r"))


def op6(turns: DataFrame) -> DataFrame:
    rows = formatted(beside_neighbours(conversations(turns)))
    as_text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"].cast("string"), x["stop"].cast("string"))), ",")
    return rows.select(
        F.col("id").alias("conv_id"), F.col("n_common").cast("bigint").alias("n_common"), F.sha2("prompt", 256).alias("prompt_sha256"),
        F.sha2("chosen", 256).alias("chosen_sha256"), F.sha2("rejected", 256).alias("rejected_sha256"),
        as_text("chosen_spans").alias("chosen_spans"), as_text("rejected_spans").alias("rejected_spans"), "usable",
    )


ORACLE = """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)),
k AS (SELECT conv_id, max(n) AS k, max_by(text, n) AS reply FROM o WHERE role = 'assistant' GROUP BY conv_id),
r AS (SELECT a.conv_id, a.k, b.reply FROM k a JOIN k b ON b.conv_id = xor(a.conv_id, 1)),
j AS (SELECT o.conv_id, o.n, o.role, o.text FROM o JOIN r USING (conv_id) WHERE o.n < r.k UNION ALL SELECT conv_id, k, 'assistant', reply FROM r),
d AS (SELECT coalesce(o.conv_id, j.conv_id) AS conv_id, min(CASE WHEN o.role = j.role AND o.text = j.text THEN NULL ELSE coalesce(o.n, j.n) END) - 1 AS n FROM o FULL JOIN j ON o.conv_id = j.conv_id AND o.n = j.n GROUP BY 1),
m AS (SELECT conv_id, max(n) AS size FROM o GROUP BY 1),
c AS (SELECT m.conv_id, r.conv_id IS NOT NULL AS paired, CASE WHEN r.conv_id IS NULL THEN 0 ELSE coalesce(d.n, m.size) END AS common FROM m LEFT JOIN r USING (conv_id) LEFT JOIN d USING (conv_id)),
s AS (SELECT 'c' AS side, conv_id, n, role, text, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS x FROM o UNION ALL SELECT 'r', conv_id, n, role, text, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) FROM j),
e AS (SELECT side, conv_id, n, role, x, common, coalesce(sum(CASE WHEN n > common THEN length(x) ELSE 0 END) OVER (PARTITION BY side, conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s JOIN c USING (conv_id)),
f AS (SELECT side, conv_id, coalesce(string_agg(x, '' ORDER BY n) FILTER (n <= common), '') AS prompt, coalesce(string_agg(x, '' ORDER BY n) FILTER (n > common), '') AS rest,
  coalesce(string_agg(CAST(CAST(off + 13 + length(role) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(off + length(x) - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY n) FILTER (n > common AND role = 'assistant'), '') AS spans FROM e GROUP BY side, conv_id)
SELECT c.conv_id, CAST(c.common AS BIGINT) AS n_common, sha256(a.prompt) AS prompt_sha256, sha256(a.rest) AS chosen_sha256,
  CASE WHEN c.paired THEN sha256(b.rest) END AS rejected_sha256, a.spans AS chosen_spans, CASE WHEN c.paired THEN b.spans END AS rejected_spans,
  coalesce(c.paired AND a.spans <> '' AND b.spans <> '' AND a.rest <> b.rest, false) AS usable
FROM c JOIN f a ON a.conv_id = c.conv_id AND a.side = 'c' LEFT JOIN f b ON b.conv_id = c.conv_id AND b.side = 'r'
"""
