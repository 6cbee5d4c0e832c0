"""A training corpus from raw documents: good ones, one of each near-duplicate group, without
passages that repeat, without benchmark passages, as piece ids.

Each stage takes what the one before kept; between stages rows are written as Parquet and read
again. Stages 1, 2 and 4 drop rows and leave the others as they are; stage 3 cuts words out of
texts and drops no row; stage 5 returns one row per document with its ids. Null texts are scored,
fingerprinted and encoded as empty ones; empty tables pass through as empty; columns beyond those
of documents stay until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum import runtime
from vellum.llm import decontaminate, near_copies, ordinal, pieces, repeats


#: Units that a worker remembers in the last stage. Spark uses workers again, so an executor has what
#: they hold beside its heap in all later work: one process over 67 MB of check_l's texts had 590 MB
#: at the operator's own 500,000 and 330 MB at this, for 35 % more CPU seconds.
REMEMBERED = 100_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the classifier, fitted on the labels, holds for good."""
    return ordinal.good_documents(docs, runtime.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the first document of each group of near copies. Its method with 5-word shingles
    and fingerprints wide enough for a similarity of 0.8; 4 of 64 bits bind its own query only."""
    return near_copies.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: texts without the passages that stand earlier in the corpus."""
    return repeats.cut_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that aren't contaminated by the benchmark."""
    return decontaminate.clean_documents(docs, runtime.table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: each document's ids for training, as the model's library gives them, and beside
    them its best segmentation by the lattice, with the step down to the last of the n best."""
    import public_tokenizers

    rows = pieces.segmented(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_ids=True, remembered=REMEMBERED)
    spread = F.col("scores")[0] - F.element_at("scores", -1)
    return rows.select("doc_id", F.expr("octet_length(library_ids) div 4").alias("n_ids"), F.col("library_ids").alias("ids"), "n_pieces", F.element_at("scores", 1).alias("score"), spread.alias("spread"), "round_trip", F.col("ids").alias("best_ids"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: The classifier and the fingerprints have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    runtime.ship(spark)
    docs = runtime.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = runtime.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
