"""The operators of this folder as registered queries, each over its whole tables."""

from __future__ import annotations

from vellum import runtime
from vellum.llm import compression, decontaminate, language_id, licenses, ordinal, pieces, preference, repeats, simhash, token_counts


def _over(*tables: str):
    def made(f):
        def query(spark, sf_dir):
            runtime.ship(spark)
            return f(*[runtime.table(spark, sf_dir, t) for t in tables])

        query.__doc__ = f.__doc__
        return query

    return made


QUERIES = {
    "op1_benchmark_decontamination": _over("documents", "benchmark")(decontaminate.op1),
    "op2_simhash_groups": _over("documents")(simhash.op2),
    "op3_token_counts": _over("documents")(token_counts.op3),
    "op4_piece_lattice": _over("documents")(pieces.op4),
    "op5_language_id": _over("documents")(language_id.op5),
    "op6_preference_pairs": _over("conversations")(preference.op6),
    "op7_ordinal_quality": _over("documents", "labels")(ordinal.op7),
    "op8_compression_bands": _over("documents")(compression.op8),
    "op9_substring_dedup": _over("documents")(repeats.op9),
    "op10_license_scan": _over("documents")(licenses.op10),
}

#: The queries that SQL can express. The others are tested against brute force, round trips or
#: held-out accuracy.
ORACLES = {
    "op1_benchmark_decontamination": decontaminate.ORACLE,
    "op6_preference_pairs": preference.ORACLE,
    "op9_substring_dedup": repeats.ORACLE,
}
