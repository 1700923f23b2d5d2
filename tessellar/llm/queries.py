"""The queries of this package, as the entry module registers them, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard_join, lattice, licenses, line_dedup, media, mixing, quality, suffix_dedup, token_rollup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_subword_lattice": lattice.op1_lattice,
    "op2_jaccard_join": jaccard_join.op2_jaccard,
    "op3_license_scan": licenses.op3_licenses,
    "op4_quality_fm": quality.op4_quality,
    "op5_token_rollup": token_rollup.op5_token_rollup,
    "op6_spaced_seeds": decontaminate.op6_decontaminate,
    "op7_suffix_dedup": suffix_dedup.op7_suffix,
    "op8_media_columns": media.op8_media,
    "op9_source_mix": mixing.op9_mix,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

SQL: dict[str, str] = {
    "op2_jaccard_join": jaccard_join.OP2_SQL,
    "op7_suffix_dedup": suffix_dedup.OP7_SQL,
    "op9_source_mix": mixing.OP9_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
}
