"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, divergence, fill_in_middle, jaccard_join, language, maxent, packing, pii, quality, quotes, secret_scan, suffix_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secret_scan.op1,
    "op2_packing": packing.op2,
    "op3_decontaminate": decontaminate.op3,
    "op4_toxicity": toxicity.op4,
    "op5_language": language.op5,
    "op6_maxent": maxent.op6,
    "op7_quotes": quotes.op7,
    "op8_pii": pii.op8,
    "op9_jaccard_join": jaccard_join.op9,
    "op10_quality": quality.op10,
    "op11_divergence": divergence.op11,
    "op12_suffix_dedup": suffix_dedup.op12,
    "op13_fill_in_middle": fill_in_middle.op13,
}

ORACLE: dict[str, str] = {
    "op7_quotes": quotes.ORACLE,
    "op9_jaccard_join": jaccard_join.ORACLE,
    "op11_divergence": divergence.ORACLE,
    "op12_suffix_dedup": suffix_dedup.ORACLE,
    "op13_fill_in_middle": fill_in_middle.ORACLE,
}
