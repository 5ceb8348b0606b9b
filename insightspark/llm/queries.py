"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from insightspark.llm import chat, classifier, divergence, exact_dedup, mixing, packing, pii, quality_rules, runs, secrets, sharding, simhash, wavelet
from insightspark.session import prepare

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": chat.op1_chat,
    "op2_pii": pii.op2_pii,
    "op3_quality_classifier": classifier.op3_quality_classifier,
    "op4_simhash": simhash.op4_simhash,
    "op5_wavelet": wavelet.op5_wavelet,
    "op6_secrets": secrets.op6_secrets,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op9_packing": packing.op9_packing,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_runs": runs.op11_runs,
    "op12_sharding": sharding.op12_sharding,
    "op13_divergence": divergence.op13_divergence,
}
_SQL = {"op1_chat": chat.SQL, "op6_secrets": secrets.SQL, "op7_exact_dedup": exact_dedup.SQL, "op8_mixing": mixing.SQL, "op13_divergence": divergence.SQL}


def _prepared(fn):
    return lambda spark, sf_dir: fn(prepare(spark), sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _prepared(fn) for name, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql.strip() for name, sql in _SQL.items()}
