"""The queries of the operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, divergence, filters, fingerprint, language, licenses, minhash, mixing, quality, repeats, sharding, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op7_language_id": language.query,
    "op1_ann": ann.query,
    "op2_bpe": bpe.query,
    "op3_mixing": mixing.query,
    "op4_licenses": licenses.query,
    "op5_fingerprints": fingerprint.query,
    "op6_quality": quality.query,
    "op8_repeats": repeats.query,
    "op9_near_dedup": minhash.query,
    "op10_toxicity": toxicity.query,
    "op11_sharding": sharding.query,
    "op12_divergence": divergence.query,
    "op13_filters": filters.query,
}

ORACLES: dict[str, str] = {
    "op1_ann": ann.ORACLE,
    "op3_mixing": mixing.ORACLE,
    "op11_sharding": sharding.ORACLE,
    "op12_divergence": divergence.ORACLE,
    "op13_filters": filters.ORACLE,
}
