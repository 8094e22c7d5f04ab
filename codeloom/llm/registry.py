"""Queries of this subpackage by name, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import decontaminate, licenses, minhash, packing, quality, secret_scan, simhash, surrogates, tokens, urls
from codeloom.llm.oracles import ORACLE_SQL as ORACLE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_fingerprints": minhash.op1_minhash_fingerprints,
    "op2_surrogates": surrogates.op2_surrogates,
    "op3_token_counts": tokens.op3_token_counts,
    "op4_quality_ranking": quality.op4_quality_ranking,
    "op5_licence_scan": licenses.op5_licence_scan,
    "op6_url_digests": urls.op6_url_digests,
    "op7_suffix_decontamination": decontaminate.op7_suffix_decontamination,
    "op8_secret_ledger": secret_scan.op8_secret_ledger,
    "op9_simhash_components": simhash.op9_simhash_components,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
}
