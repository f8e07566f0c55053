"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, best_fit, exact_dedup, fingerprint, language_id, license_scan, line_dedup, ngram_jaccard, periodic_runs, piece_bpe, substring_dedup, token_files, trie_bpe


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": license_scan.op1_license_scan,
        "op2_fingerprints": fingerprint.op2_fingerprints,
        "op3_ngram_jaccard": ngram_jaccard.op3_ngram_jaccard,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op6_language_id": language_id.op6_language_id,
        "op7_bpe_codec": trie_bpe.op7_bpe_codec,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_token_files": token_files.op9_token_files,
        "op10_best_fit": best_fit.op10_best_fit,
        "op11_token_alignment": alignment.op11_token_alignment,
        "op12_periodic_runs": periodic_runs.op12_periodic_runs,
        "op13_byte_bpe": piece_bpe.op13_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan.op1_sql(), "op4_exact_dedup": exact_dedup.OP4_SQL, "op5_substring_dedup": substring_dedup.OP5_SQL, "op8_line_dedup": line_dedup.OP8_SQL}
