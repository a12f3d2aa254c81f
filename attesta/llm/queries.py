"""The queries of this subpackage and, where SQL can express them, the SQL that checks them."""

from __future__ import annotations

from . import fingerprints, importance, manifest, mixing, ngram_join, packing, privacy, quality, secrets, sharding, substrings, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_ngram_join": ngram_join.op1_ngram_join,
        "op2_secrets": secrets.op2_secrets,
        "op3_quality": quality.op3_quality,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_sharding": sharding.op5_sharding,
        "op6_fingerprints": fingerprints.op6_fingerprints,
        "op7_substrings": substrings.op7_substrings,
        "op8_mixing": mixing.op8_mixing,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_packing": packing.op10_packing,
        "op11_importance": importance.op11_importance,
        "op12_personal_data": privacy.op12_personal_data,
        "op13_manifest": manifest.op13_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality": quality.oracle(), "op8_mixing": mixing.ORACLE, "op11_importance": importance.ORACLE, "op13_manifest": manifest.ORACLE}
