"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, language, mixing, oracles, partenum, quality, sharding, substrings, suffixdedup, toxicity, vectors


def queries() -> dict:
    return {"op1_cotrain_quality": quality.op1, "op2_nnpu_toxicity": toxicity.op2, "op3_fm_decontaminate": decontaminate.op3, "op4_label_shards": sharding.op4, "op5_partenum_join": partenum.op5, "op6_hd_language": language.op6, "op7_mixing": mixing.op7, "op8_debruijn_substrings": substrings.op8, "op9_runlength_suffixes": suffixdedup.op9, "op10_collision_vectors": vectors.op10}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_fm_decontaminate": oracles.OP3_SQL, "op5_partenum_join": oracles.OP5_SQL, "op7_mixing": mixing.OP7_SQL, "op8_debruijn_substrings": oracles.OP8_SQL,
        "op9_runlength_suffixes": oracles.OP9_SQL, "op10_collision_vectors": oracles.OP10_SQL,
    }
