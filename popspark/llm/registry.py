"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, minhash, mixing, pii, quality, scoring, secrets, sharding, simhash, topk


def queries() -> dict:
    return {
        "op1_sharding": sharding.query,
        "op2_simhash": simhash.query,
        "op3_quality": quality.query,
        "op4_mixing": mixing.query,
        "op5_pii": pii.query,
        "op6_bpe": bpe.query,
        "op7_minhash": minhash.query,
        "op8_secrets": secrets.query,
        "op9_scoring": scoring.query,
        "op10_topk": topk.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_topk": topk.SQL}
