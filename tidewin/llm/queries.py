"""Queries and oracle SQL of this folder."""
from __future__ import annotations

from . import bpe, divergence, embedding_dedup, exact_dedup, filter_audit, html_text, minhash, mixing, pii, quality, secrets, sharding, toxicity

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_pii": pii.op2_pii,
    "op3_mixing": mixing.op3_mixing,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_secrets": secrets.op6_secrets,
    "op7_sharding": sharding.op7_sharding,
    "op8_minhash": minhash.op8_minhash,
    "op9_html_text": html_text.op9_html_text,
    "op10_quality": quality.op10_quality,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_embedding_dedup": embedding_dedup.op13_embedding_dedup,
}

ORACLE_SQL = {"op4_exact_dedup": exact_dedup.OP4_SQL, "op11_source_divergence": divergence.OP11_SQL, "op12_filter_audit": filter_audit.OP12_SQL, "op13_embedding_dedup": embedding_dedup.OP13_SQL}
