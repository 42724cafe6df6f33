"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from sextant.llm import (
    chat, divergence, exact, licenses, mixing, neardup, pieces, quality, repeats, secrets, sharding,
    toxicity, whitening,
)

QUERIES = {
    "op1_exact_dedup": exact.op1_exact_dedup,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_chat_format": chat.op4_chat_format,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_minhash_neardup": neardup.op6_minhash_neardup,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_repeated_passages": repeats.op10_repeated_passages,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_sharding": sharding.op13_sharding,
}

ORACLES = {
    "op1_exact_dedup": exact.OP1_SQL,
    "op2_mix_sources": mixing.OP2_SQL,
    "op3_secret_scan": secrets.OP3_SQL,
    "op4_chat_format": chat.OP4_SQL,
    "op5_quality_rules": quality.OP5_SQL,
    "op6_minhash_neardup": neardup.OP6_SQL,
    "op9_license_scan": licenses.OP9_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
}
