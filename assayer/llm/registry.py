"""Queries over these operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from assayer.llm import bpe, chat, embeddings, katz, lexical, media, mixing, packing, quality, resampling, secrets, simhash, toxicity

QUERIES = {
    "op1_katz_scores": katz.op1_katz_scores,
    "op1_katz_bigram_scores": katz.op1_katz_bigram_scores,
    "op1_katz_trigram_scores": katz.op1_katz_trigram_scores,
    "op2_embedding_near_dedup": embeddings.op2_embedding_near_dedup,
    "op3_perspective_rotation": chat.op3_perspective_rotation,
    "op3_rendered_dialogues": chat.op3_rendered_dialogues,
    "op4_media_columns": media.op4_media_columns,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_lexical_search": lexical.op11_lexical_search,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_bpe_round_trip": bpe.op13_bpe_round_trip,
    "pipeline": corpus_pipeline.run,
}
#: Trained models, hashes, positions of matches and codecs are beyond SQL; tests compare those with brute force.
ORACLES: dict[str, str] = {
    "op2_embedding_near_dedup": embeddings.OP2_SQL,
    "op3_perspective_rotation": chat.OP3_SQL,
    "op3_rendered_dialogues": chat.OP3_RENDERED_SQL,
    "op5_mix_sources": mixing.OP5_SQL,
    "op11_lexical_search": lexical.OP11_SQL,
}
