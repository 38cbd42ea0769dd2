"""Queries of the training-data operators and their SQL for the comparison."""

from __future__ import annotations

from . import audio, bpe, divergence, exact_dedup, html_main, jaccard, langid, licences, mixing, quality, records, repair, sharding

QUERIES = {
    "op1_mix_sources": mixing.op1,
    "op2_licence_scan": licences.op2,
    "op3_quality_pu": quality.op3,
    "op4_main_text": html_main.op4,
    "op5_exact_dedup": exact_dedup.op5,
    "op6_language_id": langid.op6,
    "op7_audio_fingerprint": audio.op7,
    "op8_jaccard_join": jaccard.op8,
    "op9_token_records": records.op9,
    "op10_bpe_tree": bpe.op10,
    "op11_divergence": divergence.op11,
    "op12_conversation_repair": repair.op12,
    "op13_rendezvous_shards": sharding.op13,
    # Parts of op1 and op2 that SQL can express.
    "mixing_targets": mixing.mixing_targets,
    "licence_phrases": licences.licence_phrases,
}

ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op8_jaccard_join": jaccard.OP8_SQL,
    "op11_divergence": divergence.OP11_SQL,
    "op12_conversation_repair": repair.OP12_SQL,
    "op13_rendezvous_shards": sharding.OP13_SQL,
    "mixing_targets": mixing.TARGETS_SQL,
    "licence_phrases": licences.PHRASES_SQL,
}
