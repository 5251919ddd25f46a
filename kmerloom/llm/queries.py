"""Queries of the training-data operators and, where SQL can express them, their SQL."""

import corpus_pipeline
from kmerloom.llm import alignment, host_rules, importance, language_masks, mixing, near_dup, packing, piece_codec, quality_ranking, secrets, shared_strings, syncmers, warc

QUERIES = {
    "op1_quality_ranking": quality_ranking.op1_quality_ranking,
    "op2_warc": warc.op2_warc,
    "op3_language_masks": language_masks.op3_language_masks,
    "op4_shared_strings": shared_strings.op4_shared_strings,
    "op5_near_duplicates": near_dup.op5_near_duplicates,
    "op6_host_rules": host_rules.op6_host_rules,
    "op7_secret_scans": secrets.op7_secret_scans,
    "op8_syncmers": syncmers.op8_syncmers,
    "op9_piece_codec": piece_codec.op9_piece_codec,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_importance": importance.op11_importance,
    "op12_best_fit": packing.op12_best_fit,
    "op13_alignment": alignment.op13_alignment,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {
    "op2_warc": warc.OP2_SQL,
    "op4_shared_strings": shared_strings.OP4_SQL,
    "op5_near_duplicates": near_dup.OP5_SQL,
    "op6_host_rules": host_rules.OP6_SQL,
    "op10_mix_sources": mixing.OP10_SQL,
    "op11_importance": importance.OP11_SQL,
}
