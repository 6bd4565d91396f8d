"""The queries of this folder and their DuckDB SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import extraction, idstore, language, media, mixing, neardup, packing, quality, resampling, secrets, sharding, transducer, whitening

QUERIES = {
    "op1_wrapper_induction": extraction.op1_wrapper_induction,
    "op2_secret_ledger": secrets.op2_secret_ledger,
    "op3_mixture_packing": packing.op3_mixture_packing,
    "op4_progressive_jpeg": media.op4_progressive_jpeg,
    "op5_hilbert_shards": sharding.op5_hilbert_shards,
    "op6_similarity_sketch": neardup.op6_similarity_sketch,
    "op7_id_store": idstore.op7_id_store,
    "op8_language_profiles": language.op8_language_profiles,
    "op9_line_quality": quality.op9_line_quality,
    "op10_soft_mixing": mixing.op10_soft_mixing,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_token_transducer": transducer.op12_token_transducer,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}

ORACLE_SQL = {
    "op2_secret_ledger": secrets.OP2_SQL,
    "op5_hilbert_shards": sharding.OP5_SQL,
    "op6_similarity_sketch": neardup.OP6_SQL,
    "op9_line_quality": quality.OP9_SQL,
    "op11_importance_resampling": resampling.OP11_SQL,
}
