"""The subpackage's queries and their DuckDB SQL."""

from __future__ import annotations

from . import gif, mixing, packing, quality_rules, rule_ensemble, secrets, simhash, suffix_dedup, token_shards, toxicity

QUERIES = {
    "op1_power_of_two_packing": packing.op1_power_of_two_packing,
    "op2_nnpu_toxicity": toxicity.op2_nnpu_toxicity,
    "op3_suffix_array_dedup": suffix_dedup.op3_suffix_array_dedup,
    "op4_assignment_secrets": secrets.op4_assignment_secrets,
    "op5_sainte_lague_mixing": mixing.op5_sainte_lague_mixing,
    "op6_training_order_shards": token_shards.op6_training_order_shards,
    "op7_rule_ensemble_quality": rule_ensemble.op7_rule_ensemble_quality,
    "op8_gif_frames": gif.op8_gif_frames,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_simhash_bktree": simhash.op10_simhash_bktree,
}

ORACLE_SQL = {
    "op3_suffix_array_dedup": suffix_dedup.ORACLE,
    "op5_sainte_lague_mixing": mixing.ORACLE,
    "op9_quality_rules": quality_rules.ORACLE,
    "op10_simhash_bktree": simhash.ORACLE,
}
