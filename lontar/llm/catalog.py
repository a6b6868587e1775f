"""Registered queries of this subpackage, and the SQL of those that SQL can express."""

from . import queries_decontamination, queries_lines, queries_media, queries_mixing, queries_secrets, queries_sharding
from . import queries_simhash, queries_substrings, queries_tokenids, queries_toxicity

QUERIES = {
    "op1_secret_forest": queries_secrets.op1_secret_forest,
    "op2_template_decontamination": queries_decontamination.op2_template_decontamination,
    "op3_iso_media": queries_media.op3_iso_media,
    "op4_rans_token_ids": queries_tokenids.op4_rans_token_ids,
    "op5_repeated_windows": queries_substrings.op5_repeated_windows,
    "op6_extendible_hash_shards": queries_sharding.op6_extendible_hash_shards,
    "op7_fuzzy_lines": queries_lines.op7_fuzzy_lines,
    "op8_toxic_segments": queries_toxicity.op8_toxic_segments,
    "op9_weighted_fair_mix": queries_mixing.op9_weighted_fair_mix,
    "op10_simhash_bk_tree": queries_simhash.op10_simhash_bk_tree,
}

ORACLE_SQL = {
    "op2_template_decontamination": queries_decontamination.OP2_SQL,
    "op6_extendible_hash_shards": queries_sharding.OP6_SQL,
    "op9_weighted_fair_mix": queries_mixing.OP9_SQL,
}
