"""The queries of this subpackage by name, with the SQL that checks them."""

from __future__ import annotations

from . import exact_dedup, language_id, mixing, ngram_join, packing, periodic_runs, pivot_topk, sharding, simhash, substring_dedup, token_store, url_rules, vector_codes

QUERIES = {
    "op1_golomb_exact_dedup": exact_dedup.op1_golomb_exact_dedup,
    "op2_language_families": language_id.op2_language_families,
    "op3_virtual_slot_shards": sharding.op3_virtual_slot_shards,
    "op4_weighted_mix": mixing.op4_weighted_mix,
    "op5_linear_grouping_pack": packing.op5_linear_grouping_pack,
    "op6_url_association_rules": url_rules.op6_url_association_rules,
    "op7_bit_plane_tokens": token_store.op7_bit_plane_tokens,
    "op8_grouped_prefix_join": ngram_join.op8_grouped_prefix_join,
    "op9_sharded_suffix_arrays": substring_dedup.op9_sharded_suffix_arrays,
    "op10_pivot_topk": pivot_topk.op10_pivot_topk,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_yinyang_codes": vector_codes.op12_yinyang_codes,
    "op13_simhash_tiles": simhash.op13_simhash_tiles,
}
ORACLES = {
    "op1_golomb_exact_dedup": exact_dedup.OP1_SQL,
    "op4_weighted_mix": mixing.OP4_SQL,
    "op8_grouped_prefix_join": ngram_join.OP8_SQL,
    "op10_pivot_topk": pivot_topk.OP10_SQL,
    "op12_yinyang_codes": vector_codes.OP12_SQL,
}
