"""The queries of this package, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from . import byte_bpe, hyperminhash, iblt, licenses, multi_index, packing, preference, prefix_trie, sharding, source_mix, structure_repair, suffix_dedup, toxicity

QUERIES = {
    "op1_preference_pairs": preference.query,
    "op2_license_scan": licenses.query,
    "op3_bloom_fingerprints": iblt.query,
    "op4_poisson_mix": source_mix.query,
    "op5_multi_index_search": multi_index.query,
    "op6_hyperminhash": hyperminhash.query,
    "op7_factorization_machine": toxicity.query,
    "op8_external_shuffle": sharding.query,
    "op9_exact_complement_packing": packing.query,
    "op10_suffix_array_dedup": suffix_dedup.query,
    "op11_prefix_trie": prefix_trie.query,
    "op12_byte_bpe": byte_bpe.query,
    "op13_structure_repair": structure_repair.query,
}

ORACLE_SQL = {
    "op1_preference_pairs": preference.ORACLE_SQL,
    "op3_bloom_fingerprints": iblt.ORACLE_SQL,
    "op4_poisson_mix": source_mix.ORACLE_SQL,
    "op6_hyperminhash": hyperminhash.ORACLE_SQL,
    "op10_suffix_array_dedup": suffix_dedup.ORACLE_SQL,
    "op11_prefix_trie": prefix_trie.ORACLE_SQL,
    "op13_structure_repair": structure_repair.ORACLE_SQL,
}
