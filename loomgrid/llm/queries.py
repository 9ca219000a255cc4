"""The corpus operators' queries and their SQL, by the names under which they are registered."""

from __future__ import annotations

from . import alignment, ann, classifier, fingerprints, licenses, mixing, near_dup, packing, pii, prefix_trie, quality_rules, sharding, token_counts

QUERIES = {
    "op1_subword_quality": classifier.query,
    "op7_trie_token_counts": token_counts.query,
    "op10_ivfpq_neighbours": ann.query,
    "op6_hypergeometric_shards": sharding.query,
    "op9_license_index": licenses.query,
    "op2_semi_markov_pii": pii.query,
    "op3_genetic_packing": packing.query,
    "op4_hierarchical_mix": mixing.query,
    "op5_circulant_minhash": near_dup.query,
    "op8_host_quality": quality_rules.query,
    "op11_byte_owner_alignment": alignment.query,
    "op12_improbable_features": fingerprints.query,
    "op13_refined_prefix_trie": prefix_trie.query,
}

ORACLES: dict[str, str] = {
    "op5_circulant_minhash": near_dup.SQL,
    "op8_host_quality": quality_rules.SQL,
    "op13_refined_prefix_trie": prefix_trie.SQL,
}
