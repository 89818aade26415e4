"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from ridgelens.llm import images, jaccard, line_dedup, mixing, neighbours, packing, pii, quality, repair, substrings, tokens, toxicity, trie

QUERIES = {"op1_token_counts": tokens.query, "op2_mix_sources": mixing.query, "op3_ngram_jaccard": jaccard.query, "op4_image_copies": images.query, "op5_personal_data": pii.query, "op6_packing": packing.query, "op7_substring_dedup": substrings.query, "op8_toxicity": toxicity.query, "op9_nearest_neighbours": neighbours.query, "op10_line_dedup": line_dedup.query, "op11_structure_repair": repair.query, "op12_prefix_trie": trie.query, "op13_compression_bands": quality.query}
SQL = {"op2_mix_sources": mixing.SQL, "op3_ngram_jaccard": jaccard.SQL, "op7_substring_dedup": substrings.SQL, "op10_line_dedup": line_dedup.SQL, "op11_structure_repair": repair.SQL, "op12_prefix_trie": trie.SQL}
