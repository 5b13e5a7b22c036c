"""Driver queries of the subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import language, media, mixing, neardup, packing, pii, prefix_trie, quality, structure, token_counts, topk, toxicity, url_filters


def queries() -> dict:
    return {
        "op1_token_attribution": token_counts.query,
        "op2_pack_best_fit": packing.query,
        "op3_near_duplicates": neardup.query,
        "op4_language_spans": language.query,
        "op5_toxicity_trees": toxicity.query,
        "op6_exact_top_k": topk.query,
        "op7_quality_pairs": quality.query,
        "op8_jpeg_media": media.query,
        "op9_mix_sources": mixing.query,
        "op10_personal_data": pii.query,
        "op11_url_filters": url_filters.query,
        "op12_conversation_repair": structure.query,
        "op13_prefix_trie": prefix_trie.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_top_k": topk.SQL, "op9_mix_sources": mixing.SQL, "op11_url_filters": url_filters.SQL, "op12_conversation_repair": structure.SQL, "op13_prefix_trie": prefix_trie.SQL}
