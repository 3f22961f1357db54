"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from newsloom.llm import bpe, chat, decontaminate, fingerprints, jaccard_join, line_dedup, prefix_trie, quality, sharding, token_counts, toxicity, url_filters, whitening


def queries() -> dict:
    return {
        "op1_url_filter": url_filters.op1_url_filter,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_fingerprints": fingerprints.op3_fingerprints,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_chat_format": chat.op5_chat_format,
        "op6_sharding": sharding.op6_sharding,
        "op7_quality_filter": quality.op7_quality_filter,
        "op8_byte_bpe": bpe.op8_byte_bpe,
        "op9_ngram_jaccard": jaccard_join.op9_ngram_jaccard,
        "op10_token_counts": token_counts.op10_token_counts,
        "op11_whitening": whitening.op11_whitening,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_toxicity": toxicity.op13_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": decontaminate.OP2_SQL, "op4_line_dedup": line_dedup.OP4_SQL, "op5_chat_format": chat.OP5_SQL, "op12_prefix_trie": prefix_trie.OP12_SQL}
