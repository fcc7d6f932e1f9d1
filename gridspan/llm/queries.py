"""The registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import align, bpe, decontaminate, jaccard, language, lexical, mixing, quality, substring, token_count, topk, url_filter, warc

QUERIES = {
    "op1_substring_dedup": substring.op1_substring_dedup,
    "op2_bpe": bpe.op2_bpe,
    "op3_quality": quality.op3_quality,
    "op4_url_filters": url_filter.op4_url_filters,
    "op5_token_counts": token_count.op5_token_counts,
    "op6_warc": warc.op6_warc,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_ngram_jaccard": jaccard.op8_ngram_jaccard,
    "op9_exact_top_k": topk.op9_exact_top_k,
    "op10_language_id": language.op10_language_id,
    "op11_alignment": align.op11_alignment,
    "op12_mixing": mixing.op12_mixing,
    "op13_lexical_search": lexical.op13_lexical_search,
}
ORACLES: dict[str, str] = {**substring.SQL, **url_filter.SQL, **jaccard.SQL, **topk.SQL, **warc.SQL, **lexical.SQL}
