"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from pricelens.llm import (
    collocations,
    exact_bloom,
    interleaved,
    lexical_search,
    line_runs,
    main_text,
    packing,
    pii_spans,
    quality_pu,
    simhash_cover,
    source_mix,
    token_counts,
    url_filter,
)

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_source_mix": source_mix.op3_source_mix,
    "op4_line_dedup": line_runs.op4_line_dedup,
    "op5_quality_classifier": quality_pu.op5_quality_classifier,
    "op6_media_columns": interleaved.op6_media_columns,
    "op7_packing": packing.op7_packing,
    "op8_pii_spans": pii_spans.op8_pii_spans,
    "op9_simhash_near_dedup": simhash_cover.op9_simhash_near_dedup,
    "op10_exact_dedup": exact_bloom.op10_exact_dedup,
    "op11_collocations": collocations.op11_collocations,
    "op12_main_text": main_text.op12_main_text,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}

ORACLES = {"op4_line_dedup": line_runs.ORACLE, "op10_exact_dedup": exact_bloom.ORACLE, "op11_collocations": collocations.ORACLE, "op13_lexical_search": lexical_search.ORACLE}
