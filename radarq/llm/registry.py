"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from . import audio, collocations, decontaminate, html_text, line_dedup, near_duplicates, order_minhash, packing, pii, source_divergence, suffix_dedup, token_rollup, toxicity

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_pii": pii.op3_pii,
    "op4_token_counts": token_rollup.op4_token_counts,
    "op5_ngram_jaccard_join": near_duplicates.op5_ngram_jaccard_join,
    "op6_media_columns": audio.op6_media_columns,
    "op7_packing": packing.op7_packing,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_html_extraction": html_text.op9_html_extraction,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_source_divergence": source_divergence.op11_source_divergence,
    "op12_order_minhash": order_minhash.op12_order_minhash,
    "op13_collocations": collocations.op13_collocations,
}
ORACLES = {
    "op2_decontaminate": decontaminate.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op11_source_divergence": source_divergence.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
