"""Queries of this subpackage by name, and their SQL twins."""

from __future__ import annotations

from glycoflow.llm import decontam, extract, frames, lines, minhash, packing, quality, quotes, repair, search, substring, suffix_dedup, warc

QUERIES = {
    "op1_substring_dedup": substring.op1_substring_dedup,
    "op2_quality": quality.op2_quality,
    "op3_warc": warc.op3_warc,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_quote_linking": quotes.op6_quote_linking,
    "op7_spaced_seeds": decontam.op7_spaced_seeds,
    "op8_minhash": minhash.op8_minhash,
    "op9_token_frames": frames.op9_token_frames,
    "op10_line_rules": lines.op10_line_rules,
    "op11_block_field": extract.op11_block_field,
    "op12_structure_repair": repair.op12_structure_repair,
    "op13_max_sketch_search": search.op13_max_sketch_search,
}
SQL = {
    "op1_substring_dedup": substring.SQL,
    "op3_warc": warc.SQL,
    "op4_suffix_dedup": suffix_dedup.SQL,
    "op6_quote_linking": quotes.SQL,
    "op7_spaced_seeds": decontam.SQL,
    "op8_minhash": minhash.SQL,
    "op10_line_rules": lines.SQL,
    "op11_block_field": extract.SQL,
    "op12_structure_repair": repair.SQL,
    "op13_max_sketch_search": search.SQL,
}
