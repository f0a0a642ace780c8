"""The queries of this subpackage and their DuckDB SQL, for __spark_entry__.py."""

from __future__ import annotations

from corpusmith.llm import decontaminate, licenses, lines, variants, warc
from corpusmith.llm.alignment import op11_alignment
from corpusmith.llm.ann import op3_ann
from corpusmith.llm.bpe import op5_bpe
from corpusmith.llm.html import op4_html
from corpusmith.llm.minhash import op8_minhash
from corpusmith.llm.packing import op13_packing
from corpusmith.llm.suffixes import op7_suffix_array
from corpusmith.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": lines.op2_lines,
    "op3_approximate_nearest_neighbours": op3_ann,
    "op4_html_extraction": op4_html,
    "op5_byte_level_bpe": op5_bpe,
    "op6_license_scans": licenses.op6_licenses,
    "op7_suffix_array_dedup": op7_suffix_array,
    "op8_minhash_near_dedup": op8_minhash,
    "op9_benchmark_decontamination": decontaminate.op9_decontaminate,
    "op10_warc": warc.op10_warc,
    "op11_cross_tokenizer_alignment": op11_alignment,
    "op12_spelling_variants": variants.op12_variants,
    "op13_packing": op13_packing,
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": lines.SQL,
    "op6_license_scans": licenses.SQL,
    "op9_benchmark_decontamination": decontaminate.SQL,
    "op10_warc": warc.SQL,
    "op12_spelling_variants": variants.SQL,
}
