"""The registered queries of this subpackage, one for each operator."""

from __future__ import annotations

from . import decontaminate, exact_dedup, jaccard_join, language_id, line_dedup, packing, secrets, suffix_dedup, token_counts, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_packing": packing.op6_packing,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_language_id": language_id.op8_language_id,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_warc": warc.op10_warc,
    # Operator 8 once more, with all its evidence: documents have neither markup nor address.
    "language_id_pages": language_id.language_id_pages,
}

#: DuckDB statements for the operators that SQL can express.
ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op2_suffix_dedup": suffix_dedup.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op9_jaccard_join": jaccard_join.ORACLE,
    "op10_warc": warc.ORACLE,
}
