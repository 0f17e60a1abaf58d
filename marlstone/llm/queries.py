"""The queries of this subpackage by name, and their SQL where DuckDB can express them."""

from __future__ import annotations

from . import exact_dedup, language, lines, lm, media, mixing, packing, secret_scan, simhash, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_packing": packing.op2_packing,
    "op3_media_columns": media.op3_media_columns,
    "op4_language_id": language.op4_language_id,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_lm_scoring": lm.op6_lm_scoring,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_mixing": mixing.op10_mixing,
}
ORACLES = {"op1_exact_dedup": exact_dedup.OP1_SQL, "op7_line_dedup": lines.OP7_SQL}
