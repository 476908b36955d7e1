"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import exact_dedup, language_id, line_dedup, media, packing, secret_scan, sentencepiece_scan, simhash, suffix_dedup, url_filter

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_sentencepiece": sentencepiece_scan.op3_sentencepiece,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_language_id": language_id.op5_language_id,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_media_columns": media.op8_media_columns,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_simhash": simhash.op10_simhash,
}
ORACLES = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op4_suffix_dedup": suffix_dedup.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op9_secret_scan": secret_scan.ORACLE,
}
