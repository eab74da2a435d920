"""The queries of the training-data operators, and their SQL where SQL can express them."""

from rowkin.llm import exact_dedup, html_text, langid, packing, quality, secret_scan, simhash, substring_dedup, token_counts, tree_bpe

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_packing": packing.op2_packing,
    "op3_simhash": simhash.op3_simhash,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_quality": quality.op5_quality,
    "op6_html_text": html_text.op6_html_text,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_tree_bpe": tree_bpe.op8_tree_bpe,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

ORACLE_SQL = {
    "op5_quality": quality.SQL,
    "op7_secret_scan": secret_scan.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
}
