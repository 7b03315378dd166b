"""The registered queries of these operators and their SQL, by module."""

from tidewatch.llm import decontaminate, exact_dedup, fingerprints, kneser_ney, line_dedup, merkle, mixing, order_minhash, secret_scan, suffix_dedup, token_counts, trie, warc

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.query,
    "op2_secret_scan": secret_scan.query,
    "op3_line_dedup": line_dedup.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_decontaminate": decontaminate.query,
    "op6_order_minhash": order_minhash.query,
    "op7_warc": warc.query,
    "op8_mixing": mixing.query,
    "op9_token_counts": token_counts.query,
    "op10_quality": kneser_ney.query,
    "op11_prefix_trie": trie.query,
    "op12_fingerprints": fingerprints.query,
    "op13_merkle": merkle.query,
}
ORACLE_SQL = {
    "op2_secret_scan": secret_scan.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op11_prefix_trie": trie.SQL,
    "op13_merkle": merkle.SQL,
}
