"""The registered queries of this subpackage and their SQL."""

from laggard.llm import (bpe, fertility, html_extract, jaccard_join, license_scan, mixing, pii, prefix_trie, sharding, simhash, toxicity,
                         turn_repair, url_filter)

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_byte_bpe": bpe.query,
    "op3_toxicity": toxicity.query,
    "op4_pii_surrogates": pii.query,
    "op5_tokenizer_fertility": fertility.query,
    "op6_simhash": simhash.query,
    "op7_source_mixing": mixing.query,
    "op8_license_scan": license_scan.query,
    "op9_html_extraction": html_extract.query,
    "op10_ngram_jaccard": jaccard_join.query,
    "op11_prefix_trie": prefix_trie.query,
    "op12_turn_repair": turn_repair.query,
    "op13_feistel_shards": sharding.query,
}
ORACLES = {
    "op7_source_mixing": mixing.ORACLE,
    "op8_license_scan": license_scan.ORACLE,
    "op10_ngram_jaccard": jaccard_join.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_turn_repair": turn_repair.ORACLE,
    "op13_feistel_shards": sharding.ORACLE,
}
