"""The document queries and their SQL."""

from __future__ import annotations

from marketspark.llm import contamination, html_text, licenses, line_dedup, mixing, near_duplicates, prefix_trie, quality, secrets, token_counts, toxicity, vector_codes, warc
from marketspark.llm.common import table


def _over(query, *names: str):
    return lambda spark, sf_dir: query(*(table(spark, sf_dir, name) for name in names))


QUERIES = {
    "op1_quality_rules": _over(quality.query, "documents", "labels"),
    "op2_mix_sources": _over(mixing.query, "documents"),
    "op3_html_text": _over(html_text.query, "pages"),
    "op4_warc_revisits": _over(warc.query, "pages"),
    "op5_line_dedup": _over(line_dedup.query, "documents"),
    "op6_secret_scan": _over(secrets.query, "documents"),
    "op7_ngram_jaccard": _over(near_duplicates.query, "documents"),
    "op7_ngram_links": _over(near_duplicates.linked_classes, "documents"),
    "op8_license_scan": _over(licenses.query, "documents"),
    "op9_decontaminate": _over(contamination.query, "documents", "benchmark"),
    "op10_toxicity": _over(toxicity.query, "documents", "labels"),
    "op11_token_counts": _over(token_counts.query, "documents"),
    "op12_prefix_trie": _over(prefix_trie.query, "conversations"),
    "op13_vector_codes": _over(vector_codes.query, "embeddings"),
}

# Forest, page parser, ledger, classifier and tokenizer have no SQL form.
ORACLES = {
    "op2_mix_sources": mixing.SQL,
    "op4_warc_revisits": warc.SQL,
    "op5_line_dedup": line_dedup.SQL,
    "op7_ngram_jaccard": near_duplicates.SQL,
    "op8_license_scan": licenses.SQL,
    "op9_decontaminate": contamination.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_vector_codes": vector_codes.SQL,
}
