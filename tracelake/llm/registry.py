"""Queries of this subpackage: one for each operator, over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from tracelake.llm import bpe, fingerprints, licenses, line_dedup, mixing, ngram_join, quality, secrets, spelling, token_counts, turn_trie, url_filter, warc
from tracelake.llm.oracles import ORACLES  # noqa: F401
from tracelake.sources.tables import table

VOCABULARY, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"


def _tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def _pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECES)


QUERIES = {
    "op1_document_fingerprints": lambda spark, d: fingerprints.fingerprint(table(spark, d, "documents")),
    "op2_secret_scans": lambda spark, d: secrets.scan_documents(table(spark, d, "documents")),
    "op3_ngram_jaccard_join": lambda spark, d: ngram_join.jaccard_components(table(spark, d, "documents")),
    "op4_warc": lambda spark, d: warc.archive_and_read(table(spark, d, "pages")),
    "op5_quality_rules": lambda spark, d: quality.judge(table(spark, d, "documents"), table(spark, d, "labels")),
    "op6_byte_bpe": lambda spark, d: bpe.round_trip(table(spark, d, "documents"), *_tokenizer()),
    "op7_line_dedup": lambda spark, d: line_dedup.line_report(table(spark, d, "documents")),
    "op8_source_mixing": lambda spark, d: mixing.select_rows(table(spark, d, "documents")),
    "op9_license_scans": lambda spark, d: licenses.scan(table(spark, d, "documents")),
    "op10_url_filters": lambda spark, d: url_filter.filter_urls(table(spark, d, "pages")),
    "op11_spelling_variants": lambda spark, d: spelling.variants(spelling.vocabulary(table(spark, d, "documents"))),
    "op12_token_counts": lambda spark, d: token_counts.token_counts(table(spark, d, "documents"), _pieces()),
    "op13_prefix_trie": lambda spark, d: turn_trie.rebuilt_trie(table(spark, d, "conversations")),
}
