"""The queries of this subpackage by name, and the SQL that gives the same rows."""

from __future__ import annotations

from plumbline.llm import bpe, langid, mixing, ngram_join, packing, pii, prefix_trie, quality, secrets, suffix_dedup, vector_dedup, warc, whitening

_MODULES = (quality, secrets, pii, mixing, bpe, langid, warc, ngram_join, suffix_dedup, vector_dedup, prefix_trie, packing, whitening)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
