"""Operators for preparing training data.  Nothing outside this folder imports it.

``QUERIES`` maps a name to a function (spark, folder) -> DataFrame, ``SQL`` the
names that can be said in SQL to the statement.
"""

from importlib import import_module

from fieldloom.llm.common import QUERIES, SQL

MODULES = ("bpe", "warc", "sharding", "mixing", "fingerprint", "ngram_join", "url_filter", "embedding_dedup", "language", "pii", "importance", "vector_codes", "toxicity")

for _name in MODULES:
    import_module(f"fieldloom.llm.{_name}")

__all__ = ["QUERIES", "SQL"]
