"""Queries and SQL of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from . import bpe, chat, exact_dedup, langid, licenses, packing, pii, quality, repeats, shards, simhash, trie, whitening

MODULES = [chat, langid, quality, licenses, shards, packing, exact_dedup, bpe, pii, simhash, repeats, trie, whitening]


def queries() -> dict:
    import corpus_pipeline

    return {name: query for module in MODULES for name, query in module.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    import corpus_pipeline

    sql = {name: sql for module in MODULES for name, sql in module.SQL.items()}
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
