"""Queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

import corpus_pipeline
from hakuspark.llm import embedding_dedup, lang_id, license_scan, minhash, packing, pieces, secret_scan, topk_search, url_filter, warc

_MODULES = (url_filter, license_scan, lang_id, packing, pieces, warc, secret_scan, topk_search, embedding_dedup, minhash)


def queries():
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
