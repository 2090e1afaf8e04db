"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
from varietas.llm import queries_filter, queries_layout, queries_models, queries_scan, queries_sketch, queries_vectors

_MODULES = [queries_scan, queries_filter, queries_layout, queries_models, queries_sketch, queries_vectors]


def queries():
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    sql = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
