"""All queries of the library and their SQL, by family."""

from __future__ import annotations


def families():
    from gleanery.plans import analytics_queries, audit_queries, entity_queries, evaluation_queries, graph_queries, ingest_queries, retrieval_queries, search_queries, source_queries, store_queries, stream_queries, text_queries, trust_queries, url_queries

    modules = (text_queries, url_queries, retrieval_queries, search_queries, graph_queries, trust_queries, ingest_queries, store_queries, evaluation_queries, audit_queries, analytics_queries, source_queries, stream_queries, entity_queries)
    return [m.FAMILY for m in modules]


def queries() -> dict:
    return {k: v for f in families() for k, v in f.queries.items()}


def oracle_sql() -> dict:
    return {k: v for f in families() for k, v in f.sql.items()}
