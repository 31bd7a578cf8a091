"""All runnable queries and the SQL that checks them."""

from quillstream.plans import catalog_queries, ingest_queries, page_queries, text_queries

MODULES = [catalog_queries, text_queries, page_queries, ingest_queries]

QUERIES: dict = {}
ORACLE: dict = {}
for _module in MODULES:
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
