"""All registered queries of the relationship engine."""

from attesta.plans import compile_queries, graph_queries, relationship_queries

MODULES = (relationship_queries, graph_queries, compile_queries)
QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
