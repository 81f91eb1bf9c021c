"""All named queries over the driver tables, each with the SQL that must give the same rows."""

from . import code_queries, engine_queries, graph_queries, language_queries, table_queries, text_queries

_MODULES = (code_queries, language_queries, engine_queries, graph_queries, table_queries, text_queries)
QUERIES = {name: q for module in _MODULES for name, q in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
