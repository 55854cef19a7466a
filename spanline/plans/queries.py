"""All queries of the timeline operators, and their DuckDB SQL."""

from spanline.plans import entry_queries, io_queries, scalar_queries, segment_queries, seq_queries, table_queries

MODULES = [entry_queries, seq_queries, scalar_queries, table_queries, segment_queries, io_queries]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
