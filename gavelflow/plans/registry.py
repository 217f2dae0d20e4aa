"""All queries over the star schema, with their SQL."""

from __future__ import annotations

from gavelflow.plans import board_queries, deal_queries, export_queries, live_queries, lot_queries, market_queries, stream_queries, valuation_queries

MODULES = [valuation_queries, deal_queries, board_queries, lot_queries, stream_queries, market_queries, live_queries, export_queries]

QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
