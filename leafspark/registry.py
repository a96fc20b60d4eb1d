"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from leafspark.plans import argument_queries, edit_queries, layout_queries, measure_queries, name_queries, page_queries, rule_queries, structure_queries, text_queries

_MODULES = (page_queries, text_queries, layout_queries, rule_queries, measure_queries, structure_queries, edit_queries, name_queries, argument_queries)

QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.SQL.items()}
