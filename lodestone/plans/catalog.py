"""All queries of the relational part, by name, with their SQL where one exists."""

from __future__ import annotations

from lodestone.plans import answer_queries, document_queries, fact_queries, join_queries, line_queries, match_queries, merge_queries, price_queries, question_queries, retrieval_queries, source_queries, stream_queries, text_queries, time_queries
from lodestone.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

MODULES = (answer_queries, document_queries, fact_queries, join_queries, line_queries, match_queries, merge_queries, price_queries, question_queries, retrieval_queries, source_queries, stream_queries, text_queries, time_queries)
