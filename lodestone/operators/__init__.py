"""Relational and analytical operators: ranked selection, facts, prices, retrieval, merge, matching."""
