"""Relational operators: retrieval, statistics, graph, history, symbols, sync."""
