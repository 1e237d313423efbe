"""Relational operators: filters, joins, set operations, windows, paging, mutation, quality."""
