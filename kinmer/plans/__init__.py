"""Queries over the standard tables: operators put together, each with the same query in SQL."""
