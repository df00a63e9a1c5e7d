"""Registered query plans: ``queries()`` callables and their DuckDB oracle SQL."""
