"""Composed plans: whole-store analysis, registered queries, test-table adapters."""
