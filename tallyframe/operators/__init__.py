"""Ledger operators: DataFrame → DataFrame, lazy, optional grouping keys."""
