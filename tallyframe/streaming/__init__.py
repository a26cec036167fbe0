"""Structured Streaming: period points kept current as ledger files arrive."""
