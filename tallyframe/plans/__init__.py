"""Plans: canonical ledger views over the driver tables, analysis bundles, queries."""
