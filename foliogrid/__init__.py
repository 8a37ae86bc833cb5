"""Page-text analytics on Spark: catalogues, mask relations, gates, run ledgers and diagnostics as DataFrame operators."""
