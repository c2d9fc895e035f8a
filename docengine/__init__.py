"""Document analytics on Spark: extraction, chunking, search, validation, reconciliation, catalogs."""
