"""DataFrame operators for procurement documents, notices and product catalogs."""
