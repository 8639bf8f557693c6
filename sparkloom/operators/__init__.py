"""DataFrame -> DataFrame operators over the catalog tables."""
