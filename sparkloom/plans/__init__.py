"""Catalog, materialisation and the adapter over the test tables."""
