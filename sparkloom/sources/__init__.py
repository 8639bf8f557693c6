"""Readers that produce catalog tables from files and repositories."""
