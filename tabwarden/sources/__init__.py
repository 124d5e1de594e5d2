"""Readers and writers: dictionaries, CSV trees, primary tables."""
