"""Readers and writers: recordings, result documents, side tables."""
