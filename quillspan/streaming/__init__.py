"""Streams of page updates into the store."""
