"""Spark jobs over saved pages, teaching notes and text corpora."""
