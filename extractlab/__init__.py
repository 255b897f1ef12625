"""Extraction-quality analytics on Spark."""
