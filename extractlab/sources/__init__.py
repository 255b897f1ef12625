"""Readers, and stand-in fact tables built from the driver tables."""
