"""Registered queries: operators applied to the stand-in tables."""
