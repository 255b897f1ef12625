"""Stateful stream processing."""
