"""Streaming of the analytics engine."""
