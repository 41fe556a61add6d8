"""Streaming of the millrace analytics library."""
