"""Operators of the millrace analytics library."""
