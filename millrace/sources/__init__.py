"""Sources of the millrace analytics library."""
