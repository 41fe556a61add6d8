"""Functions of the millrace analytics library."""
