"""Continuous builds: a stream of files parsed as they arrive."""
