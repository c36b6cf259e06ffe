"""Generalised LL recognition of source files."""
