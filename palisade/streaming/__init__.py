"""Continuous conversion of a directory of documents."""
