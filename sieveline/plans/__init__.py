"""Whole requests: search, multi-project search, indexing, usage and evaluation reports."""
