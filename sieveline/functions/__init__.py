"""Scalar expressions over Columns, and the few parsers that need Python."""
