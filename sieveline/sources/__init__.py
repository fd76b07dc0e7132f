"""Scans, text extraction, chunking, pushes and exports."""
