"""Extraction over streams of pages."""
