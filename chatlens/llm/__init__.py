"""Operators for preparing training data: scans, filters, duplicates, token counts and packing of document tables."""
