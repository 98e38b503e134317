"""Operators for preparing training text: scans, filters, near-duplicate search and token counts."""
