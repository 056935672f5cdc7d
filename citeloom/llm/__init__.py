"""Operators for preparing training text: counts, filters, archives, joins, scans, formatting, mixing and packing."""
