"""Helpers that shape plans: lineage cuts and distributed ranks."""
