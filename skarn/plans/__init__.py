"""Catalogs of signals, filters and presets, and their compilation to Columns."""
