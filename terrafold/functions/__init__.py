"""Columns: coordinates, tags, measures, units and text forms."""
