"""Relational and sequence operators over long tables (one row a measurement, event or document)."""
