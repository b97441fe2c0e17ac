"""Catena: a PySpark engine for fragmented long-read sequence data and contact analytics."""
