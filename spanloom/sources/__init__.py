"""Readers: driver tables and discovered recordings."""
