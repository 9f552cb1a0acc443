"""Logical plans over the driver's tables."""
