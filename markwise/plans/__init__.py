"""Queries composed of operators over the driver's tables, with their SQL."""
