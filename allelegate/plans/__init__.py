"""Schemas, fixed values, session settings and skew helpers."""
