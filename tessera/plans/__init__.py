"""Declarative descriptions that compile to columns."""
