"""Declarative rules and expressions, compiled to columns."""
