"""The registry of aggregate functions."""

from .aggregates import REGISTRY, expression, names

__all__ = ["REGISTRY", "expression", "names"]
