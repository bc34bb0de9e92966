"""Relational operators: joins, aggregates and row transforms."""

from .aggregate import Agg, aggregate, group_aggregate, scalar_aggregate
from .join import JOIN_TYPES, hash_join
from .transform import append, batches_of, identity, map_batches, materialize, polynomial, project, recursive_series, repeat_rows, sort_rows

__all__ = ["JOIN_TYPES", "Agg", "aggregate", "append", "batches_of", "group_aggregate", "hash_join", "identity", "map_batches", "materialize", "polynomial", "project", "recursive_series", "repeat_rows", "scalar_aggregate", "sort_rows"]
