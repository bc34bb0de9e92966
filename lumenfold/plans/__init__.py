"""Pipelines of several channels with one sink, compiled to one DataFrame."""

from .observer import Observer
from .pipeline import Channel, Pipe, Pipeline, join_pipe, map_pipe

__all__ = ["Channel", "Observer", "Pipe", "Pipeline", "join_pipe", "map_pipe"]
