"""A pipeline has channels (a source and pipes each) that feed one sink; its rows are the channels' rows, all of them.

A pipe is a named function of a DataFrame. Pipes that emit unmatched rows of a shared side after their input has ended
(right and full joins) must see the rows of all their channels first: a pipe shared by several channels is therefore
applied once, to the union of what reaches it. Compiling gives an ordinary DataFrame, whose stages Spark derives.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame

from ..operators.join import hash_join
from .observer import Observer


@dataclass(frozen=True, eq=False)
class Pipe:
    """eq=False: two pipes are the same only if they are one object, which is what sharing means."""

    name: str
    apply: Callable[[DataFrame], DataFrame]
    late: bool = False  # emits rows after its input has ended


def map_pipe(name: str, function: Callable[[DataFrame], DataFrame]) -> Pipe:
    return Pipe(name, function)


def join_pipe(name: str, build: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], how: str, **options) -> Pipe:
    """Joins what comes along (the left side) with build."""
    return Pipe(name, lambda df: hash_join(df, build, left_keys, right_keys, how, **options), how in ("right_outer", "full_outer", "right_semi", "right_anti"))


@dataclass(frozen=True)
class Channel:
    name: str
    source: DataFrame
    pipes: Sequence[Pipe] = field(default_factory=tuple)


class Pipeline:
    def __init__(self, name: str, channels: Sequence[Channel], sink: Callable[[DataFrame], DataFrame] | None = None):
        if not channels:
            raise ValueError("a pipeline needs a channel")
        self.name, self.channels, self.sink = name, list(channels), sink
        orders = [[id(p) for p in c.pipes] for c in channels]
        if any(len(set(o)) < len(o) for o in orders):
            raise ValueError("a channel has the same pipe twice")

    def stages(self) -> list[list[str]]:
        """The names of the sources of each stage: the channels first, and one stage further for each late pipe on a
        channel. A shared pipe comes as late as the latest of its channels needs it."""
        level: dict[int, int] = {}
        named: dict[int, str] = {}
        changed = True
        while changed:
            changed = False
            for c in self.channels:
                at = 0
                for p in c.pipes:
                    if p.late:
                        at = max(at + 1, level.get(id(p), 0))
                        changed |= level.get(id(p)) != at
                        level[id(p)], named[id(p)] = at, p.name
        out = [[c.name for c in self.channels]]
        out += [[named[p] for p in level if level[p] == k] for k in range(1, max(level.values(), default=0) + 1)]
        return out

    def compile(self, observer: Observer | None = None) -> DataFrame:
        """The pipeline as a DataFrame. An observer counts the rows that leave every source, pipe and the sink."""
        seen = observer.watch if observer else lambda point, df: df
        waiting = [(seen(f"source {c.name}", c.source), list(c.pipes)) for c in self.channels]
        while any(pipes for _, pipes in waiting):
            ahead = {id(p) for _, pipes in waiting for p in pipes[1:]}
            ready = [pipes[0] for _, pipes in waiting if pipes and id(pipes[0]) not in ahead]
            if not ready:
                raise ValueError("channels pass shared pipes in conflicting orders")
            pipe = ready[0]
            mine = [(df, pipes) for df, pipes in waiting if pipes and pipes[0] is pipe]
            waiting = [w for w in waiting if not (w[1] and w[1][0] is pipe)]
            rests = {tuple(id(p) for p in pipes[1:]) for _, pipes in mine}
            if len(rests) == 1:  # one stream from here on
                waiting.append((seen(f"pipe {pipe.name}", pipe.apply(together([df for df, _ in mine]))), mine[0][1][1:]))
            elif pipe.late:
                raise ValueError(f"{pipe.name} emits rows of its own and its channels part behind it")
            else:
                waiting += [(seen(f"pipe {pipe.name}", pipe.apply(df)), pipes[1:]) for df, pipes in mine]
        out = together([df for df, _ in waiting])
        return seen("sink", self.sink(out) if self.sink else out)

    def explain(self) -> str:
        lines = [f"Pipeline {self.name}"]
        lines += [f"  channel {c.name}: " + " -> ".join([c.name, *[p.name for p in c.pipes], "sink"]) for c in self.channels]
        lines += [f"  stage {i}: {', '.join(names)}" for i, names in enumerate(self.stages())]
        return "\n".join(lines)


def together(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
