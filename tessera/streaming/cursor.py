"""Pulling a finite result: partition by partition, so the client holds about one at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Row

from tessera.operators.query import Query


def stream(query: Query, *, prefetch: bool = False) -> Iterator[Row]:
    """The rows in order, one after the other."""
    return query.df.toLocalIterator(prefetchPartitions=prefetch)


def stream_map(query: Query, f: Callable[[Row], Any], *, prefetch: bool = False) -> Iterator[Any]:
    return (f(r) for r in stream(query, prefetch=prefetch))


def chunks(query: Query, size: int) -> Iterator[list[Row]]:
    """The rows in lists of ``size``."""
    held: list[Row] = []
    for row in stream(query):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
