"""Consumers with a named cursor: at least once, in the order of positions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..model import Query, ReadOptions
from ..operators.reads import read
from ..plans import match_column
from ..sources.store import Store
from .source import stream


def catch_up(store: Store, name: str, query: Query, handle: Callable[[DataFrame], None], page: int = 10_000) -> int:
    """Handles what matches after the cursor, a page at a time, and moves the cursor after each; returns how many.

    The pages are of one snapshot, but for the last, which is of its own if something was appended meanwhile: only an
    end that was looked for after the page before it was handled counts."""
    n = 0
    while True:
        snapshot, ended = store.snapshot(), True
        for k, (rows, count, last) in enumerate(store.ended_pages(query, page, ReadOptions(after=store.get_cursor(name)), snapshot)):
            if ended := count < page:
                if k and store.version > snapshot.version:
                    ended = False
                    break
            handle(rows)
            store.set_cursor(name, last)
            n += count
        if ended or store.version == snapshot.version:
            return n


def tail(store: Store, query: Query, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """A streaming query that handles each micro-batch of matching events, sorted; Spark's checkpoint is its cursor."""
    matching = stream(store.spark, store.base).where(match_column(query))

    def batch(df: DataFrame, batch_id: int) -> None:
        handle(read(df, query), batch_id)

    writer = matching.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
