"""From a query to one boolean column.

Spark plans the scan, the sort and the limit; what is done here is what it can't know: that a query's items can be
simplified, that an OR of items implies a list of types (which Parquet can prune by, while it can't by tags), and
that a lower bound on positions is a bound on commit versions (which prunes whole commits).
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import Query, QueryItem, canonical_tags, unpack_position


def simplify(query: Query) -> Query:
    """The query with canonical items, less those that another one covers. It matches the same events."""
    items = list(dict.fromkeys(QueryItem(tuple(sorted(set(i.types))), canonical_tags(i.tags)) for i in query.items))

    def covers(b: QueryItem, a: QueryItem) -> bool:
        types = not b.types or (bool(a.types) and set(a.types) <= set(b.types))
        return types and set(b.tags) <= set(a.tags)

    return Query(tuple(a for a in items if not any(b != a and covers(b, a) for b in items)))


def item_column(item: QueryItem) -> Column:
    parts = [F.col("type_name").isin(*item.types)] if item.types else []
    parts += [F.array_contains("tags", t) for t in item.tags]
    return reduce(and_, parts)


def after_column(after: bytes) -> Column:
    """Strictly after a position, with a plain bound on the version for pruning."""
    version, index = unpack_position(after)
    if version >= 1 << 63:
        return F.lit(False)
    v = F.col("commit_version")
    return (v >= version) & ((v > version) | (F.col("batch_index") > index))


def match_column(query: Query, after: bytes | None = None) -> Column:
    """Whether an event matches. A query without items matches nothing."""
    q = simplify(query)
    if not q.items:
        return F.lit(False)
    out = reduce(or_, map(item_column, q.items))
    if len(q.items) > 1 and all(i.types for i in q.items):
        out = F.col("type_name").isin(*sorted({t for i in q.items for t in i.types})) & out
    return after_column(after) & out if after is not None else out
