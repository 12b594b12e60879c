"""Column functions: positions and tag sets, all on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def position(version: Column | str = "commit_version", index: Column | str = "batch_index") -> Column:
    """The 12 bytes of a position."""
    return F.unhex(position_hex(version, index))


def position_hex(version: Column | str = "commit_version", index: Column | str = "batch_index") -> Column:
    """The position as 24 lower-case hex digits."""
    v, i = (F.col(x) if isinstance(x, str) else x for x in (version, index))
    return F.lower(F.concat(F.lpad(F.hex(v), 20, "0"), F.lpad(F.hex(i.cast("long")), 4, "0")))


def position_version(p: Column | str) -> Column:
    return F.conv(F.hex(F.substring(p, 1, 10)), 16, 10).cast("long")


def position_index(p: Column | str) -> Column:
    return F.conv(F.hex(F.substring(p, 11, 2)), 16, 10).cast("int")


def canonical_tags(tags: Column | str) -> Column:
    """Tags as a set: sorted, without repeats."""
    return F.array_sort(F.array_distinct(tags))


def tag_subsets(tags: Column | str) -> Column:
    """All subsets of the canonical tags, in the order of their bit masks."""
    t = canonical_tags(tags)
    masks = F.sequence(F.lit(0), (F.pow(F.lit(2), F.size(t)) - 1).cast("int"))
    return F.transform(masks, lambda m: F.filter(t, lambda _, i: F.call_function("shiftright", m, i).bitwiseAND(1) == 1))


def has_all(tags: Column, wanted: Column) -> Column:
    """Whether ``tags`` has all of ``wanted``; true if nothing is wanted."""
    return F.forall(wanted, lambda w: F.array_contains(tags, w))
