"""Events, queries and conditions, and the positions of events.

A position is 12 bytes: the commit version in the first 10 (big-endian), the index in the batch in the last 2.
Positions order events by commit, then by place in their batch, when compared as bytes.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .errors import BatchTooLarge, CorruptRecord, EmptyEvents, InvalidQuery, MissingEventType, ReservedTag, TooManyTags

#: The limits of the data model.
MAX_BATCH = 65_535
MAX_TAGS = 10
RESERVED_TAG = "_"
POSITION_BYTES = 12

EVENT = StructType([StructField("type_name", StringType(), False), StructField("tags", ArrayType(StringType(), False), False), StructField("data", BinaryType(), False)])
#: What the files of one commit hold; its version is in the name of its folder.
BATCH = StructType([StructField("batch_index", IntegerType(), False), *EVENT.fields])
#: A log as the operators take it.
LOG = StructType([StructField("commit_version", LongType(), False), *BATCH.fields])


def pack_position(version: int, index: int) -> bytes:
    return version.to_bytes(10, "big") + index.to_bytes(2, "big")


def unpack_position(position: bytes) -> tuple[int, int]:
    if not isinstance(position, (bytes, bytearray)):
        raise TypeError("a position is bytes")
    if len(position) != POSITION_BYTES:
        raise CorruptRecord(f"a position has {POSITION_BYTES} bytes, not {len(position)}")
    return int.from_bytes(position[:10], "big"), int.from_bytes(position[10:], "big")


def position_hex(position: bytes) -> str:
    return bytes(position).hex()


def canonical_tags(tags: Iterable[str]) -> tuple[str, ...]:
    """Tags as a set: in order, without repeats."""
    return tuple(sorted(set(tags)))


def tag_subsets(tags: Iterable[str]) -> list[tuple[str, ...]]:
    """All subsets of the canonical tags; the bits of a subset's number tell its members."""
    t = canonical_tags(tags)
    return [tuple(x for i, x in enumerate(t) if m >> i & 1) for m in range(1 << len(t))]


def _strings(values: Iterable[str], what: str) -> tuple[str, ...]:
    if isinstance(values, str):
        raise TypeError(f"{what} is a list of strings, not a string")
    out = tuple(values)
    if not all(isinstance(v, str) for v in out):
        raise TypeError(f"{what} holds strings only")
    return out


@dataclass(frozen=True)
class Event:
    type_name: str
    tags: tuple[str, ...] = ()
    data: bytes = b""

    def __post_init__(self) -> None:
        if not isinstance(self.type_name, str) or not isinstance(self.data, (bytes, bytearray)):
            raise TypeError("an event has a type (string) and data (bytes)")
        object.__setattr__(self, "tags", _strings(self.tags, "tags"))
        object.__setattr__(self, "data", bytes(self.data))


@dataclass(frozen=True)
class StoredEvent:
    event: Event
    position: bytes


@dataclass(frozen=True)
class QueryItem:
    """One of these types (any, if none) and all of these tags."""

    types: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "types", _strings(self.types, "types"))
        object.__setattr__(self, "tags", _strings(self.tags, "tags"))

    @property
    def empty(self) -> bool:
        return not self.types and not self.tags


@dataclass(frozen=True)
class Query:
    """Any of the items."""

    items: tuple[QueryItem, ...] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "items", tuple(self.items))
        if not all(isinstance(i, QueryItem) for i in self.items):
            raise TypeError("a query is made of QueryItem")

    @classmethod
    def of_types(cls, *types: str) -> Query:
        return cls((QueryItem(types),))

    @classmethod
    def of_tags(cls, *tags: str) -> Query:
        return cls((QueryItem((), tags),))

    def __or__(self, other: Query) -> Query:
        return Query(self.items + other.items)


@dataclass(frozen=True)
class AppendCondition:
    """Fails an append if an event after ``after`` (any, if None) matches the query."""

    query: Query
    after: bytes | None = None

    def __post_init__(self) -> None:
        if self.after is not None:
            unpack_position(self.after)


@dataclass(frozen=True)
class ReadOptions:
    """``limit`` 0 is none; ``after`` is exclusive, and a lower bound in either direction."""

    limit: int = 0
    after: bytes | None = None
    reverse: bool = False

    def __post_init__(self) -> None:
        if not isinstance(self.limit, int) or isinstance(self.limit, bool) or self.limit < 0:
            raise ValueError("limit is a number from 0")
        if self.after is not None:
            unpack_position(self.after)


@dataclass(frozen=True)
class Batch:
    """Events and conditions of one append, checked in a fixed order before anything is read or written."""

    events: tuple[Event, ...]
    conditions: tuple[AppendCondition, ...] = field(default=())

    def check(self) -> None:
        if not self.events:
            raise EmptyEvents("an append needs an event")
        if len(self.events) > MAX_BATCH:
            raise BatchTooLarge(f"{len(self.events)} events; at most {MAX_BATCH}")
        for e in self.events:
            if not e.type_name:
                raise MissingEventType("an event needs a type")
            if len(e.tags) > MAX_TAGS:
                raise TooManyTags(f"{len(e.tags)} tags; at most {MAX_TAGS}")
            if RESERVED_TAG in e.tags:
                raise ReservedTag(RESERVED_TAG)
        for c in self.conditions:
            if not c.query.items:
                raise InvalidQuery("a condition needs an item")
            for i in c.query.items:
                if i.empty:
                    raise InvalidQuery("an item needs a type or a tag")
                if RESERVED_TAG in i.tags:
                    raise ReservedTag(RESERVED_TAG)


def check_read(query: Query) -> None:
    """A query to read by may have no items (it matches nothing); reserved tags are looked for first."""
    if any(RESERVED_TAG in i.tags for i in query.items):
        raise ReservedTag(RESERVED_TAG)
    if any(i.empty for i in query.items):
        raise InvalidQuery("an item needs a type or a tag")
