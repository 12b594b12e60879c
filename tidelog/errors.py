"""What can go wrong, one class for each cause."""

from __future__ import annotations


class LogError(Exception):
    """Base of all errors of the event log."""

    retryable = False


class EmptyEvents(LogError):
    """An append without events."""


class AppendConditionFailed(LogError):
    """An event matches one of the conditions of the append."""


class InvalidQuery(LogError):
    """A query item with neither types nor tags, or a condition without items."""


class MissingEventType(LogError):
    """An event with an empty type."""


class BatchTooLarge(LogError):
    """More events in one append than positions can number."""


class TooManyTags(LogError):
    """An event with more tags than allowed, repeats included."""


class ReservedTag(LogError):
    """A tag that is reserved."""


class CommitContention(LogError):
    """Other writers took every version that was tried."""

    retryable = True


class EventNotFound(LogError):
    """An index row without an event; names the position."""


class CorruptRecord(LogError):
    """A stored value that can't be read back."""
