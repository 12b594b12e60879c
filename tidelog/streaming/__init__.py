"""The log as a stream: a Spark source whose offsets are commit versions, and consumers with named cursors."""

from .source import LogSource, stream
from .tail import catch_up, tail

__all__ = ["LogSource", "catch_up", "stream", "tail"]
