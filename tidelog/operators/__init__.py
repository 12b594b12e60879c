"""Operators over a log frame ``(commit_version, batch_index, type_name, tags, data)``."""

from .conditions import conflicts, conflicts_indexed, exists
from .index import fetch, orphans, subset_index
from .reads import discover_types, pages, read, read_all

__all__ = ["conflicts", "conflicts_indexed", "discover_types", "exists", "fetch", "orphans", "pages", "read", "read_all", "subset_index"]
