"""Where a log is kept."""

from .files import Files, HadoopFiles, LocalFiles, files_for, shared_folder
from .store import Snapshot, Store

__all__ = ["Files", "HadoopFiles", "LocalFiles", "Snapshot", "Store", "files_for", "shared_folder"]
