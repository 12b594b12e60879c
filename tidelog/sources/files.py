"""The few file operations that commits need. The one that matters is ``publish``: move a folder to a name that
nothing has yet, or fail; of any number of writers at once, one succeeds."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from abc import ABC, abstractmethod

from pyspark.sql import SparkSession


class Files(ABC):
    @abstractmethod
    def names(self, path: str) -> list[str]:
        """What is in a folder; nothing, if it isn't there."""

    @abstractmethod
    def has(self, path: str) -> bool: ...

    @abstractmethod
    def publish(self, staged: str, target: str) -> bool:
        """Moves a folder that isn't empty to ``target``, if nothing is there."""

    @abstractmethod
    def read(self, path: str) -> bytes | None: ...

    @abstractmethod
    def write(self, path: str, data: bytes) -> None:
        """Replaces a file as a whole."""

    @abstractmethod
    def remove(self, path: str) -> None: ...

    @abstractmethod
    def age(self, path: str) -> float:
        """When it was last changed, in seconds of the epoch."""


class LocalFiles(Files):
    """POSIX: a rename onto a folder that isn't empty fails, and is atomic."""

    def names(self, path: str) -> list[str]:
        try:
            return os.listdir(path)
        except FileNotFoundError:
            return []

    def has(self, path: str) -> bool:
        return os.path.exists(path)

    def publish(self, staged: str, target: str) -> bool:
        os.makedirs(os.path.dirname(target), exist_ok=True)
        try:
            os.rename(staged, target)
        except OSError:
            if os.path.isdir(target):
                return False
            raise
        return True

    def read(self, path: str) -> bytes | None:
        try:
            with open(path, "rb") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def write(self, path: str, data: bytes) -> None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        temp = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(temp, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, path)

    def remove(self, path: str) -> None:
        shutil.rmtree(path, ignore_errors=True) if os.path.isdir(path) else os.path.exists(path) and os.remove(path)

    def age(self, path: str) -> float:
        return os.stat(path).st_mtime


class HadoopFiles(Files):
    """Any file system of Hadoop that renames folders atomically (HDFS does), through the driver's JVM."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark._jvm
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._gateway = spark.sparkContext._gateway

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        if not self._fs.exists(self._path(path)):
            return []
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(path))]

    def has(self, path: str) -> bool:
        return bool(self._fs.exists(self._path(path)))

    def publish(self, staged: str, target: str) -> bool:
        self._fs.mkdirs(self._path(target).getParent())
        none = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(self._path(staged), self._path(target), none)
        except Exception:
            if self._fs.exists(self._path(target)):
                return False
            raise
        return True

    def read(self, path: str) -> bytes | None:
        if not self._fs.exists(self._path(path)):
            return None
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def write(self, path: str, data: bytes) -> None:
        temp = f"{path}.{uuid.uuid4().hex}.tmp"
        stream = self._fs.create(self._path(temp), True)
        stream.write(bytearray(data))
        stream.close()
        overwrite = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self._context.rename(self._path(temp), self._path(path), overwrite)

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def age(self, path: str) -> float:
        return self._fs.getFileStatus(self._path(path)).getModificationTime() / 1000


def files_for(spark: SparkSession, root: str) -> Files:
    return HadoopFiles(spark, root) if "://" in root and not root.startswith("file://") else LocalFiles()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what ``spark.checkpoint.dir`` names. Only a local session without
    that setting, as in tests, gets one of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="shared-")
