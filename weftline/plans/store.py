"""Files of a folder on any file system that Spark knows, and scratch folders that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from weftline.plans.shape import checkpoint_folder


class Folder:
    """A folder by its address; paths are relative to it."""

    def __init__(self, spark: SparkSession, address: str):
        self.spark, self.address = spark, address.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.address).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.address}/{name}"

    def names(self, name: str = "") -> list[str]:
        """Names in a folder; none if it does not exist."""
        path = self._path(self.at(name))
        return sorted(str(f.getPath().getName()) for f in self._files.listStatus(path)) if self._files.exists(path) else []

    def read(self, name: str) -> str:
        stream = self._files.open(self._path(self.at(name)))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """A small file, there as a whole or not at all."""
        part = self._path(self.at(f"{name}.{uuid.uuid4().hex}.tmp"))
        stream = self._files.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._files.delete(self._path(self.at(name)), False)
        self._files.rename(part, self._path(self.at(name)))

    def rename(self, name: str, to: str) -> None:
        self._files.rename(self._path(self.at(name)), self._path(self.at(to)))

    def delete(self, name: str) -> None:
        self._files.delete(self._path(self.at(name)), True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a state, beside the checkpoints that all executors share."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
