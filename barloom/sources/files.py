"""Folders of a shared file system through Hadoop's classes: listing, and renames that succeed once."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, base: str):
        self.base, self._jvm, self._spark = base.rstrip("/"), spark.sparkContext._jvm, spark
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self.path("").getFileSystem(self._conf)

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def names(self, name: str = "") -> list[str]:
        place = self.path(name)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(place)) if self._fs.exists(place) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def size(self, name: str) -> int:
        """Bytes below; 0 if it is not there."""
        return self._fs.getContentSummary(self.path(name)).getLength() if self.exists(name) else 0

    def age(self, name: str) -> float:
        """Seconds since the last change."""
        return time.time() - self._fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def make(self, name: str) -> None:
        self._fs.mkdirs(self.path(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)

    def rename_once(self, name: str, to: str) -> bool:
        """Whether ``name`` became ``to``; False, with ``name`` left, if that was there already."""
        if self.exists(to):
            return False
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(self.path(name), self.path(to), options)
        except Exception:
            if not self.exists(to):
                raise
            return False
        return True
