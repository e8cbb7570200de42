"""Files under one root of any file system that Spark can reach: put, get, copy, delete.

Defined cases: a name that would leave the root is an error; getting what is not there
gives null; deleting what is not there does nothing.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        """The full path of a name; it never leaves the root."""
        plain = posixpath.normpath("/" + name.lstrip("/"))
        if plain == "/" or ".." in name.split("/"):
            raise ValueError(f"not a name under the root: {name!r}")
        return self.root + plain

    def _p(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path(name))

    def put(self, name: str, data: bytes) -> None:
        out = self.fs.create(self._p(name), True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def get(self, name: str) -> bytes | None:
        if not self.fs.exists(self._p(name)):
            return None
        stream = self.fs.open(self._p(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def copy(self, name: str, to: str) -> None:
        conf = self.fs.getConf()
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self._p(name), self.fs, self._p(to), False, conf)

    def delete(self, name: str) -> None:
        """A file, or all that lies under a prefix."""
        self.fs.delete(self._p(name), True)

    def names(self, prefix: str) -> list[str]:
        if not self.fs.exists(self._p(prefix)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._p(prefix)))
