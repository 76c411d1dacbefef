"""Small objects under one root, on any file system that Spark's own connectors reach, and a text that is fetched once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession


class Store:
    """Bytes by name under a root; names are relative paths."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def uri(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def put(self, name: str, data: bytes) -> str:
        """Write data under name, whatever stood there, and return where it is."""
        out = self.fs.create(self._path(name), True)
        try:
            out.write(data)
        finally:
            out.close()
        return self.uri(name)

    def get(self, name: str) -> bytes:
        source = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(source))
        finally:
            source.close()

    def upload(self, local: str, name: str) -> str:
        """Copy a local file of the driver's under name."""
        self.fs.copyFromLocalFile(self.jvm.org.apache.hadoop.fs.Path(f"file://{local}"), self._path(name))
        return self.uri(name)

    def names(self, prefix: str = "") -> list[str]:
        """The names below a folder, sorted."""
        if not self.exists(prefix):
            return []
        found, files = [], self.fs.listFiles(self._path(prefix), True)
        base = self.fs.makeQualified(self._path("")).toString().rstrip("/") + "/"
        while files.hasNext():
            found.append(files.next().getPath().toString().removeprefix(base))
        return sorted(found)


def fetched_once(store: Store, name: str, fetch: Callable[[], str]) -> str:
    """The text stored under name; where there is none, what fetch gives, which is then stored."""
    if not store.exists(name):
        store.put(name, fetch().encode())
    return store.get(name).decode()
