"""Folders on whatever file system the session reads (``file:``, ``hdfs:``, ``s3a:`` ...), by way of Hadoop's client."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """Names below ``root``; every step is one call of the file system, no local path is assumed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self._jvm = spark, spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        asked = self._path_of(root)
        self._fs = asked.getFileSystem(self._conf)
        self.root = self._fs.makeQualified(asked).toString().rstrip("/")
        self._fs.mkdirs(self._path_of(self.root))

    def _path_of(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *filter(None, parts)])

    def _at(self, *parts: str):
        return self._path_of(self.path(*parts))

    def exists(self, *parts: str) -> bool:
        return self._fs.exists(self._at(*parts))

    def names(self) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path_of(self.root)))

    def size(self, *parts: str) -> int:
        """Bytes of all files below a name."""
        return self._fs.getContentSummary(self._at(*parts)).getLength()

    def delete(self, *parts: str) -> None:
        self._fs.delete(self._at(*parts), True)

    def rename(self, old: str, new: str) -> None:
        if not self._fs.rename(self._at(old), self._at(new)):
            raise OSError(f"{self.path(old)} could not be renamed to {new}")

    def read_text(self, name: str) -> str:
        if not self.exists(name):
            raise FileNotFoundError(self.path(name))
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def replace_text(self, name: str, text: str) -> None:
        """Write beside the old file and rename over it in one step."""
        fresh = self._at(f".{name}.{uuid.uuid4().hex}")
        stream = self._fs.create(fresh, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.getFileSystem(self._conf).getUri(), self._conf).rename(fresh, self._at(name), options)
