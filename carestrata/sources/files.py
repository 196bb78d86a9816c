"""Small files and folders in the cluster's shared file system, through Hadoop's own client."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class SharedFiles:
    """Names, sizes, removal, and texts that appear whole and only once. Nothing here holds rows of a table."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        where, system = self._at(path)
        return system.exists(where)

    def names(self, folder: str) -> list[str]:
        """Sorted names in a folder; a missing folder has none."""
        where, system = self._at(folder)
        return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []

    def size(self, folder: str) -> int:
        """Bytes of all files below a folder."""
        where, system = self._at(folder)
        return system.getContentSummary(where).getLength() if system.exists(where) else 0

    def remove(self, folder: str) -> None:
        where, system = self._at(folder)
        system.delete(where, True)

    def read(self, path: str) -> str:
        where, system = self._at(path)
        stream = system.open(where)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, path: str, text: str) -> bool:
        """Write a text under a name that is free; False if someone else was first. Readers never see a part of it."""
        where, system = self._at(path)
        draft = self._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".draft-{uuid.uuid4().hex}")
        system.mkdirs(where.getParent())
        stream = system.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        none = self._jvm.java.lang.reflect.Array.newInstance(
            self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), self._conf)
        try:
            context.rename(draft, where, none)
            return True
        except Exception as error:
            system.delete(draft, False)
            if system.exists(where):
                return False
            raise error
