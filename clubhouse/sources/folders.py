"""Files and folders by Hadoop's own calls, on whatever store holds the tables."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """A folder that Spark reads and writes, local or remote."""

    def __init__(self, spark: SparkSession, path: str):
        self._context = spark.sparkContext
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        given = self._hadoop.Path(path)
        self._system = given.getFileSystem(self._conf)
        self._path = self._system.makeQualified(given)

    @property
    def _hadoop(self):
        return self._context._jvm.org.apache.hadoop.fs

    @property
    def path(self) -> str:
        """The full address: two names of one folder give the same."""
        return self._path.toString()

    def _at(self, name: str):
        return self._hadoop.Path(self._path, name)

    def children(self, name: str) -> list[str]:
        """Names of the folders in a folder of this one, none if it is absent."""
        place = self._at(name)
        if not self._system.exists(place):
            return []
        return [s.getPath().getName() for s in self._system.listStatus(place) if s.isDirectory()]

    def delete(self, name: str) -> None:
        self._system.delete(self._at(name), True)

    def create(self, name: str, text: str) -> bool:
        """Create a file with all its content; False if there is one already.

        Of several at a time exactly one succeeds, and none is ever seen half
        written. Stores whose rename may replace a file do not give that:
        there, let one process at a time save.
        """
        target = self._at(name)
        draft = self._hadoop.Path(target.getParent(), f".{uuid.uuid4().hex}")
        out = self._system.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            return self._named(draft, target)
        finally:
            self._system.delete(draft, False)

    def _named(self, draft, target) -> bool:
        if self._system.getUri().getScheme() == "file":
            # Hadoop's local rename looks first and moves then; a link does both at once.
            try:
                os.link(draft.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            return True
        options = self._context._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            self._hadoop.FileContext.getFileContext(target.toUri(), self._conf).rename(draft, target, options)
        except Py4JJavaError as error:
            if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True
