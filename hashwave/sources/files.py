"""Small text files in a folder of the shared store, through the file systems that Spark is set up with."""

from __future__ import annotations

import threading
import uuid
from functools import lru_cache

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

# A local file system renames over what is there, so writers of one process take turns. Stores of a
# cluster refuse by themselves.
_LOCAL = threading.Lock()


@lru_cache(maxsize=1)
def _classes(jvm) -> tuple:
    """Looked up once, as each part of a name costs a search of the class path."""
    hadoop = jvm.org.apache.hadoop.fs
    return hadoop.Path, hadoop.FileContext, hadoop.Options.Rename, jvm.org.apache.commons.io.IOUtils


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        self._gateway = spark.sparkContext._gateway
        self._path_class, self._context, self._rename, self._io = _classes(spark.sparkContext._jvm)
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        self._files = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._path_class(f"{self.path}/{name}" if name else self.path)

    def names(self) -> dict[str, int]:
        """Names in the folder with the time of their last change, in milliseconds."""
        if not self._files.exists(self._at("")):
            return {}
        return {s.getPath().getName(): s.getModificationTime() for s in self._files.listStatus(self._at(""))}

    def read(self, name: str) -> str | None:
        if not self._files.exists(self._at(name)):
            return None
        stream = self._files.open(self._at(name))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Write a file that is seen whole or not at all; False if there is one of that name, which stays."""
        with _LOCAL:
            return not self._files.exists(self._at(name)) and self._move(text, name, "NONE")

    def replace(self, name: str, text: str) -> None:
        self._move(text, name, "OVERWRITE")

    def _move(self, text: str, name: str, how: str) -> bool:
        aside = self._at(f".{uuid.uuid4().hex}.tmp")
        out = self._files.create(aside, False)
        try:
            self._io.write(text, out, "UTF-8")
        finally:
            out.close()
        options = self._gateway.new_array(self._rename, 1)
        options[0] = getattr(self._rename, how)
        try:
            self._context.getFileContext(aside.toUri(), self._conf).rename(aside, self._at(name), options)
            return True
        except Py4JJavaError as error:
            self._files.delete(aside, False)
            if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False

    def delete(self, name: str) -> None:
        """Remove a file, or a folder with all that is in it."""
        self._files.delete(self._at(name), True)
