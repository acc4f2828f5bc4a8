"""Small files on whatever file system Spark reaches: read, list, publish once, delete; and a folder for scratch data."""

from __future__ import annotations

import os
import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession


class Files:
    """Hadoop's file systems from the driver, for files of a few megabytes at most."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.conf), where

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def names(self, folder: str) -> list[str]:
        fs, where = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def read(self, path: str) -> str:
        fs, where = self._at(path)
        stream = fs.open(where)
        try:
            return bytes(self.jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()

    def _write(self, path: str, text: str) -> None:
        fs, where = self._at(path)
        stream = fs.create(where, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> bool:
        """Make ``path`` with ``text`` as a whole; False, and nothing done, if it is there already.

        The text is written under another name first. A local file system gives
        it the name by a hard link, any other by a rename, which must not replace
        a file (HDFS's doesn't): of two writers exactly one succeeds.
        """
        fs, where = self._at(path)
        draft = f"{path}.{uuid4().hex}.draft"
        self._write(draft, text)
        try:
            if fs.getUri().getScheme() == "file":
                local = lambda p: self.jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority(self.jvm.org.apache.hadoop.fs.Path(p)).toString()
                try:
                    os.link(local(draft), local(path))
                    return True
                except FileExistsError:
                    return False
            return not fs.exists(where) and fs.rename(self._at(draft)[1], where)
        finally:
            self.delete(draft)

    def replace(self, path: str, text: str) -> None:
        """Put ``text`` in the place of ``path`` in one step: whoever reads it gets the old or the new text, never a part."""
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(path)[0].getUri(), self.conf)
        draft = f"{path}.{uuid4().hex}.draft"
        self._write(draft, text)
        flags = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        flags[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._at(draft)[1], self._at(path)[1], flags)

    def delete(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path that driver and executors share, below ``spark.checkpoint.dir``; only a local session without it gets a temporary folder."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not named and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{named or tempfile.mkdtemp(prefix='scratch-')}/{name}-{uuid4().hex}"
