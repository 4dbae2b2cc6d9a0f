"""Versions of a stored index: numbered generations, committed atomically.

A build writes its tables to a folder of its own and then commits the next
generation: a small record ``versions/<number>`` that is put only if the
number is not taken yet.  A builder that finds it taken tries the next one, so
of several builders the later *commit* is the newest, whatever their clocks
say, and a build that fails before its commit is never seen.

Putting a record: it is written aside and then linked (local file systems) or
renamed without overwriting (HDFS and others of the kind); both are atomic and
fail where the target exists.  Object stores without such a rename need a
table format's commit service instead.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class _Folder:
    """A folder, through Hadoop's file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(self.conf)
        self.path = self.fs.makeQualified(self.path)

    def child(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path, name)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path)] if self.fs.exists(self.path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.child(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_if_absent(self, name: str, text: str) -> bool:
        """Create ``name`` with ``text``, whole, unless it exists."""
        aside, target = self.child(f".{name}-{uuid.uuid4().hex}"), self.child(name)
        out = self.fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self.path.toUri().getScheme() == "file":
                local = lambda p: self.jvm.java.nio.file.Paths.get(p.toUri())
                self.jvm.java.nio.file.Files.createLink(local(target), local(aside))
            else:
                files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path.toUri(), self.conf)
                none = self.jvm.java.lang.reflect.Array.newInstance(
                    self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
                files.rename(aside, target, none)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName() or self.fs.exists(target):
                return False
            raise
        finally:
            self.fs.delete(aside, False)


def generations(spark: SparkSession, path: str) -> list[int]:
    """Committed generations, ascending."""
    return sorted(int(n) for n in _Folder(spark, f"{path}/versions").names() if n.isdigit())


def record(spark: SparkSession, path: str, generation: int) -> dict:
    return json.loads(_Folder(spark, f"{path}/versions").read(str(generation)))


def commit(spark: SparkSession, path: str, entry: dict) -> int:
    """Commit ``entry`` as the next generation; returns its number."""
    folder = _Folder(spark, f"{path}/versions")
    n = max(generations(spark, path), default=0) + 1
    while not folder.put_if_absent(str(n), json.dumps(entry)):
        n = max([n, *generations(spark, path)]) + 1
    return n


def newest(spark: SparkSession, path: str) -> dict:
    taken = generations(spark, path)
    if not taken:
        raise FileNotFoundError(f"no committed index under {path}")
    return record(spark, path, taken[-1])


def expire(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Delete all but the newest ``keep`` generations (one at least) with
    their tables; returns their numbers.  A record goes before its tables, so
    no reader opens a generation that is being deleted; readers that opened it
    before need a ``keep`` that covers them.  Folders without a record may
    belong to a running build and are left alone."""
    gone = generations(spark, path)[: -max(1, keep)]
    versions, root = _Folder(spark, f"{path}/versions"), _Folder(spark, path)
    for n in gone:
        folder = record(spark, path, n)["folder"]
        versions.fs.delete(versions.child(str(n)), False)
        root.fs.delete(root.child(folder), True)
    return gone
