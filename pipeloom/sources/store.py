"""Small files on whatever file system the database lives in, through Hadoop's API."""

from __future__ import annotations

import io
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

from ..errors import Unsupported

#: Object stores: a rename there isn't one step, so two writers could both create one file.
OBJECT_STORES = ("s3", "s3a", "s3n", "gs", "wasb", "wasbs", "oss", "cos", "cosn", "obs", "swift")


def scratch(spark: SparkSession) -> str:
    """A new folder's name below the one that the session names in ``spark.checkpoint.dir``; on a local master a temporary one will do."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pipeloom-scratch-")
    return f"{found.rstrip('/')}/scratch-{uuid.uuid4().hex}"


class Stream(io.RawIOBase):
    """A file of any Hadoop file system as a binary stream."""

    def __init__(self, spark: SparkSession, path: str):
        file = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.stream = file.getFileSystem(spark._jsc.hadoopConfiguration()).open(file)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = bytes(self.stream.readNBytes(len(buffer)))
        buffer[: len(data)] = data
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self.stream.close()
        super().close()


def opened(spark: SparkSession, path: str) -> io.BufferedReader:
    return io.BufferedReader(Stream(spark, path), 1 << 20)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        if self.fs.getUri().getScheme() in OBJECT_STORES:
            raise Unsupported("a database needs a file system whose rename is one step; object stores have none")

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(self.at(name)))

    def names(self, directory: str) -> list[str]:
        path = self.path(self.at(directory))
        return sorted(f.getPath().getName() for f in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(self.at(name)))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file whole under a private name, then rename it; False if the name is taken."""
        private = self.path(self.at(f"{name}.{id(text):x}.tmp"))
        stream = self.fs.create(private, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        target = self.path(self.at(name))
        if self.fs.getUri().getScheme() == "file":  # a local rename would replace the target
            local = lambda p: self.fs.makeQualified(p).toUri().getPath()
            try:
                os.link(local(private), local(target))
            except FileExistsError:
                return False
            finally:
                self.fs.delete(private, False)
            return True
        if self.fs.exists(target) or not self.fs.rename(private, target):
            self.fs.delete(private, False)
            return False
        return True

    def age(self, name: str) -> float:
        """Seconds since a file was written, by the file system's own clock as far as it can be seen."""
        now = self.jvm.System.currentTimeMillis()
        return (now - self.fs.getFileStatus(self.path(self.at(name))).getModificationTime()) / 1000

    def make(self, directory: str) -> None:
        self.fs.mkdirs(self.path(self.at(directory)))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(self.at(name)), True)
