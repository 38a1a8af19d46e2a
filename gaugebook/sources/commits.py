"""Commit files: created once, whole, by one of all writers that try."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

#: Hadoop's option and path capability of stores that create an object only if it is absent,
#: decided when the upload ends (fixed value).
CONDITIONAL = "fs.option.create.conditional.overwrite"
#: File systems whose rename is atomic and fails on an existing target.
RENAMES = frozenset({"hdfs"})


class UnsafeStore(Exception):
    """The file system has no way to create a file for one writer only."""


class CommitFiles:
    """The files of one folder. `create` is all or nothing: no reader ever sees a part of a
    file, and of several writers of one name exactly one succeeds.

    Local folders take a hard link to a finished file, HDFS the rename of one, object
    stores a conditional put. Others, where rename copies and create checks long before the
    upload ends, are refused: two writers could both believe that they had committed.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def _location(self, name: str = ""):
        """A path and its file system; behind a mount table, the one that is mounted."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.getScheme() != "viewfs":
            return path, fs
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs.mkdirs(folder)
        self.folder = fs.resolvePath(folder).toString()
        return self._location(name)

    def names(self) -> list[str]:
        path, fs = self._location()
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def text(self, name: str) -> str:
        path, fs = self._location(name)
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def way(self) -> str:
        """How files are created here; UnsafeStore if there is no safe way."""
        path, fs = self._location()
        scheme = fs.getScheme()
        if scheme == "file":
            return "link"
        if scheme in RENAMES:
            return "rename"
        if fs.hasPathCapability(path, CONDITIONAL):
            return "put"
        raise UnsafeStore(f"{scheme}: neither an atomic rename nor a conditional create; commits would not be safe")

    def create(self, name: str, text: str) -> bool:
        """Create a file; False if the name is taken. `text` must differ between writers."""
        return {"link": self._link, "rename": self._rename, "put": self._put}[self.way()](name, text)

    def _link(self, name: str, text: str) -> bool:
        folder = self._location()[0].toUri().getPath()
        os.makedirs(folder, exist_ok=True)
        whole = f"{folder}/.{name}.{uuid.uuid4().hex}"
        with open(whole, "x") as file:
            file.write(text)
            file.flush()
            os.fsync(file.fileno())
        try:
            os.link(whole, f"{folder}/{name}")
        except FileExistsError:
            return False
        finally:
            os.unlink(whole)
        return True

    def _rename(self, name: str, text: str) -> bool:
        path, fs = self._location(name)
        whole, _ = self._location(f".{name}.{uuid.uuid4().hex}")
        self._fill(fs.create(whole, False), text)
        if fs.rename(whole, path):
            return True
        fs.delete(whole, False)
        return False

    def _put(self, name: str, text: str) -> bool:
        path, fs = self._location(name)
        try:
            self._fill(fs.createFile(path).must(CONDITIONAL, True).build(), text)
        except Exception:
            # Refused, or the answer to a put that went through was lost: what is there decides.
            if name in self.names():
                return self.text(name) == text
            raise
        return True

    @staticmethod
    def _fill(stream, text: str) -> None:
        stream.write(bytearray(text.encode()))
        stream.close()
