"""Files of any store that Spark reaches, through Hadoop's file systems."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from tidelog.errors import AlreadyExistsError, NotFoundError


class Storage:
    """Put, get, list and delete whole files below one root."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def url(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def put_if_absent(self, name: str, data: bytes) -> None:
        """Create a file that must not be there; of several writers one succeeds, and no reader sees a part of it.

        The bytes are written aside and then named: by a link on a local disk, by
        a rename that does not replace elsewhere.  Both are atomic but on object
        stores, where only one writer should be at work.
        """
        folder, _, last = name.rpartition("/")
        aside = f"{folder}/.{last}.{uuid.uuid4().hex}".lstrip("/")
        self.put(aside, data)
        try:
            if self._fs.getScheme() == "file":
                at, tmp = (self._jvm.java.io.File(self._path(n).toUri().getPath()).toPath() for n in (name, aside))
                self._jvm.java.nio.file.Files.createLink(at, tmp)
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
                    self._fs.getUri(), self._spark._jsc.hadoopConfiguration()
                )
                rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
                none = self._spark.sparkContext._gateway.new_array(rename, 0)
                context.rename(self._path(aside), self._path(name), none)
        except Exception as e:
            if self._fs.exists(self._path(name)):
                raise AlreadyExistsError(f"{name} is there already") from e
            raise
        finally:
            self.delete(aside)

    def put(self, name: str, data: bytes) -> None:
        out = self._fs.create(self._path(name), True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def put_whole(self, name: str, data: bytes) -> None:
        """As :meth:`put`, but no reader that lists the folder sees a part of the file."""
        folder, _, last = name.rpartition("/")
        aside = f"{folder}/.{last}.part"
        self.put(aside, data)
        if not self._fs.rename(self._path(aside), self._path(name)):
            raise AlreadyExistsError(f"{name} is there already")

    def get(self, name: str) -> bytes:
        if not self.exists(name):
            raise NotFoundError(name)
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def get_range(self, name: str, start: int, length: int) -> bytes:
        """A part of a file; only that part is read.  What lies beyond the end is left out."""
        if not self.exists(name):
            raise NotFoundError(name)
        n = min(length, self._fs.getFileStatus(self._path(name)).getLen() - start)
        if n <= 0:
            return b""
        stream = self._fs.open(self._path(name))
        try:
            stream.seek(start)
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(n)))
        finally:
            stream.close()

    def list(self, name: str = "") -> list[tuple[str, int]]:
        """(name below the root, bytes) of the files directly in a folder."""
        at = self._path(name)
        if not self._fs.exists(at):
            return []
        prefix = f"{name}/" if name else ""
        return sorted((prefix + s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(at) if s.isFile())

    def folders(self, name: str = "") -> list[str]:
        at = self._path(name)
        if not self._fs.exists(at):
            return []
        prefix = f"{name}/" if name else ""
        return sorted(prefix + s.getPath().getName() for s in self._fs.listStatus(at) if s.isDirectory())

    def modified_ms(self, name: str) -> int:
        return self._fs.getFileStatus(self._path(name)).getModificationTime()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def copy_to(self, name: str, other: Storage, to: str) -> None:
        """Copy one file, unless one of that name is there: data files never change."""
        if not other.exists(to):
            util = self._jvm.org.apache.hadoop.fs.FileUtil
            util.copy(self._fs, self._path(name), other._fs, other._path(to), False, self._spark._jsc.hadoopConfiguration())
