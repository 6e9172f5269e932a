"""Small files and folders on any file system that Spark's Hadoop client knows."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Seconds after which a claim without its file is a dead writer's. Between the two lies one rename.
LEASE = 600.0


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(self._conf)
        #: How a file gets its name exactly once: by a link, by a rename that never replaces, or under a claim.
        self.naming = {"file": "link", "hdfs": "rename", "viewfs": "rename"}.get(self._fs.getUri().getScheme(), "claim")

    def at(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def is_file(self, path: str) -> bool:
        return self.exists(path) and self._fs.getFileStatus(self._path(path)).isFile()

    def names(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path)))

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def move(self, source: str, target: str) -> bool:
        return bool(self._fs.rename(self._path(source), self._path(target)))

    def copy(self, source: str, target: str) -> None:
        to = self._path(target)
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(
            self._fs, self._path(source), to.getFileSystem(self._conf), to, False, True, self._conf
        )

    def size(self, path: str) -> int:
        return int(self._fs.getContentSummary(self._path(path)).getLength()) if self.exists(path) else 0

    def read_text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def age(self, path: str) -> float:
        """Seconds since a file or folder, or anything directly in it, was last changed."""
        status = [self._fs.getFileStatus(self._path(path)), *self._fs.listStatus(self._path(path))]
        return time.time() - max(s.getModificationTime() for s in status) / 1000

    def create_text(self, path: str, text: str) -> bool:
        """The whole file or nothing under ``path``; False if it is there already, or another writer is at it.

        A writer that dies on the way leaves a draft, and a claim at the most,
        which the next writer breaks once ``LEASE`` is over.
        """
        draft = f"{path}.{uuid.uuid4().hex}.draft"
        stream = self._fs.create(self._path(draft), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            return not self.exists(path) and getattr(self, f"_name_by_{self.naming}")(draft, path)
        finally:
            self.delete(draft)

    def _name_by_link(self, draft: str, path: str) -> bool:
        """A local link is made at once, and not if the name is taken."""
        source, target = (self._jvm.java.io.File(self._path(p).toUri().getPath()).toPath() for p in (draft, path))
        try:
            self._jvm.java.nio.file.Files.createLink(target, source)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
                return False
            raise
        return True

    def _name_by_rename(self, draft: str, path: str) -> bool:
        return self.move(draft, path)

    def _name_by_claim(self, draft: str, path: str) -> bool:
        """Where a rename may replace: an exclusive create settles who does it."""
        claim = f"{path}.claim"
        if not self._claimed(claim):
            if not self.exists(claim) or self.age(claim) < LEASE:
                return False
            # Of several that find a dead writer's claim one moves it away.
            broken = f"{claim}.{uuid.uuid4().hex}.draft"
            if not self.move(claim, broken):
                return False
            self.delete(broken)
            if self.exists(path) or not self._claimed(claim):
                return False
        return self.move(draft, path)

    def _claimed(self, claim: str) -> bool:
        try:
            return bool(self._fs.createNewFile(self._path(claim)))
        except Py4JJavaError:
            if self.exists(claim):
                return False
            raise
