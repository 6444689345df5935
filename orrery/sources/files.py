"""Small files and folders by the Hadoop file system API: a collection may lie on any file system that Spark reads."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Files:
    """A folder ``root`` and what lies in it; names are relative to it."""

    def __init__(self, spark: SparkSession, root: object):
        self.spark, self.root = spark, str(root).rstrip("/")
        self._jvm = spark.sparkContext._jvm  # noqa: SLF001
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001

    def _path(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def at(self, name: str) -> str:
        """The name as Spark takes it."""
        return f"{self.root}/{name}"

    def sub(self, name: str) -> Files:
        return Files(self.spark, self.at(name))

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def list(self, name: str = "") -> list[str]:
        """Names of what lies in a folder; a missing one is empty."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def read(self, name: str) -> Any:
        """The value of a JSON file."""
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, name: str, value: Any, new: bool = False) -> bool:
        """Puts a JSON file in its place by a rename, so that nobody reads half of it. ``new``: False if the name is taken."""
        tmp = f".{uuid.uuid4().hex}.tmp"
        stream = self._fs.create(self._path(tmp), True)
        try:
            stream.write(json.dumps(value).encode())
        finally:
            stream.close()
        if new and self.exists(name):
            self.remove(tmp)
            return False
        if not new:
            self.remove(name)
        done = self._fs.rename(self._path(tmp), self._path(name))
        if not done:
            self.remove(tmp)
        return done

    def remove(self, name: str = "") -> None:
        self._fs.delete(self._path(name), True)

    def rename(self, old: str, new: str) -> bool:
        return self._fs.rename(self._path(old), self._path(new))

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(name)).getLength() if self.exists(name) else 0

    def make(self) -> None:
        self._fs.mkdirs(self._path(""))


class Versions:
    """A JSON value that is replaced as a whole: ``NAME/NUMBER.json``, the largest number counts.

    A change is a new file that must not exist yet, so of two writers one fails and readers see the old value or the new one.
    """

    KEPT = 8

    def __init__(self, files: Files, name: str):
        self.files, self.name = files, name

    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.list(self.name) if n.endswith(".json") and n[:-5].isdigit())

    def exists(self) -> bool:
        return bool(self._numbers())

    def read(self) -> tuple[int, Any]:
        while True:
            numbers = self._numbers()
            try:
                return numbers[-1], self.files.read(f"{self.name}/{numbers[-1]:012d}.json")
            except Exception:  # a fast writer has dropped it meanwhile
                if self._numbers() == numbers:
                    raise

    def write(self, after: int, value: Any) -> bool:
        """Makes ``value`` the one after number ``after``; False if another writer was first."""
        folder = self.files.sub(self.name)
        folder.make()
        if not folder.write(f"{after + 1:012d}.json", value, new=True):
            return False
        for n in self._numbers()[: -self.KEPT]:
            folder.remove(f"{n:012d}.json")
        return True


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share; where it is unset in local mode, a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="orrery-store-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return f"file://{_own['dir']}"
