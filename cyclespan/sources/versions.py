"""Versions of a stored table: folders of Parquet that are never changed, and manifests that say which of them make a version.

A manifest is a small JSON file, `_versions/<number>`, written under another name and renamed when all its folders are complete: readers see either the version before or the new one, whole. A
run that stops leaves folders that no manifest names; the next commit removes them, and those of versions older than the one before. One writer at a time: of two that commit
the same number, one fails at the rename.
"""

from __future__ import annotations

import json
import re
import uuid
from typing import Any

from pyspark.sql import SparkSession

_FOLDER = "_versions"
#: Names of this module's folders; no others are ever removed.
_OWN = re.compile(r"[a-z]+-[0-9a-f]{16}")


class Versions:
    """The versions of the table at path, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._new = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._new(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p = self._new(path)
        return [f.getPath().getName() for f in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def numbers(self) -> list[int]:
        """Of all versions that can be read, ascending."""
        return sorted(int(n) for n in self._names(f"{self.path}/{_FOLDER}") if n.isdigit())

    def read(self, number: int | None = None) -> dict[str, Any] | None:
        """The manifest of a version, by default the last; none if there is no version yet."""
        if number is None:
            have = self.numbers()
            if not have:
                return None
            number = have[-1]
        stream = self._fs.open(self._new(f"{self.path}/{_FOLDER}/{number:012d}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def folder(self, kind: str) -> str:
        """The name of a folder that is new."""
        return f"{kind}-{uuid.uuid4().hex[:16]}"

    def at(self, folder: str) -> str:
        return f"{self.path}/{folder}"

    def commit(self, manifest: dict[str, Any]) -> int:
        """Make manifest, which names its folders in `folders`, the last version; its number."""
        number = (self.numbers() or [0])[-1] + 1
        draft = self._new(f"{self.path}/{_FOLDER}/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        target = self._new(f"{self.path}/{_FOLDER}/{number:012d}")
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {number} of {self.path} was committed by another run")
        self._clean(number)
        return number

    def _clean(self, last: int) -> None:
        """Remove manifests before the last but one, and folders that none of the rest names."""
        kept = set()
        for n in self.numbers():
            if n < last - 1:
                self._fs.delete(self._new(f"{self.path}/{_FOLDER}/{n:012d}"), False)
            else:
                kept |= set(self.read(n)["folders"])
        for name in self._names(self.path):
            if _OWN.fullmatch(name) and name not in kept:
                self._fs.delete(self._new(self.at(name)), True)
