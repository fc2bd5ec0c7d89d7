"""Small files in a folder of any filesystem that Spark opens."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder.rstrip("/")
        self._jvm = spark._jvm
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def at(self, name: str):
        return self._path(f"{self.folder}/{name}")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.at(name))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.at(name))) if self.exists(name) else []

    def delete(self, name: str) -> None:
        self._fs.delete(self.at(name), True)

    def put(self, name: str, text: str) -> None:
        """Replace a file. The new one is whole under a temporary name before the old one goes, and get() finds it there."""
        folder, _, last = name.rpartition("/")
        temporary = f"{folder}/_{last}.tmp".lstrip("/")
        out = self._fs.create(self.at(temporary), True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.delete(self.at(name), False)
        if not self._fs.rename(self.at(temporary), self.at(name)):
            raise OSError(f"cannot write {self.folder}/{name}")

    def get(self, name: str) -> str | None:
        folder, _, last = name.rpartition("/")
        for n in (name, f"{folder}/_{last}.tmp".lstrip("/")):
            if self.exists(n):
                stream = self._fs.open(self.at(n))
                try:
                    return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                finally:
                    stream.close()
        return None

    def put_json(self, name: str, value) -> None:
        self.put(name, json.dumps(value))

    def get_json(self, name: str, default):
        text = self.get(name)
        return json.loads(text) if text is not None else default
