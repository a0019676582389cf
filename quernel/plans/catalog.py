"""A catalog that outlives the process: one JSON file for each relation, function and query, in a folder that all share."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..model import Schema


class Catalog:
    """JSON objects by kind and name.  Without a folder it holds them in memory only."""

    def __init__(self, spark: SparkSession, folder: str | None):
        self.spark, self.folder = spark, folder.rstrip("/") if folder else None

    def at(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def put(self, kind: str, name: str, value: dict) -> None:
        """Written beside and then renamed, so that a reader never meets half of it."""
        if not self.folder:
            return
        system, path = self.at(kind, f"{name}.json")
        _, new = self.at(kind, f"_{name}.new")
        out = system.create(new, True)
        try:
            out.write(bytearray(json.dumps(value, default=str).encode()))
        finally:
            out.close()
        system.delete(path, False)
        system.rename(new, path)

    def drop(self, kind: str, name: str) -> None:
        if self.folder:
            system, path = self.at(kind, f"{name}.json")
            system.delete(path, False)

    def all(self, kind: str) -> dict[str, dict]:
        if not self.folder:
            return {}
        system, path = self.at(kind)
        if not system.exists(path):
            return {}
        out = {}
        for status in system.listStatus(path):
            name = status.getPath().getName()
            if name.endswith(".json") and not name.startswith("_"):
                stream = system.open(status.getPath())
                try:
                    out[name[:-5]] = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                finally:
                    stream.close()
        return out


def shown(about: dict) -> dict:
    """A relation's description as JSON."""
    return about | {"schema": {"columnTypes": about["schema"].types, "columnNames": about["schema"].names}}


def read(about: dict) -> dict:
    return about | {"schema": Schema.parse(about["schema"])}
