"""Numbered manifests: small JSON files of which each is created once or not at all, so that the newest one is what counts."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer made the next version first."""


class Manifests:
    """The manifests of a folder that driver and executors share; ``first`` is what holds before any is there."""

    def __init__(self, spark: SparkSession, folder: str, first: dict):
        self.spark, self.folder, self.first = spark, folder.rstrip("/"), {"version": 0, **first}
        self._fs = self.path("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def path(self, name: str):  # noqa: ANN201
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)

    def newest(self) -> dict:
        names = [s.getPath().getName() for s in self._fs.listStatus(self.path("manifests"))] if self.exists("manifests") else []
        found = sorted(n for n in names if n.endswith(".json"))
        return json.loads(self.spark.read.text(f"{self.folder}/manifests/{found[-1]}", wholetext=True).first()[0]) if found else self.first

    def commit(self, manifest: dict) -> None:
        try:
            out = self._fs.create(self.path(f"manifests/{manifest['version']:012d}.json"), False)
        except Exception as e:
            raise Conflict(f"version {manifest['version']} is there already") from e
        try:
            out.write(json.dumps(manifest, sort_keys=True).encode())
        finally:
            out.close()
