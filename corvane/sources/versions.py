"""Tables that are stored in versions and change together.

A version is a new folder with one Parquet table for each name. It is published by a small manifest that is written after
all of them, so readers see the newest version that is complete: a write that ends early leaves the old one in place, and
a reader that has opened a version keeps it. Everything goes through Spark's readers and writers.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class VersionedTables:
    spark: SparkSession
    root: str

    def _manifests(self) -> list[dict]:
        """Published manifests, the newest first; one small row a version."""
        try:
            rows = self.spark.read.option("recursiveFileLookup", "true").text(f"{self.root}/manifests").collect()
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error.getCondition()):
                raise
            return []
        return sorted((json.loads(r["value"]) for r in rows), key=lambda m: (m["version"], m["folder"]), reverse=True)

    def versions(self) -> list[int]:
        return [m["version"] for m in self._manifests()]

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        """All tables of the newest version, or of a given one; none before the first."""
        for manifest in self._manifests():
            if version in (None, manifest["version"]):
                return {name: self.spark.read.parquet(f"{self.root}/{manifest['folder']}/{name}") for name in manifest["tables"]}
        if version is not None:
            raise ValueError(f"no version {version} at {self.root}")
        return {}

    def write(self, tables: dict[str, DataFrame]) -> int:
        """Store a new version of all tables and publish it. The tables may read from older versions."""
        known = self.versions()
        version = known[0] + 1 if known else 1
        folder = f"tables/{version:08d}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{folder}/{name}")
        manifest = json.dumps({"version": version, "folder": folder, "tables": sorted(tables)})
        row = self.spark.createDataFrame([(manifest,)], "value string").coalesce(1)
        row.write.text(f"{self.root}/manifests/{folder.removeprefix('tables/')}")
        return version
