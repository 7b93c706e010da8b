"""Versioned tables: a new version is written beside the old, checked, and then published by one small pointer file."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession


#: Earlier versions that a manifest names, the last one first.
HISTORY = 10


class NotPublished(RuntimeError):
    """The new version failed its checks; the old one stays."""


class Store:
    """Named tables under one root of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/CURRENT")
        return jvm, path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> dict | None:
        """The manifest of the published version."""
        _, path, fs = self._fs()
        if not fs.exists(path):
            return None
        text = self.spark.read.text(f"{self.root}/CURRENT", wholetext=True).first()
        return json.loads(text.value.lstrip("﻿"))

    def read(self, name: str) -> DataFrame:
        manifest = self.current()
        if not manifest or manifest["status"] != "READY":
            raise NotPublished("no READY version")
        return self.spark.read.parquet(f"{self.root}/{manifest['version']}/{name}")

    def publish(
        self,
        tables: Mapping[str, DataFrame],
        checks: Mapping[str, Callable[[Mapping[str, DataFrame]], DataFrame]] | None = None,
    ) -> dict:
        """Write all tables as a new version; publish it if no check returns a row.

        Read back, counted and checked before the pointer moves, so that readers see the old version or
        the new one, never a mix. A version that fails stays unpublished.
        """
        version = f"v-{datetime.now(UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{version}/{name}")
        back = {name: self.spark.read.parquet(f"{self.root}/{version}/{name}") for name in tables}
        failed = [name for name, check in (checks or {}).items() if check(back).limit(1).count()]
        if failed:
            raise NotPublished(f"{version} failed: {', '.join(sorted(failed))}")
        before = self.current()
        manifest = {
            "status": "READY",
            "version": version,
            "previous": before["version"] if before else None,
            "record_counts": {name: df.count() for name, df in back.items()},
            "history": [{k: before[k] for k in ("version", "record_counts")}, *before["history"]][:HISTORY] if before else [],
        }
        self._point(manifest)
        return manifest

    def rollback(self) -> dict:
        """Publish the version before the current one again, with its counts and what came before it."""
        now = self.current()
        if not now or not now.get("previous"):
            raise NotPublished("no earlier version")
        first, *rest = now["history"]
        manifest = {"status": "READY", **first, "previous": rest[0]["version"] if rest else None, "history": rest}
        back = {name: self.spark.read.parquet(f"{self.root}/{manifest['version']}/{name}").count() for name in manifest["record_counts"]}
        if back != manifest["record_counts"]:
            raise NotPublished(f"{manifest['version']} is not what was published: {back}")
        self._point(manifest)
        return manifest

    def _point(self, manifest: dict) -> None:
        jvm, path, fs = self._fs()
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.root}/CURRENT.{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        # one step, so that a failure leaves the old pointer
        option = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(option, 1)
        how[0] = option.OVERWRITE
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf).rename(draft, path, how)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows without those whose key is in `new`, and `new`."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)

