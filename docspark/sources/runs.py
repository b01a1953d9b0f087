"""Runs of the update: their log, a lock against two at once, and packages of a version for other machines."""

from __future__ import annotations

import json
import time
import uuid
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.sources.versions import Versions

RUN = "run_id string, started_at string, finished_at string, status string, version string, added long, updated long, removed long, total long, by_source map<string, string>, message string"
#: A lock that is older is of a run that has died.
STALE_SECONDS = 6 * 60 * 60


def record(spark: SparkSession, root: str, **fields: Any) -> str:
    """Append a run to the log; what isn't given is null."""
    run_id = fields.pop("run_id", None) or uuid.uuid4().hex[:12]
    names = [f.split(" ")[0] for f in RUN.replace(", string>", ",string>").split(", ")]
    unknown = set(fields) - set(names)
    if unknown:
        raise ValueError(f"unknown fields of a run: {sorted(unknown)}")
    spark.createDataFrame([tuple({**fields, "run_id": run_id}.get(n) for n in names)], RUN).coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/runs")
    return run_id


def record_all(rows: DataFrame, root: str) -> None:
    """Append a table of runs to the log; columns of RUN that ``rows`` hasn't are null, and a run without an id gets one of its other fields."""
    kinds = T.StructType.fromDDL(RUN)
    unknown = set(rows.columns) - set(kinds.names)
    if unknown:
        raise ValueError(f"unknown fields of a run: {sorted(unknown)}")
    own = rows if "run_id" in rows.columns else rows.withColumn("run_id", F.substring(F.sha2(F.to_json(F.struct(*rows.columns)), 256), 1, 12))
    own.select(*[(F.col(f.name) if f.name in own.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds.fields]).write.mode("append").parquet(f"{root.rstrip('/')}/runs")


def history(spark: SparkSession, root: str, most: int = 12) -> DataFrame:
    """The latest runs, the newest first."""
    return spark.read.schema(RUN).parquet(f"{root.rstrip('/')}/runs").orderBy(F.desc("started_at"), "run_id").limit(most)


class Lock:
    """A file that one run at a time holds; a stale one is taken over."""

    def __init__(self, spark: SparkSession, root: str, stale: float = STALE_SECONDS):
        self.files, self.stale = Versions(spark, root), stale

    def acquire(self) -> bool:
        fs, at = self.files._fs(), self.files._path("lock")
        if fs.exists(at):
            if time.time() - fs.getFileStatus(at).getModificationTime() / 1000 < self.stale:
                return False
            fs.delete(at, False)
        fs.mkdirs(at.getParent())
        try:
            out = fs.create(at, False)  # fails if another run was quicker
        except Exception:
            return False
        out.write(bytearray(json.dumps({"at": f"{datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%SZ}"}).encode()))
        out.close()
        return True

    def release(self) -> None:
        self.files._fs().delete(self.files._path("lock"), False)

    def __enter__(self) -> bool:
        self.held = self.acquire()
        return self.held

    def __exit__(self, *_: Any) -> None:
        if self.held:
            self.release()


def package(store: Versions, target: str) -> dict[str, Any]:
    """Copy the current version, all tables together, to a folder; the manifest is written last."""
    manifest = store.manifest()
    if manifest is None:
        raise ValueError("there is no version to package")
    out = Versions(store.spark, target)
    known = out.manifest()
    if known and known["version"] == manifest["version"]:
        return manifest
    for name in manifest["tables"]:
        store.table(name).write.mode("overwrite").parquet(f"{out.root}/versions/{manifest['version']}/{name}")
    manifest = {**manifest, "at": {name: manifest["version"] for name in manifest["tables"]}}
    out._write(json.dumps(manifest), "manifests", manifest["version"])
    out._write(manifest["version"], "current")
    return manifest


def install(store: Versions, source: str) -> dict[str, Any]:
    """Take over the version of a package. Counts are checked before it becomes current; if anything fails the old version stays."""
    manifest = Versions(store.spark, source).manifest()
    if manifest is None:
        raise ValueError(f"no package at {source}")
    origin = Versions(store.spark, source)
    if store.current() == manifest["version"]:
        return manifest
    try:
        for name in manifest["tables"]:
            path = f"{store.root}/versions/{manifest['version']}/{name}"
            origin.table(name).write.mode("overwrite").parquet(path)
            found = store.spark.read.parquet(path).count()
            if found != manifest["counts"][name]:
                raise ValueError(f"{name} has {found} rows, the manifest says {manifest['counts'][name]}")
    except Exception:
        store._fs().delete(store._path("versions", manifest["version"]), True)
        raise
    store._write(json.dumps(manifest), "manifests", manifest["version"])
    store.activate(manifest["version"])
    return manifest


def refresh(store: Versions, source: str) -> bool:
    """Install a package if it is newer than the current version (their names sort by time)."""
    manifest, now = Versions(store.spark, source).manifest(), store.current()
    if manifest is None or now is not None and manifest["version"] <= now:
        return False
    install(store, source)
    return True
