"""Versioned publishing: all tables of a version together, the manifest last, rollback and retention.

``root/versions/<version>/<table>`` holds Parquet tables and ``root/manifests/<version>``
one JSON manifest; ``root/current`` names the active one and is replaced by one rename.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.settings import DEFAULT


def retained(versions: list[str], current: str | None, keep: int = DEFAULT.snapshots_kept) -> tuple[list[str], list[str]]:
    """Of some versions those that stay and those that go: the newest ``keep`` stay, and the current one."""
    newest = sorted(versions, reverse=True)
    stay = [v for i, v in enumerate(newest) if i < keep or v == current]
    return stay, [v for v in newest if v not in stay]


def retention(versions: DataFrame, current: str | None, keep: int = DEFAULT.snapshots_kept) -> DataFrame:
    """``version, kept``: the same for a table of versions (``version``), of which only the newest ``keep`` are sorted out."""
    newest = versions.select("version").orderBy(F.desc("version")).limit(keep).select("version", F.lit(True).alias("newest"))
    stays = F.coalesce("newest", F.lit(False)) | F.col("version").eqNullSafe(F.lit(current))
    return versions.select("version").join(F.broadcast(newest), "version", "left").select("version", stays.alias("kept"))


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self) -> Any:
        return self._path().getFileSystem(self.conf)

    def _write(self, text: str, *parts: str) -> None:
        """Write beside and rename over, so that a reader finds the old or the new text."""
        fs, to, beside = self._fs(), self._path(*parts), self._path(*parts[:-1], f".{parts[-1]}-{uuid.uuid4().hex}")
        out = fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.conf).rename(beside, to, options)

    def _read(self, *parts: str) -> str | None:
        fs, p = self._fs(), self._path(*parts)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text

    def stage(self, tables: dict[str, DataFrame], extra: dict[str, Any] | None = None) -> dict[str, Any]:
        """Write a new version without making it current. Tables of the current version that aren't given are taken over as they stand."""
        before = self.manifest() or {}
        at = {name: before.get("at", {}).get(name, before["version"]) for name in before.get("tables", [])}
        now = datetime.now(timezone.utc)
        version = f"{now:%Y%m%dT%H%M%S}{now.microsecond // 1000:03d}Z-{uuid.uuid4().hex[:8]}"
        counts = {name: n for name, n in before.get("counts", {}).items() if name in at}
        manifest = {"schema": 1, "version": version, "built_at": f"{now:%Y-%m-%dT%H:%M:%SZ}", "counts": counts, "hashes": {name: h for name, h in before.get("hashes", {}).items() if name in at}, "tables": sorted(at), "at": at, **(extra or {})}
        return self._filled(manifest, tables)

    def complete(self, version: str, tables: dict[str, DataFrame]) -> dict[str, Any]:
        """Write further tables into a version that isn't current yet."""
        return self._filled(self.manifest(version) or {"version": version}, tables)

    def forget(self, version: str, names: list[str], delete: bool = False) -> dict[str, Any]:
        """Leave tables out of a version that isn't current yet; versions that have them keep them. Its own go when it is pruned, or at once."""
        manifest = self.manifest(version) or {"version": version}
        own = [name for name in names if manifest.get("at", {}).get(name) == version]
        for part in ("counts", "hashes", "at"):
            for name in names:
                manifest.get(part, {}).pop(name, None)
        out = self._filled(manifest, {})
        for name in own if delete and version != self.current() else ():
            self._fs().delete(self._path("versions", version, name), True)
        return out

    def rename(self, version: str, name: str, to: str) -> dict[str, Any]:
        """Give a table of a version that isn't current yet another name, in place of the table that has it."""
        manifest = self.manifest(version) or {"version": version}
        if not self._fs().rename(self._path("versions", version, name), self._path("versions", version, to)):
            raise OSError(f"{name} of {version} can't be renamed")
        for part in ("counts", "hashes", "at"):
            manifest[part][to] = manifest[part].pop(name)
        return self._filled(manifest, {})

    def _filled(self, manifest: dict[str, Any], tables: dict[str, DataFrame]) -> dict[str, Any]:
        version = manifest["version"]
        for name, df in tables.items():
            path = f"{self.root}/versions/{version}/{name}"
            df.write.option("compression", "zstd").parquet(path)
            back = self.spark.read.parquet(path)
            own = [F.col(f"`{f.name}`") for f in back.schema.fields if not isinstance(f.dataType, T.MapType | T.VariantType)]
            # one pass: the rows' number, and a value that doesn't hang on their order
            row = back.agg(F.count(F.lit(1)).alias("n"), F.sum((F.xxhash64(*own) % 1_000_000_007) if own else F.lit(0)).alias("h")).first()
            manifest["counts"][name], manifest["hashes"][name], manifest["at"][name] = row.n, f"{row.h or 0:x}", version
        manifest["tables"] = sorted(manifest["at"])
        manifest["index_hash"] = hashlib.sha256(":".join(f"{t}={manifest['hashes'].get(t, '')}" for t in manifest["tables"]).encode()).hexdigest()[:24]
        self._write(json.dumps(manifest), "manifests", version)
        return manifest

    def activate(self, version: str) -> None:
        self._write(version, "current")
        self.prune()

    def discard(self, version: str) -> None:
        """Delete a version that isn't current."""
        if version != self.current():
            self._fs().delete(self._path("manifests", version), False)
            self._fs().delete(self._path("versions", version), True)

    def publish(self, tables: dict[str, DataFrame], extra: dict[str, Any] | None = None) -> dict[str, Any]:
        """Write a new version and make it current. A failure before the end leaves the old one active."""
        manifest = self.stage(tables, extra)
        self.activate(manifest["version"])
        return manifest

    def current(self) -> str | None:
        return self._read("current")

    def manifest(self, version: str | None = None) -> dict[str, Any] | None:
        version = version or self.current()
        raw = self._read("manifests", version) if version else None
        return json.loads(raw) if raw else None

    def list(self) -> list[str]:
        """Versions, the newest first (their names sort by time)."""
        fs, p = self._fs(), self._path("manifests")
        return sorted((s.getPath().getName() for s in fs.listStatus(p) if not s.getPath().getName().startswith(".")), reverse=True) if fs.exists(p) else []

    def table(self, name: str, version: str | None = None) -> DataFrame:
        """A table of the current (or a given) version; the manifest is read anew each time."""
        version = version or self.current()
        at = (self.manifest(version) or {}).get("at", {}).get(name, version)
        return self.spark.read.parquet(f"{self.root}/versions/{at}/{name}")

    def rollback(self, version: str | None = None) -> dict[str, Any]:
        """Make an older version current: the one given, or the newest before the current."""
        known, now = self.list(), self.current()
        older = [v for v in known if now is None or v < now]
        target = version or (older[0] if older else None)
        if target not in known:
            raise ValueError(f"no version to go back to: {target}")
        self._write(target, "current")
        return {**(self.manifest(target) or {}), "rolled_back_from": now}

    def prune(self, keep: int = DEFAULT.snapshots_kept) -> list[str]:
        """Delete all but the newest ``keep`` versions; the current one stays, and so do tables that a kept version has taken over."""
        known, now, fs = self.list(), self.current(), self._fs()
        stay, gone = retained(known, now, keep)
        used = {(at, name) for v in stay for name, at in (self.manifest(v) or {}).get("at", {}).items()}
        for v in gone:
            fs.delete(self._path("manifests", v), False)
        names = lambda *at: [s.getPath().getName() for s in fs.listStatus(self._path(*at))]
        # a folder behind the current version may be in the making
        for v in [v for v in names("versions") if now and v < now and v not in stay]:
            for name in names("versions", v):
                if (v, name) not in used:
                    fs.delete(self._path("versions", v, name), True)
            if not any(at == v for at, _ in used):
                fs.delete(self._path("versions", v), True)
        return gone
