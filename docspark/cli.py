"""Command line: ``python -m docspark.cli ROOT update FILE | dedupe | validate | ask QUESTION | search QUESTION | status | runs | rollback | package TARGET | install SOURCE | refresh SOURCE``."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docspark.kb import Store
from docspark.operators import validate
from docspark.settings import Settings
from docspark.sources import jsonl, runs


def logged(store: Store, root: str, change: Callable[[], dict[str, Any]]) -> dict[str, Any]:
    """A change of the store by one run at a time, with a row in the log of runs."""
    with runs.Lock(store.spark, root) as held:
        if not held:
            return {"published": False, "reason": "another run holds the lock"}
        began = f"{datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%SZ}"
        out = change()
        known = {k: out[k] for k in ("added", "updated", "removed", "total", "version") if out.get(k) is not None}
        runs.record(store.spark, root, started_at=began, finished_at=f"{datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%SZ}", status="published" if out["published"] else "kept", message=out.get("reason"), **known)
        return out


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="docspark", description=__doc__)
    p.add_argument("root")
    sub = p.add_subparsers(dest="do", required=True)
    up = sub.add_parser("update", help="merge a JSON Lines file of documents and publish")
    up.add_argument("file")
    up.add_argument("--source", default="local")
    check = sub.add_parser("validate", help="check the current version")
    check.add_argument("--strict", action="store_true", help="warnings fail too")
    for name in ("ask", "search"):
        q = sub.add_parser(name)
        q.add_argument("question")
        q.add_argument("--source")
        q.add_argument("--length", default="normal", choices=["short", "normal", "detailed"])
    sub.add_parser("status")
    sub.add_parser("runs", help="the latest updates")
    sub.add_parser("dedupe", help="keep the richest document of each address and publish").add_argument("--dry-run", action="store_true", help="only count the others")
    for name, what in (("package", "copy the current version to a folder"), ("install", "take over a packaged version"), ("refresh", "take it over if it is newer")):
        sub.add_parser(name, help=what).add_argument("folder")
    back = sub.add_parser("rollback")
    back.add_argument("--version")
    a = p.parse_args(args)

    store = Store(spark or SparkSession.builder.getOrCreate(), a.root, Settings.from_env())
    where = (F.lower("source") == a.source.lower()) if getattr(a, "source", None) and a.do in ("ask", "search") else None
    code = 0
    if a.do == "update":
        docs = jsonl.normalize(jsonl.read_jsonl(store.spark, a.file), a.source)
        out = logged(store, a.root, lambda: store.update(docs.withColumn("updated_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))))
        code = int(not out["published"] and out["reason"] != "no changes")
    elif a.do == "dedupe":
        out = store.dedupe(dry_run=True) if a.dry_run else logged(store, a.root, store.dedupe)
    elif a.do == "runs":
        out = [r.asDict() for r in runs.history(store.spark, a.root).collect()]
    elif a.do in ("package", "install"):
        out = {"package": runs.package, "install": runs.install}[a.do](store.versions, a.folder)
    elif a.do == "refresh":
        out = {"installed": runs.refresh(store.versions, a.folder)}
    elif a.do == "validate":
        report = store.validate()
        verdict = validate.passed(report).first()
        out = {"ok": verdict.ok, "checks": [r.asDict() for r in report.collect()]}
        code = int(not verdict.ok or a.strict and verdict.warnings > 0)
    elif a.do == "ask":
        out = store.open().answer(a.question, a.length, where).first().asDict(recursive=True)
    elif a.do == "search":
        out = [r.asDict() for r in store.open().retrieve(a.question, 10, where).select("position", "title", "url", "rrf_score").dropDuplicates(["title", "url"]).orderBy("position").limit(8).collect()]
    elif a.do == "rollback":
        out = store.versions.rollback(a.version)
    else:
        out = store.status()
    print(json.dumps(out, ensure_ascii=False, default=str))
    return code


if __name__ == "__main__":
    sys.exit(main())
