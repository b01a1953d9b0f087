"""Counts that are kept up under deltas: what changes is taken back and added, the rest isn't read.

A kept count is a table of deltas: for each group the sum of the signs of its rows, an old
row's image -1, a new one's +1. An update appends the groups that it touches; a count is the
sum over all deltas, and the deltas are folded into one when there are many. Distinct numbers
are counts of finer groups: a member is there as long as its own count is above 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.sources.versions import Versions

#: Deltas that are folded into one.
FOLD = 8


def images(existing: DataFrame, fresh: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Rows with ``sign``: -1 for what ``fresh`` rows replace and ``removed`` keys take away, +1 for the fresh rows that stay.

    ``fresh`` has distinct keys. Of ``existing`` only the rows of those keys are taken.
    """
    gone = removed.select(key).distinct()
    touched = fresh.select(key).unionByName(gone).distinct()
    old = existing.join(touched, key, "left_semi").withColumn("sign", F.lit(-1).cast("long"))
    new = fresh.select(*existing.columns).join(gone, key, "left_anti").withColumn("sign", F.lit(1).cast("long"))
    return old.unionByName(new)


class Kept:
    """Counts of rows by some columns, in a store of versions; null is a group like others."""

    def __init__(self, versions: Versions, name: str, by: list[str]):
        self.versions, self.name, self.by = versions, name, by

    def _names(self, version: str | None = None) -> list[str]:
        tables = (self.versions.manifest(version) or {}).get("tables", [])
        return sorted(t for t in tables if t.startswith(f"{self.name}-"))

    def _sum(self, rows: DataFrame, value: str) -> DataFrame:
        return rows.groupBy(*self.by).agg(F.sum(value).alias("n")).where("n <> 0")

    def apply(self, changes: DataFrame, staged: str | None = None) -> None:
        """Add the changes (``by`` columns and ``sign``) as a delta, to a staged version or as a new one."""
        own = staged or self.versions.stage({})["version"]
        names = self._names(own)
        number = int(names[-1].rsplit("-", 1)[1]) + 1 if names else 1
        self.versions.complete(own, {f"{self.name}-{number:08d}": self._sum(changes, "sign")})
        if len(names) >= FOLD:
            whole = self._sum(self.table(own), "n")
            self.versions.complete(own, {f"{self.name}-{number + 1:08d}": whole})
            self.versions.forget(own, [*names, f"{self.name}-{number:08d}"])
        if staged is None:
            self.versions.activate(own)

    def table(self, version: str | None = None) -> DataFrame:
        """All deltas as they stand."""
        return reduce(DataFrame.unionByName, [self.versions.table(t, version) for t in self._names(version)])

    def counts(self, by: list[str] | None = None) -> DataFrame:
        """``by, n, members``: rows of each group (of all columns, or fewer) and how many finer groups it has."""
        by = self.by if by is None else by
        whole = self._sum(self.table(), "n")
        return whole.groupBy(*by).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("members"))
