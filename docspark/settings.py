"""Thresholds and limits, overridable from the environment; blank or malformed values keep the default."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    top_k: int = 5
    min_score: float = 0.35
    conf_high: float = 0.62
    conf_medium: float = 0.48
    grounding_min_overlap: float = 0.18
    source_priority_boost: float = 0.12
    author_boost: float = 2.5
    rrf_k: int = 60
    max_per_document: int = 2
    max_salient: int = 6
    chunk_size: int = 1200
    chunk_overlap: int = 150
    chunk_min: int = 200
    min_evidence_chars: int = 200
    quality_min: float = 0.5
    line_quality_min: float = 0.5
    max_context_chars: int = 12_000
    merge_cap: int = 4000
    embedding_dim: int = 384
    snapshots_kept: int = 5
    crawl_max_pages: int = 5000
    crawl_max_depth: int = 8

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        found = {}
        for f in fields(cls):
            raw = (env.get(f"DOCSPARK_{f.name.upper()}") or "").strip()
            try:
                found[f.name] = type(f.default)(raw) if raw else f.default
            except ValueError:
                found[f.name] = f.default
        return cls(**found)


DEFAULT = Settings()

# Priority and display name of each known source; any other has priority 1.
SOURCE_PRIORITY = {"commit_kb": 3, "staff_handbook": 2, "website": 2}
SOURCE_NAMES = {"commit_kb": "Commit KB", "staff_handbook": "Staff Handbook", "website": "Website"}
#: Token budgets of the three answer lengths.
LENGTH_BUDGETS = {"short": 600, "normal": 1300, "detailed": 2600}
