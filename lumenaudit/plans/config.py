"""Audit settings from YAML or a mapping: weights over the defaults, overrides, thresholds, crawl limits."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..operators.scoring import PILLAR_WEIGHTS
from ..sources.crawl import MAX_DEPTH, MAX_PAGES


@dataclass
class Settings:
    pillar_weights: dict[str, float] = field(default_factory=lambda: dict(PILLAR_WEIGHTS))
    criteria_overrides: dict[str, dict[str, float]] = field(default_factory=dict)
    thresholds: dict[str, dict[str, float]] = field(default_factory=dict)
    max_pages: int = MAX_PAGES
    max_depth: int = MAX_DEPTH

    def weights_of_rules(self) -> dict[str, float]:
        return {k: float(v["weight"]) for k, v in self.criteria_overrides.items() if "weight" in v}


def settings(data: dict | None) -> Settings:
    data, base = data or {}, Settings()
    crawl = data.get("crawl") or {}
    return Settings(base.pillar_weights | (data.get("pillar_weights") or {}), data.get("criteria_overrides") or {}, data.get("thresholds") or {}, int(crawl.get("max_pages", base.max_pages)), int(crawl.get("max_depth", base.max_depth)))


def load(path: str) -> Settings:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("settings from a file need PyYAML; pass a mapping to settings() instead") from e
    with open(path, encoding="utf-8") as f:
        return settings(yaml.safe_load(f))
