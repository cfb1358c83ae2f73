"""Limits of the read verbs, from session settings or a YAML file."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession

from .corpus import MARKER


@dataclass(frozen=True)
class Config:
    workers: int = 8  # kept for files of older tools; Spark schedules by itself
    max_line_width: int = 512
    direct_cap: int = 4096
    backlink_cap: int = 1024


_KEYS = {"workers": ("grep", "workers"), "max_line_width": ("grep", "maxLineWidth"), "direct_cap": ("subgraph", "directCap"), "backlink_cap": ("subgraph", "backlinkCap")}


def load(root: str) -> Config:
    """The limits kept with a graph; defaults for what isn't there."""
    import yaml

    path = os.path.join(root, MARKER, "config.yml")
    if not os.path.exists(path):
        return Config()
    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    found = {name: (data.get(a) or {}).get(b) for name, (a, b) in _KEYS.items()}
    return Config(**{k: v for k, v in found.items() if v})


def save(root: str, config: Config) -> None:
    import yaml

    data: dict = {}
    for name, value in asdict(config).items():
        a, b = _KEYS[name]
        data.setdefault(a, {})[b] = value
    with open(os.path.join(root, MARKER, "config.yml"), "w", encoding="utf-8") as f:
        yaml.safe_dump(data, f, sort_keys=True)


def from_session(spark: SparkSession) -> Config:
    """The limits in settings graphloom.<name>."""
    found = {name: spark.conf.get(f"graphloom.{name}", None) for name in _KEYS}
    return Config(**{k: int(v) for k, v in found.items() if v})
