"""Configuration documents as lookups and dimension tables."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def load(path: str) -> dict:
    """A JSON document, or a YAML one where a YAML reader is installed."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise RuntimeError(f"{path}: no YAML reader is installed; convert it to JSON") from e
            return yaml.safe_load(f) or {}
        return json.load(f)


def get(config: Mapping, path: str, default: Any = None) -> Any:
    """The value at a dotted path."""
    here: Any = config
    for part in path.split("."):
        if not isinstance(here, Mapping) or part not in here:
            return default
        here = here[part]
    return here


def tickers(config: Mapping, category: str, at: str = "tickers") -> list[str]:
    """The tickers of a category; "todos" means those of all, each once, in order."""
    by = get(config, at, {})
    if category == "todos":
        return list(dict.fromkeys(t for c in by.values() for t in c))
    return list(by.get(category, []))


def ticker_dimension(spark: SparkSession, catalogue: Mapping[str, Mapping]) -> DataFrame:
    """(ticker, sigla, kind, name, name_en, aliases, timeline): timeline has who held office from when to when."""

    def day(x: Any) -> dt.date | None:
        return dt.date.fromisoformat(x) if isinstance(x, str) and x else x or None

    rows = []
    for ticker, c in catalogue.items():
        line = [(p["nome"], day(p.get("data_inicio")), day(p.get("data_fim"))) for p in c.get("ceo_timeline", [])]
        rows.append((ticker, c.get("sigla"), c.get("tipo"), c.get("nome_pt"), c.get("nome_en"), list(c.get("aliases", [])), line))
    return spark.createDataFrame(rows, "ticker string, sigla string, kind string, name string, name_en string, aliases array<string>, timeline array<struct<name: string, start: date, end: date>>")


def legacy_map(spark: SparkSession, mapping: Mapping[str, str]) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in mapping.items()], "legacy string, present string")


def event_calendar(spark: SparkSession, events: Sequence[Mapping], event_set: str) -> DataFrame:
    """(event_set, event_date, status) from configured events with a shock_start."""
    rows = [(event_set, dt.date.fromisoformat(str(e["shock_start"])), e.get("status", "configured")) for e in events]
    return spark.createDataFrame(rows, "event_set string, event_date date, status string")
