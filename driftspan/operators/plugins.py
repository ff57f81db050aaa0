"""Detectors by name: any function from input tables to prediction tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from driftspan.operators.compare import diff_tables
from driftspan.sources.io import LABEL_TABLES, checkpointed

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Detector:
    name: str
    version: str
    variant: str
    run: Callable[[Tables], Tables]


DETECTORS: dict[str, Detector] = {}


def register_detector(name: str, run: Callable[[Tables], Tables], version: str = "1", variant: str = "") -> Detector:
    DETECTORS[name] = Detector(name, version, variant, run)
    return DETECTORS[name]


def run_detector(name: str, tables: Tables) -> Tables:
    """The detector's predictions; label tables are never within its reach."""
    return DETECTORS[name].run({k: v for k, v in tables.items() if k not in LABEL_TABLES})


def nondeterminism(name: str, tables: Tables, table: str, key: list[str]) -> DataFrame:
    """What two runs of a detector differ in: empty for a deterministic one."""
    a, b = (checkpointed(run_detector(name, tables)[table]) for _ in range(2))
    return diff_tables(a, b, key, [c for c in a.columns if c not in key])
