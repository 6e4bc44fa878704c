"""Versioned models in a shared folder.

A store is a folder with one subfolder for each version and a table ``published``
of one row for each version that is complete. A version's files are written first and its
row last, by an append that Spark commits as a whole, so a save that fails on the
way leaves what was published before as it was. Readers take the row of the
highest number. Versions are never changed; ``overwrite`` retires older ones from
the list instead of deleting files that a reader may hold open.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "number long, version string, kind string, retired_before long, record string"
MODES = ("append", "error", "overwrite")


class ModelNotFound(FileNotFoundError):
    """There is no saved model at the given path."""


@dataclass(frozen=True)
class Version:
    """One published version: its number, folder and what was recorded with it."""

    number: int
    folder: str
    kind: str
    task: str
    config: dict[str, Any] = field(default_factory=dict)
    metrics: dict[str, float] = field(default_factory=dict)
    counts: dict[str, Any] = field(default_factory=dict)


def _published(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_SCHEMA).json(f"{path}/published")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def versions(spark: SparkSession, path: str) -> list[Version]:
    """The published versions, oldest first; one short row for each reaches the driver."""
    table = _published(spark, path)
    if table is None:
        return []
    rows = table.orderBy("number", "version").collect()
    retired = max((r.retired_before for r in rows), default=0)
    return [Version(r.number, f"{path}/versions/{r.version}", r.kind, **json.loads(r.record)) for r in rows if r.number >= retired]


def latest(spark: SparkSession, path: str, kind: str) -> Version:
    """The newest version; a missing store, or one of another kind of model, is an error with its path."""
    found = [v for v in versions(spark, path) if v.kind == kind]
    if not found:
        raise ModelNotFound(f"no model at {path}; train and save one first")
    return found[-1]


def publish(
    spark: SparkSession,
    path: str,
    kind: str,
    task: str,
    write: Callable[[str], None],
    config: Mapping[str, Any] | None = None,
    metrics: Mapping[str, float] | None = None,
    counts: Mapping[str, Any] | None = None,
    mode: str = "append",
) -> Version:
    """Write a version with ``write(folder)``, then publish it.

    ``append`` adds a version, ``error`` fails if there is one already, and
    ``overwrite`` retires those before it.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; expected one of {MODES}")
    known = versions(spark, path)
    if known and mode == "error":
        raise FileExistsError(f"there is a model at {path}")
    number = known[-1].number + 1 if known else 1
    name = f"{number:06d}-{uuid.uuid4().hex}"
    record = {"task": task, "config": dict(config or {}), "metrics": dict(metrics or {}), "counts": dict(counts or {})}
    write(f"{path}/versions/{name}")
    row = (number, name, kind, number if mode == "overwrite" else 0, json.dumps(record))
    spark.createDataFrame([row], _SCHEMA).coalesce(1).write.mode("append").json(f"{path}/published")
    return Version(number, f"{path}/versions/{name}", kind, **record)


def version_table(spark: SparkSession, path: str) -> DataFrame:
    """``number, kind, task, metric, value``: the metrics of all published versions."""
    rows = [(v.number, v.kind, v.task, name, float(value)) for v in versions(spark, path) for name, value in sorted(v.metrics.items())]
    return spark.createDataFrame(rows, "number long, kind string, task string, metric string, value double").orderBy("number", F.col("metric"))
