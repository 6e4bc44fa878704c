"""Corpus, split, manifest and metric writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civitext.sources.readers import CSV_OPTIONS


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a corpus; like every sink here it replaces what is at ``path`` unless ``mode`` says otherwise."""
    df.write.mode(mode).options(**{k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"}).csv(path)


def write_splits(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write one folder per split, in files of the session's advisory partition size.

    Rows are gathered by split. There are three values, but adaptive execution cuts
    a large one into tasks of that size and joins small ones, so the number of
    files follows the bytes and not the tasks of the input, and no split
    passes through a single task.
    """
    df.hint("rebalance", "split").write.mode(mode).partitionBy("split").parquet(path)


def dataset_manifest(datasets: dict[str, DataFrame | None]) -> DataFrame | None:
    """``dataset, rows, columns`` for every dataset that holds rows."""
    manifest = None
    for name, df in datasets.items():
        if df is None:
            continue
        columns = F.array(*(F.lit(c) for c in df.columns))
        entry = (
            df.agg(F.count("*").alias("rows"))
            .filter(F.col("rows") > 0)
            .select(F.lit(name).alias("dataset"), "rows", columns.alias("columns"))
        )
        manifest = entry if manifest is None else manifest.unionByName(entry)
    return manifest


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a small report (manifest, metric record) as JSON lines."""
    df.write.mode(mode).json(path)
