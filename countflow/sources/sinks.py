"""Sinks: result tables, replayed data, diagnostics and evaluations."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countflow.sources import files


def wanted(save_output: list[str], kind: str) -> bool:
    """Writing is off in a local environment and for kinds that were not asked for."""
    return os.environ.get("APP_ENV", "local") != "local" and kind in save_output


def write(df: DataFrame, path: str, kind: str = "parquet", by: list[str] = ()) -> None:
    w = df.write.mode("overwrite")
    w = w.partitionBy(*by) if by else w
    w.option("header", True).csv(path) if kind == "csv" else w.format(kind).save(path)


def write_results(results: dict[str, DataFrame], root: str, keys: list[str] | None = None, kind: str = "csv") -> list[str]:
    """One table per result key (all, or the named ones); returns the paths."""
    out = []
    for key, df in results.items():
        if keys is None or key in keys:
            write(df, f"{root}/{key}", kind)
            out.append(f"{root}/{key}")
    return out


def whole_units(df: DataFrame) -> DataFrame:
    """Units whose id has no parts, or lies in a state whose counties are always split (fixed values 23 and 31)."""
    u = F.col("geographic_unit_fips")
    return df.filter(~F.contains(u, F.lit("_")) | u.startswith("23") | u.startswith("31"))


def write_current(df: DataFrame, root: str, kind: str = "csv") -> None:
    write(df, f"{root}/current", kind)
    write(whole_units(df), f"{root}/current_whole_units", kind)


def write_calibration(df: DataFrame, root: str, measure: str, aggregate: str, alpha: float, kind: str = "csv") -> None:
    tagged = df.withColumns({"measure": F.lit(measure), "aggregate": F.lit(aggregate), "alpha": F.lit(alpha)})
    write(tagged, f"{root}/calibration", kind, ["measure", "aggregate", "alpha"])


def write_json(spark: SparkSession, value, path: str) -> None:
    """A small value as JSON, on any file system."""
    files.write_text(spark, path, json.dumps(value, default=str))


def records(df: DataFrame, key: str) -> dict:
    """A small table as {key: {column: value}}; the row over all is under "all"."""
    return {"all" if r[key] is None else r[key]: {k: v for k, v in r.asDict().items() if k != key} for r in df.collect()}
