"""Sources: baseline, current and versioned tables from files, frames and rows; config and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countflow.functions.common import bounded, repaired_id
from countflow.functions.nulls import clean
from countflow.operators.measures import add_baselines, add_results
from countflow.operators.units import without_results
from countflow.operators.versioned import between, thin

#: Ids keep leading zeros, so they are never inferred as numbers.
ID_COLUMNS = ("postal_code", "geographic_unit_fips", "geographic_unit_type", "county_fips", "county_classification", "district")
TIMES = ("last_modified", "received_at", "added_at", "removed_at")


def data_path(root: str, election_id: str, office: str, unit_type: str, kind: str = "csv") -> str:
    return f"{root}/{election_id}/{office}/data_{unit_type}.{kind}"


def config_path(root: str, election_id: str) -> str:
    return f"{root}/config/{election_id}.json"


def _schema(names: list[str]) -> T.StructType:
    kind = {**dict.fromkeys(ID_COLUMNS, T.StringType()), **dict.fromkeys(TIMES, T.TimestampType()), "election_id": T.StringType()}
    return T.StructType([T.StructField(n, kind.get(n, T.DoubleType())) for n in names])


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with a header: ids as strings, times as timestamps, everything else as doubles."""
    names = spark.read.option("header", True).csv(path).columns
    return clean(spark.read.option("header", True).option("mode", "FAILFAST").schema(_schema(names)).csv(path))


def read(spark: SparkSession, source: str | DataFrame | list) -> DataFrame:
    """A table from a path (parquet, orc, json or csv by its ending), a frame, or rows of which the first is the header."""
    if isinstance(source, DataFrame):
        return clean(source)
    if isinstance(source, list):
        names = list(source[0])
        schema = _schema(names)
        rows = [tuple(None if v is None else float(v) if isinstance(f.dataType, T.DoubleType) else str(v) if isinstance(f.dataType, T.StringType) else v for v, f in zip(row, schema.fields)) for row in source[1:]]
        return clean(spark.createDataFrame(rows, schema))
    end = source.rstrip("/").rsplit(".", 1)[-1]
    if end in ("parquet", "orc", "json"):
        return clean(getattr(spark.read, end)(source))
    return csv(spark, source)


def baseline(spark: SparkSession, source, states: list[str] = ()) -> DataFrame:
    """The baseline table; the filter on states reaches the scan."""
    b = read(spark, source)
    return b.filter(F.col("postal_code").isin(list(states))) if states else b


def current(spark: SparkSession, source) -> DataFrame:
    """Keys, results and percent of the current table."""
    c = read(spark, source)
    keep = [x for x in c.columns if x in ("postal_code", "geographic_unit_fips", "percent_expected_vote", "election_id") or x.startswith(("results_", "raw_results_"))]
    return c.select(*keep)


#: Short column names of old versions and their full ones (fixed values).
ALIASES = {"dem": "results_dem", "gop": "results_gop", "total": "results_turnout"}


def versions(spark: SparkSession, source, start=None, end=None) -> DataFrame:
    """Versioned results with repaired ids and full column names, between two times."""
    v = read(spark, source)
    v = v.withColumnsRenamed({a: b for a, b in ALIASES.items() if a in v.columns and b not in v.columns})
    v = v.withColumn("geographic_unit_fips", repaired_id("geographic_unit_fips"))
    return between(v, start, end)


def version_files(spark: SparkSession, path: str, every: int = 2, start=None, end=None) -> DataFrame:
    """Every n-th file of a folder of snapshots by time of change (within start and end), its rows stamped with that time.

    Rows are kept by a join with the few names of the files, so no list of files passes the driver.
    """
    rows = spark.read.option("header", True).csv(path).select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_modification_time").alias("last_modified"))
    rows = between(rows, start, end)
    files = thin(rows.select("_path", "last_modified").distinct().withColumn("_at", F.struct("last_modified", "_path")), every, [], "_at").select("_path")
    rows = rows.join(bounded(files), "_path", "left_semi").drop("_path")
    names = [c for c in rows.columns if c != "last_modified"]
    return clean(rows.select(*[F.col(c) if c in ID_COLUMNS else F.col(c).cast("double").alias(c) for c in names], "last_modified"))


def past_predictions(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path)


def sibling(baseline_: DataFrame, results: DataFrame, predictions: DataFrame) -> DataFrame:
    """A sibling contest's baseline with its results and predictions, by unit, and the measures that anchoring compares."""
    keys = ["geographic_unit_fips"]
    base = add_baselines(without_results(baseline_), {"margin": "margin"})
    current_, _ = add_results(results, ["margin"])
    found = predictions.select(*keys, "pred_margin", "pred_turnout")
    return base.join(current_.select(*keys, "results_margin", "results_weights"), keys, "left").join(found, keys, "left")
