"""Column helpers and plan helpers shared by all operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is only ever broadcast when it was counted and holds at most this many rows.
BROADCAST_ROWS = 200_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def repaired_id(c: str | Column) -> Column:
    """White space at both ends removed, each '.' turned into '-', then a final '-0' dropped."""
    return F.regexp_replace(F.translate(F.regexp_replace(col(c), r"^\s+|\s+$", ""), ".", "-"), "-0$", "")


def repaired_state(c: str | Column) -> Column:
    """Trimmed and upper-cased."""
    return F.upper(F.regexp_replace(col(c), r"^\s+|\s+$", ""))


def seeded(c: str | Column, seed: int) -> Column:
    """A seeded shuffle as a number: the first 60 bits of a hash that every SQL engine has, so that an order can be rebuilt anywhere."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), col(c).cast("string"))), 1, 15), 16, 10).cast("long")


def nan_to_null(c: str | Column) -> Column:
    return F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame, most: int | None = None) -> DataFrame:
    """Broadcast hint for a side that is counted first; a larger side is left to Spark's own join choice."""
    most = BROADCAST_ROWS if most is None else most
    n = df.limit(most + 1).count()
    return F.broadcast(df) if n <= most else df


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; a temporary one only on a local master where none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="countflow-"))
    return sc.getCheckpointDir()


def clear(spark: SparkSession) -> None:
    """Deletes what this session has checkpointed, at its end: frames that rest on it cannot be read afterwards."""
    folder = spark.sparkContext.getCheckpointDir()
    if folder is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        spark.sparkContext.setCheckpointDir(folder.rsplit("/", 1)[0])


def cut(df: DataFrame) -> DataFrame:
    """Writes the frame to the shared checkpoint folder and returns it without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
