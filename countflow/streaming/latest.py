"""Streams of readings: the latest state per unit, regular history and live estimates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def without_copies(readings: DataFrame, keys: list[str], at: str = "last_modified", late: str = "6 hours") -> DataFrame:
    """Rows sent twice within the watermark come through once."""
    return readings.withWatermark(at, late).dropDuplicatesWithinWatermark([*keys, at])


def history(readings: DataFrame, keys: list[str], columns: list[str], every: str = "10 minutes", at: str = "last_modified", late: str | None = "6 hours") -> DataFrame:
    """The last reading of every unit in each tumbling window; windows close after the watermark.

    late None: the stream has its watermark already (say, from without_copies).
    """
    last = F.max_by(F.struct(*columns), at).alias("_last")
    marked = readings.withWatermark(at, late) if late else readings
    out = marked.groupBy(F.window(at, every).alias("_w"), *keys).agg(last, F.count(F.lit(1)).alias("n_readings"))
    return out.select(*keys, F.col("_w.start").alias("period_start"), "n_readings", *[F.col(f"_last.{c}").alias(c) for c in columns])


#: Buckets of keys over which the state of the latest rows is spread.
BUCKETS = 64


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _manifests(spark: SparkSession, path: str) -> list[int]:
    fs, p = _folder(spark, path)
    return sorted(int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(p) if x.getPath().getName().startswith("manifest=")) if fs.exists(p) else []


def _versions(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    return {r.bucket: r.version for r in spark.read.parquet(f"{path}/manifest={number}").collect()}


def read_latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The state as of its last whole batch; None before the first."""
    done = _manifests(spark, path)
    held = _versions(spark, path, done[-1]) if done else {}
    return spark.read.parquet(*[f"{path}/rows/bucket={b}/version={v}" for b, v in sorted(held.items())]) if held else None


def upsert_latest(path: str, keys: list[str], at: str = "last_modified", buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps one table with the latest row per unit; of equal times the row that is there stays.

    Keys are spread over buckets, and a batch rewrites only the buckets it touches. A
    manifest, written last, names the version of every bucket, so a batch that fails leaves
    the state as it was and one that is run again gives the same state. Versions that neither
    this manifest nor the one before names are deleted.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())
        earlier = [m for m in _manifests(spark, path) if m < number]
        held = _versions(spark, path, earlier[-1]) if earlier else {}
        old = [f"{path}/rows/bucket={b}/version={held[b]}" for b in touched if b in held]
        every = rows.withColumn("_new", F.lit(1))
        if old:
            every = every.unionByName(spark.read.parquet(*old).withColumns({"_bucket": F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"), "_new": F.lit(0)}), allowMissingColumns=True)
        rest = [c for c in every.columns if c not in (*keys, "_bucket", "_new")]
        latest = every.groupBy("_bucket", *keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(at), -F.col("_new"))).alias("_r")).select("_bucket", *keys, "_r.*")
        if touched:
            latest = latest.withColumn("version", F.lit(number)).withColumnRenamed("_bucket", "bucket").repartition(F.col("bucket"))
            fs, _ = _folder(spark, path)
            for b in touched:
                fs.delete(_folder(spark, f"{path}/rows/bucket={b}/version={number}")[1], True)
            latest.write.mode("append").partitionBy("bucket", "version").parquet(f"{path}/rows")
        now = held | dict.fromkeys(touched, number)
        spark.createDataFrame(list(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest={number}")
        rows.unpersist()
        _sweep(spark, path, now, held)

    return sink


def _sweep(spark: SparkSession, path: str, *kept: dict[int, int]) -> None:
    fs, p = _folder(spark, f"{path}/rows")
    if not fs.exists(p):
        return
    for bucket in fs.listStatus(p):
        name = bucket.getPath().getName()
        if name.startswith("bucket="):
            keep = {held.get(int(name[7:])) for held in kept}
            for version in fs.listStatus(bucket.getPath()):
                if int(version.getPath().getName().split("=")[1]) not in keep:
                    fs.delete(version.getPath(), True)


def run_available(frame: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Processes what is there and stops: a live estimate is this, called again and again."""
    frame.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
