"""Problem 1: per-key results when a few keys hold most rows, by exact offset chunking.

The keys of every input partition (a file split, named by path and start) are
counted, the counts are prefix-summed over the partitions, and every row gets its
exact number within its key while its partition is streamed once. `number // chunk_rows`
cuts each key, hot or not, into chunks of the same size, so that no task ever handles
more than one chunk of a key at a time. Each chunk yields a small boundary state; the
states of a key are then merged in order.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countflow.functions import common
from countflow.functions.common import cut, repaired_id, repaired_state, shared_dir, table

CHUNK_ROWS = 50_000
#: Folders over which offsets are spread where they are too many to broadcast.
BUCKETS = 512


def _offsets_of(folder: str, split: int) -> dict:
    """The offsets of one split, read from the folder of its bucket."""
    fs, path = pa.fs.FileSystem.from_uri(f"{folder}/_b={split % BUCKETS}")
    if fs.get_file_info(path).type == pa.fs.FileType.NotFound:
        return {}
    t = ds.dataset(path, filesystem=fs, format="parquet").to_table(filter=ds.field("_s") == int(split))
    return dict(zip(t.column("_key").to_pylist(), t.column("_offset").to_pylist()))


def _number_batches(key: str, folder: str | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        at = None
        for batch in batches:
            split = batch.column("_split").to_numpy()
            n = batch.num_rows
            number = np.zeros(n, np.int64)
            starts = np.flatnonzero(np.append(True, split[1:] != split[:-1])) if n else []
            for a, b in zip(starts, [*starts[1:], n]):
                if split[a] != at:
                    seen, at = ({} if folder is None else _offsets_of(folder, split[a])), split[a]
                codes = batch.column(key).slice(int(a), int(b - a)).dictionary_encode()
                names = [*codes.dictionary.to_pylist(), None]
                idx = codes.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
                order = np.argsort(idx, kind="stable")
                counts = np.bincount(idx, minlength=len(names))
                begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
                within = np.empty(len(idx), np.int64)
                within[order] = np.arange(len(idx)) - np.repeat(begin, counts)
                base = np.array([seen.get(x, 0) for x in names], np.int64)
                number[a:b] = within + base[idx]
                for x, k in zip(names, counts):
                    if k:
                        seen[x] = seen.get(x, 0) + int(k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number)], names=[*batch.schema.names, "_n"])

    return run


def number_by_key(df: DataFrame, key: str) -> DataFrame:
    """df, read straight from files, with `_n`: the row's 0-based number within its key, in input order.

    df must still carry the file metadata column, so pass a scan with projections and
    filters only. Null keys are numbered as one key. Input columns named like the operator's
    own (_n, _chunk, _split, _path, _start, _key, _s, _offset) are replaced. An empty frame gives
    an empty frame.
    """
    path, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    scan = df.drop("_split", "_path", "_start", "_n", "_chunk", "_key", "_s", "_offset")
    # Rows carry a hash of their split, not its path, through Python.
    split = scan.select("*", F.xxhash64(path, start).alias("_split"))
    counts = scan.select(F.col(key).alias("_key"), path.alias("_path"), start.alias("_start")).groupBy("_path", "_start", "_key").agg(F.count(F.lit(1)).alias("_k"))
    before = Window.partitionBy("_key").orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(counts.withColumn("_offset", F.coalesce(F.sum("_k").over(before), F.lit(0))).drop("_k"))
    offsets = offsets.select(F.xxhash64("_path", "_start").alias("_s"), "_key", "_offset")
    schema = T.StructType([*split.schema.fields, T.StructField("_n", T.LongType())])
    if offsets.limit(common.BROADCAST_ROWS + 1).count() > common.BROADCAST_ROWS:
        # Too many to broadcast: each numbering task fetches those of its own splits, and no row moves.
        folder = f"{shared_dir(df.sparkSession)}/offsets-{uuid.uuid4().hex}"
        offsets.withColumn("_b", F.pmod("_s", F.lit(BUCKETS))).repartition("_b").write.partitionBy("_b").parquet(folder)
        return split.mapInArrow(_number_batches(key, folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"), schema).drop("_split")
    numbered = split.mapInArrow(_number_batches(key), schema)
    same = (F.col("_split") == F.col("_s")) & F.col(key).eqNullSafe(F.col("_key"))
    out = numbered.join(F.broadcast(offsets), same, "left")
    return out.withColumn("_n", F.col("_n") + F.coalesce("_offset", F.lit(0))).drop("_split", "_s", "_key", "_offset")


def chunked(df: DataFrame, key: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """number_by_key with `_chunk`, chunks of exactly chunk_rows rows of one key (the last may be shorter)."""
    return number_by_key(df, key).withColumn("_chunk", F.floor(F.col("_n") / chunk_rows).cast("long"))


def chunk_states(df: DataFrame, key: str, states: list[Column], by: tuple[str, ...] = ()) -> DataFrame:
    """One boundary state per key and chunk (and further columns): partial results that merge exactly."""
    return df.groupBy(key, "_chunk", *by).agg(*states)


# --- the project's tables --------------------------------------------------------------------

MEASURES = ("results_turnout", "results_dem", "results_gop", "results_weights", "percent_expected_vote")


def last_readings(spark, sf_dir: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The last reading of every unit per state and election, with its number of readings.

    Last is by last_modified, then received_at, then row_id; rows without a time come
    before all others. Rows whose state or unit is null form groups of their own.
    """
    cols = ("election_id", "state", "unit", "last_modified", "received_at", "row_id", *MEASURES)
    rows = _chunks_of(spark, sf_dir, cols, chunk_rows)
    place = F.struct("last_modified", "received_at", "row_id")
    state = [F.max(F.struct(place.alias("place"), *MEASURES)).alias("last"), F.count(F.lit(1)).alias("n")]
    part = chunk_states(rows, "state", state, ("election_id", "unit"))
    merged = part.groupBy("state", "election_id", "unit").agg(F.max("last").alias("last"), F.sum("n").alias("n_readings"))
    return merged.select("state", "election_id", "unit", "n_readings", F.col("last.place.row_id").alias("row_id"), F.col("last.place.last_modified").alias("last_modified"), *[F.col(f"last.{m}").alias(m) for m in MEASURES])


def state_rollup(spark, sf_dir: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Counts and roll-ups per state over all readings, and sums over the last reading of each unit."""
    rows = _chunks_of(spark, sf_dir, ("election_id", "state", "unit", "last_modified", "received_at", "row_id", "results_turnout", "results_dem", "results_gop", "percent_expected_vote"), chunk_rows)
    pev = F.when(~F.isnan("percent_expected_vote"), F.col("percent_expected_vote"))
    last = F.max(F.struct(F.struct("last_modified", "received_at", "row_id").alias("place"), "results_dem", "results_gop")).alias("last")
    state = [last, F.count(F.lit(1)).alias("n"), F.count("results_dem").alias("n_dem"), F.count(pev).alias("n_pev"), F.sum("results_turnout").alias("turnout"), F.max(pev).alias("max_pev"), F.min("received_at").alias("from"), F.max("received_at").alias("to")]
    sums = [F.sum(c).alias(c) for c in ("n", "n_dem", "n_pev", "turnout")]
    ends = [F.max("max_pev").alias("max_pev"), F.min("from").alias("from"), F.max("to").alias("to")]
    units = chunk_states(rows, "state", state, ("election_id", "unit")).groupBy("state", "election_id", "unit").agg(F.max("last").alias("last"), *sums, *ends)
    out = units.groupBy("state").agg(*sums, *ends, F.count(F.lit(1)).alias("n_units"), F.sum("last.results_dem").alias("last_dem"), F.sum("last.results_gop").alias("last_gop"))
    return out.withColumnsRenamed({"n": "n_rows", "n_pev": "n_percent", "turnout": "sum_turnout", "max_pev": "max_percent", "from": "first_received", "to": "last_received"})


def arrival_gaps(spark, sf_dir: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per state, in order of arrival: the longest wait in seconds and how often the clock of arrival went back.

    Inside a chunk neighbours are compared by number; between chunks the merged boundary
    states (first and last time of each chunk) supply the missing comparison. Rows without
    received_at are passed over.
    """
    rows = _chunks_of(spark, sf_dir, ("state", "received_at"), chunk_rows).filter(F.col("received_at").isNotNull())
    inside = Window.partitionBy("state", "_chunk").orderBy("_n")
    step = F.unix_micros("received_at") - F.lag(F.unix_micros("received_at")).over(inside)
    rows = rows.withColumn("step", step)
    state = [F.max("step").alias("longest"), F.count_if(F.col("step") < 0).alias("back"), F.min_by(F.unix_micros("received_at"), "_n").alias("first"), F.max_by(F.unix_micros("received_at"), "_n").alias("last"), F.count(F.lit(1)).alias("n")]
    part = chunk_states(rows, "state", state)
    across = F.col("first") - F.lag("last").over(Window.partitionBy("state").orderBy("_chunk"))
    merged = part.withColumn("across", across).groupBy("state").agg(F.sum("n").alias("n_rows"), F.max(F.greatest("longest", "across")).alias("longest"), F.sum(F.col("back") + F.when(F.col("across") < 0, 1).otherwise(0)).alias("n_back"))
    return merged.select("state", "n_rows", (F.col("longest") / 1e6).alias("longest_wait_s"), "n_back")


def _chunks_of(spark, sf_dir: str, columns: tuple[str, ...], chunk_rows: int) -> DataFrame:
    base = table(spark, sf_dir, "versioned_results")
    return chunked_scan(base, "state", repaired_state("postal_code"), {"unit": repaired_id("geographic_unit_fips")}, columns, chunk_rows)


def chunked_scan(scan: DataFrame, key: str, key_expr: Column, made: dict[str, Column], columns: tuple[str, ...], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """chunked() over a file scan, with derived columns; only the named columns are read."""
    exprs = [key_expr.alias(key) if c == key else made[c].alias(c) if c in made else F.col(c) for c in columns]
    return chunked(scan.select(*exprs), key, chunk_rows)
