"""Problem 3: what changed between consecutive full snapshots of a table.

The snapshots are kept range-partitioned and sorted by key. Within a range the rows of
all snapshots stream by once in key order, and a pointer pair (a key's row in one
snapshot and its row in the next) is advanced over them, comparing columns and emitting
typed changes. No snapshot is joined with another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countflow.functions.common import bounded, repaired_id, table
from countflow.operators import grouped


def sequence(register: DataFrame, series: str = "election_id", at: str = "taken_at") -> DataFrame:
    """Complete snapshots numbered within their series, each with the id of the next one.

    snapshot_id breaks ties of the time. Only rows with status `complete` count.
    """
    w = Window.partitionBy(series).orderBy(at, "snapshot_id")
    done = register.filter((F.col("status") == "complete") & F.col(series).isNotNull())
    return done.select("snapshot_id", series, F.row_number().over(w).cast("long").alias("seq"), F.lead("snapshot_id").over(w).alias("next_id"))


def _latest(keys: list[str], order: list[str]):
    """Of several rows of a key in one batch only the last by order goes on; nulls come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows > 1:
                by = [(c, "ascending") for c in (*keys, *order)]
                batch = batch.take(pc.sort_indices(batch, sort_keys=by, null_placement="at_start"))
                last = np.append(grouped.new_group(batch, keys)[1:], True)
                batch = batch.filter(pa.array(last))
            yield batch

    return run


def _merge(columns: list[str]):
    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        # Copies that met only now: the last of a key and snapshot counts.
        t = t.filter(pa.array(np.append(grouped.new_group(t, ["election_id", "unit", "seq"])[1:], True)))
        starts = np.flatnonzero(grouped.new_group(t, ["election_id", "unit"]))
        n = t.num_rows
        seq, at, later = (grouped.ints(t, c) if c != "next_id" else np.nan_to_num(grouped.floats(t, c), nan=-1).astype(np.int64) for c in ("seq", "snapshot_id", "next_id"))
        first = np.zeros(n, bool)
        first[starts] = True
        follows = np.append(False, (seq[1:] == seq[:-1] + 1)) & ~first
        differ = np.zeros(n, bool)
        for c in columns:
            a = t.column(c).combine_chunks()
            nulls = a.is_null().to_numpy(zero_copy_only=False)
            unequal = pc.fill_null(pc.not_equal(a[1:], a[:-1]), False).to_numpy(zero_copy_only=False).astype(bool)
            differ[1:] |= unequal | (nulls[1:] != nulls[:-1])
        added = ~follows & (seq > 1)
        changed = follows & differ
        ends = np.append(~follows[1:], True) & (later >= 0)
        rows = np.concatenate([np.flatnonzero(x) for x in (added, changed, ends)])
        kind = np.repeat(["added", "changed", "removed"], [int(x.sum()) for x in (added, changed, ends)])
        snapshot = np.concatenate([at[added], at[changed], later[ends]])
        keys = t.column("unit").combine_chunks().take(pa.array(rows))
        return pa.table({"snapshot_id": pa.array(snapshot, pa.int64()), "unit": keys, "change_type": pa.array(kind, pa.string())})

    return run


def changes(snapshots: DataFrame, register: DataFrame, compare: list[str]) -> DataFrame:
    """Changes between consecutive complete snapshots of a series: (snapshot_id of the later, unit, change_type).

    snapshots: snapshot_id, unit, last_modified and the compared columns. Of several rows
    of a unit in one snapshot the one with the latest last_modified counts (null is
    earliest; among equal ones the largest by the compared columns). Null differs from
    every value and equals null. Rows without a unit have no key and are passed over, as
    are rows of snapshots that the register does not name. Copies of a unit are reduced
    batch by batch before the one shuffle, so a unit repeated without end costs one row per
    batch. A compared NaN differs from everything.
    """
    seq = bounded(sequence(register))
    inner = {c: f"_c{k}" for k, c in enumerate(compare)}
    rows = snapshots.filter(F.col("unit").isNotNull()).select("snapshot_id", "unit", "last_modified", *[F.col(c).alias(n) for c, n in inner.items()])
    rows, compare = rows.join(seq, "snapshot_id"), list(inner.values())
    rows = rows.select("election_id", "unit", "seq", "snapshot_id", "next_id", "last_modified", *compare)
    order = ["last_modified", *compare]
    one = rows.mapInArrow(_latest(["election_id", "unit", "seq"], order), rows.schema)
    return grouped.map_groups(one, ["election_id", "unit"], ["seq", *order], _merge(compare), "snapshot_id long, unit string, change_type string", ranged=True)


# --- snapshots that are kept sorted -----------------------------------------------------------

#: Ranges of a kept layout; a range of one snapshot is what one task reads at a time.
RANGES = 256


def keep(rows: DataFrame, keys: list[str], compare: list[str], order: list[str], path: str, ranges: int = RANGES) -> None:
    """Writes one snapshot to path, one sorted file per range; a later call for another snapshot moves none of the earlier ones.

    Ranges are equal parts of a hash of the keys, so their bounds are fixed for all
    snapshots and no key's popularity skews them. Of several rows of a key the last by
    order (nulls first) is kept; rows whose keys hold a null have no key and are passed over.
    """
    h = F.xxhash64(*keys)
    one = rows.dropna(subset=keys).select(*dict.fromkeys([*keys, *order, *compare]))
    one = one.mapInArrow(_latest(keys, list(dict.fromkeys([*order, *compare]))), one.schema)
    last = one.groupBy(*keys).agg(F.max(F.struct(*dict.fromkeys([*order, *compare]))).alias("_r"))
    last = last.select(h.alias("_h"), *keys, *[F.col(f"_r.{c}").alias(c) for c in compare])
    # Equal parts by the first 24 bits of the hash.
    part = F.floor((F.shiftright("_h", 40) + (1 << 23)) * ranges / (1 << 24)).cast("int")
    last = last.withColumn("range", part)
    last.repartition(ranges, "range").sortWithinPartitions("range", "_h", *keys).write.partitionBy("range").parquet(path)


def _range_rows(folder: str, number: int) -> Iterator[pa.Table]:
    """The batches of one range of a kept snapshot, in key order."""
    fs, path = pa.fs.FileSystem.from_uri(f"{folder}/range={number}")
    if fs.get_file_info(path).type == pa.fs.FileType.NotFound:
        return
    files = sorted(f.path for f in fs.get_file_info(pa.fs.FileSelector(path)) if f.path.endswith(".parquet"))
    if len(files) > 1:
        raise ValueError(f"a kept range has one file, {path} has {len(files)}")
    for batch in pq.ParquetFile(files[0], filesystem=fs).iter_batches() if files else ():
        yield pa.Table.from_batches([batch])


def _two_pointers(old: Iterator[pa.Table], new: Iterator[pa.Table], keys: list[str], compare: list[str]) -> Iterator[tuple[str, pa.Table]]:
    """Walks over two sorted runs side by side, holding about a batch of each, and emits (change type, keys)."""
    sides, done = [None, None], [False, False]
    runs = [iter(old), iter(new)]
    by = [("_h", "ascending"), *[(k, "ascending") for k in keys]]
    while True:
        for i in (0, 1):
            while not done[i] and (sides[i] is None or not sides[i].num_rows):
                sides[i] = next(runs[i], None)
                done[i] = sides[i] is None
        held = [t for t in sides if t is not None and t.num_rows]
        if not held:
            return
        # Up to the lesser of the last keys on hand both runs are complete (a finished run is complete anyway).
        limit = min((int(t.column("_h")[-1].as_py()) for i, t in enumerate(sides) if not done[i]), default=None)
        parts = []
        for i in (0, 1):
            t = sides[i]
            if t is None:
                continue
            n = t.num_rows if limit is None else int(np.searchsorted(t.column("_h").to_numpy(), limit, "right"))
            while not done[i] and n == t.num_rows:
                # Keys of one hash may go on in the next batch.
                more = next(runs[i], None)
                if more is None:
                    done[i] = True
                    break
                t = pa.concat_tables([t, more])
                n = int(np.searchsorted(t.column("_h").to_numpy(), limit, "right"))
            sides[i] = t.slice(n)
            parts.append(t.slice(0, n).append_column("_side", pa.array(np.full(n, i, np.int8))))
        both = pa.concat_tables(parts).combine_chunks()
        both = both.take(pc.sort_indices(both, sort_keys=[*by, ("_side", "ascending")])).combine_chunks()
        if not both.num_rows:
            continue
        side = both.column("_side").to_numpy()
        first = grouped.new_group(both, keys)
        pair = np.append(~first[1:], False) & first
        differ = np.zeros(both.num_rows, bool)
        for c in compare:
            a = both.column(c).combine_chunks()
            nulls = a.is_null().to_numpy(zero_copy_only=False)
            unequal = pc.fill_null(pc.not_equal(a[1:], a[:-1]), False).to_numpy(zero_copy_only=False).astype(bool)
            differ[:-1] |= unequal | (nulls[1:] != nulls[:-1])
        alone = first & ~pair
        for kind, rows in (("added", alone & (side == 1)), ("removed", alone & (side == 0)), ("changed", pair & differ)):
            if rows.any():
                yield kind, both.filter(pa.array(rows)).select(keys)


def kept_changes(spark, old: str, new: str, keys: list[str], compare: list[str], schema: str, ranges: int = RANGES) -> DataFrame:
    """What changed from one kept snapshot to the next: (keys, change_type). schema: of the keys, as DDL.

    One task per range reads both sorted files once, side by side; nothing is shuffled, and
    no other snapshot is touched.
    """
    old, new = (p if "://" in p or p.startswith("file:") else f"file://{p}" for p in (old, new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                for kind, t in _two_pointers(_range_rows(old, number), _range_rows(new, number), keys, compare):
                    yield from t.append_column("change_type", pa.array([kind] * t.num_rows, pa.string())).combine_chunks().to_batches()

    return spark.range(0, ranges, 1, ranges).mapInArrow(run, f"{schema}, change_type string")


def p3_found(spark, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "result_snapshots").select("snapshot_id", repaired_id("geographic_unit_fips").alias("unit"), "last_modified", "results_dem", "results_gop")
    return changes(s, table(spark, sf_dir, "snapshot_register"), ["results_dem", "results_gop"]).withColumnRenamed("unit", "geographic_unit_fips")


def change_counts(spark, sf_dir: str) -> DataFrame:
    """Changes per snapshot and type."""
    return p3_found(spark, sf_dir).groupBy("snapshot_id", "change_type").agg(F.count(F.lit(1)).alias("n"))
