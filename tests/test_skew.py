"""Keys that hold most rows, chunk borders and segments."""

import random

import numpy as np
from pyspark.sql import functions as F

from countflow.operators import chunks, grid, grouped, spikes


def write(spark, path, rows, schema, files=3):
    spark.createDataFrame(rows, schema).repartition(files).write.parquet(path)
    return spark.read.parquet(path)


def test_numbers_are_exact_and_chunks_equal(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, r.choice(["A"] * 8 + ["B", None, "C"]), 9) for i in range(3000)]
    df = write(spark, str(tmp_path / "t.parquet"), rows, "id long, k string, _chunk int")
    out = chunks.chunked(df.select("id", "k"), "k", 100).collect()
    assert len(out) == 3000
    by = {}
    for x in out:
        by.setdefault(x.k, []).append(x)
    for k, xs in by.items():
        assert sorted(x._n for x in xs) == list(range(len(xs)))
        sizes = np.bincount([x._chunk for x in xs])
        assert (sizes[:-1] == 100).all() and 0 < sizes[-1] <= 100
    # A column named like the operator's own is replaced.
    assert chunks.chunked(df, "k", 100).filter("_chunk = 9").count() == sum(1 for x in out if x._chunk == 9)


def test_chunks_of_an_empty_table(spark, tmp_path):
    df = write(spark, str(tmp_path / "t.parquet"), [], "id long, k string")
    assert chunks.chunked(df, "k").count() == 0


def test_small_chunks_give_the_same_results(spark, data):
    for f in (chunks.last_readings, chunks.state_rollup, chunks.arrival_gaps):
        assert sorted(map(str, f(spark, data).collect())) == sorted(map(str, f(spark, data, 37).collect()))


def test_offsets_beyond_the_broadcast_bound(spark, data, monkeypatch):
    from countflow.functions import common

    want = [sorted(map(str, f(spark, data).collect())) for f in (chunks.last_readings, chunks.arrival_gaps)]
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert [sorted(map(str, f(spark, data).collect())) for f in (chunks.last_readings, chunks.arrival_gaps)] == want
    # Rows are numbered where they are read: nothing moves before the chunk states.
    plan = chunks.chunked(spark.read.parquet(f"{data}/versioned_results.parquet").select("postal_code", "row_id"), "postal_code")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_prefix_numbers(spark):
    r = random.Random(2)
    rows = [("a" if i % 5 else "b", r.randint(0, 50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t long, i long")
    got = grouped.prefix_number(df, ["k"], ["t", "i"], F.floor(F.col("t") / 10), "n").collect()
    for k in "ab":
        want = {i: n for n, (_, t, i) in enumerate(sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], x[2])))}
        assert {x.i: x.n for x in got if x.k == k} == want


def test_segments_change_no_result(spark, data, monkeypatch):
    p4 = {tuple(x) for x in grid.p4_found(spark, data).collect()}
    whole = grid.p4_grid(spark, data).select("election_id", "geographic_unit_fips", "period_start", "n_readings", "percent_expected_vote").collect()
    p2 = {tuple(x) for x in spikes.p2_found(spark, data).collect()}
    monkeypatch.setattr(grouped, "SEGMENT_ROWS", 40)
    monkeypatch.setattr(grid, "COMBINED_ROWS", 50)
    assert {tuple(x) for x in grid.p4_found(spark, data).collect()} == p4
    parts = grid.p4_grid(spark, data).select("election_id", "geographic_unit_fips", "period_start", "n_readings", "percent_expected_vote").collect()
    assert len(parts) == len(whole)
    near = {tuple(x[:3]): x for x in whole}
    for x in parts:
        y = near[tuple(x[:3])]
        assert x.n_readings == y.n_readings and (x.percent_expected_vote is None) == (y.percent_expected_vote is None)
        assert x.percent_expected_vote is None or abs(x.percent_expected_vote - y.percent_expected_vote) < 1e-6
    assert {tuple(x) for x in spikes.p2_found(spark, data).collect()} == p2


def test_block_borders_change_no_result(spark, data, monkeypatch):
    p2 = {tuple(x) for x in spikes.p2_found(spark, data).collect()}
    f = grouped.map_groups
    monkeypatch.setattr(grouped, "map_groups", lambda *a, **k: f(*a, **k, block_rows=100))
    assert {tuple(x) for x in spikes.p2_found(spark, data).collect()} == p2
