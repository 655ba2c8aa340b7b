"""Snapshots, grids, orphans and profiles on small tables with awkward rows."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from countflow.operators import grid, orphans, quality, snapshots

T0 = datetime.datetime(2024, 1, 1)


def at(m):
    return T0 + datetime.timedelta(minutes=m)


SNAP = "snapshot_id long, unit string, last_modified timestamp, d long, seq string"
REG = "snapshot_id long, election_id string, taken_at timestamp, status string"


def test_changes_between_snapshots(spark):
    reg = [(5, "e", at(0), "complete"), (3, "e", at(10), "partial"), (1, "e", at(20), "complete"), (9, "e", at(30), "complete"), (7, "x", at(0), "complete")]
    rows = [
        (5, "a", at(0), 1, ""), (5, "b", at(0), None, ""), (5, "c", at(0), 2, ""), (5, None, at(0), 2, ""),
        (3, "z", at(0), 1, ""),
        (1, "a", at(1), 2, ""), (1, "a", at(0), 1, ""), (1, "a", None, 9, ""), (1, "b", at(0), None, ""), (1, "d", at(0), 4, ""), (1, "d", at(0), 4, ""),
        (9, "b", at(0), 0, ""), (9, "d", at(7), 4, ""), (9, "c", at(0), 2, ""), (7, "q", at(0), 1, ""), (99, "q", at(0), 1, ""),
    ]
    out = snapshots.changes(spark.createDataFrame(rows, SNAP), spark.createDataFrame(reg, REG), ["d"])
    want = {(1, "a", "changed"), (1, "c", "removed"), (1, "d", "added"), (9, "a", "removed"), (9, "b", "changed"), (9, "c", "added")}
    assert {tuple(x) for x in out.collect()} == want


def test_changes_of_nothing(spark):
    s, r = spark.createDataFrame([], SNAP), spark.createDataFrame([], REG)
    assert snapshots.changes(s, r, ["d"]).count() == 0
    r = spark.createDataFrame([(1, "e", at(0), "complete"), (2, "e", at(1), "complete")], REG)
    one = spark.createDataFrame([(1, "a", at(0), 1, "")], SNAP)
    assert {tuple(x) for x in snapshots.changes(one, r, ["d"]).collect()} == {(2, "a", "removed")}


def test_kept_snapshots_are_merged_range_by_range(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)

    def snapshot(n):
        return [(f"k{rng.integers(300)}" if rng.random() > 0.02 else None, at(int(rng.integers(5))) if rng.random() > 0.1 else None, int(rng.integers(3)) if rng.random() > 0.1 else None) for _ in range(n)]

    snaps = [snapshot(600), snapshot(500), [], snapshot(900)]

    def state(rows):
        low = (datetime.datetime.min, -1)
        out = {}
        for k, t, d in rows:
            if k is not None:
                out[k] = max(out.get(k, low), (t or datetime.datetime.min, -1 if d is None else d))
        return {k: v[1] for k, v in out.items()}

    for n, rows in enumerate(snaps):
        snapshots.keep(spark.createDataFrame(rows, "unit string, last_modified timestamp, d long"), ["unit"], ["d"], ["last_modified"], str(tmp_path / f"s{n}"), 7)
    for small in (False, True):
        if small:
            # Runs arrive in pieces of three rows.
            whole = snapshots._range_rows
            pieces = lambda *a: (t.slice(i, 3) for t in whole(*a) for i in range(0, t.num_rows, 3))
            olds = [list(snapshots._two_pointers(pieces(f"file://{tmp_path}/s0", r), pieces(f"file://{tmp_path}/s1", r), ["unit"], ["d"])) for r in range(7)]
            got = {(k, kind) for part in olds for kind, t in part for k in t.column("unit").to_pylist()}
            a, b = state(snaps[0]), state(snaps[1])
            assert got == {(k, "added") for k in b.keys() - a.keys()} | {(k, "removed") for k in a.keys() - b.keys()} | {(k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
            continue
        for n in range(3):
            a, b = state(snaps[n]), state(snaps[n + 1])
            want = {(k, "added") for k in b.keys() - a.keys()} | {(k, "removed") for k in a.keys() - b.keys()} | {(k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
            out = snapshots.kept_changes(spark, str(tmp_path / f"s{n}"), str(tmp_path / f"s{n + 1}"), ["unit"], ["d"], "unit string", 7)
            got = [tuple(x) for x in out.collect()]
            assert len(got) == len(want) and set(got) == want
            assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


READ = "row_id long, election_id string, unit string, last_modified timestamp, received_at timestamp, percent_expected_vote double, results_margin long"


def test_grid_fills_and_marks(spark):
    t = datetime.datetime(2024, 1, 1, 0, 5)
    rows = [(i, "e", "u", t + datetime.timedelta(minutes=m), t + datetime.timedelta(minutes=m + 1), 2.0 * m, None) for i, m in enumerate([0, 10, 20, 60, 70])]
    rows += [rows[1], (20, "e", "v", t, t, None, 5), (21, "e", "w", t, t - datetime.timedelta(minutes=1), 1.0, 1), (22, "e", None, t, t, 1.0, 1), (23, "e", "x", t, t, float("nan"), None)]
    out = grid.on_grid(spark.createDataFrame(rows, READ)).orderBy("unit", "period_start").collect()
    u = [x for x in out if x.unit == "u"]
    assert [x.n_readings for x in u] == [1, 2, 1, 0, 0, 0, 1, 1]
    assert [x.missing for x in u] == [n == 0 for n in (1, 2, 1, 0, 0, 0, 1, 1)]
    assert all(abs(x.percent_expected_vote - 20 * k) < 2 for k, x in enumerate(u))
    assert all(x.results_margin is None for x in u)
    assert u[4].percent_expected_vote_sd > u[1].percent_expected_vote_sd
    assert [(x.unit, x.results_margin is not None, x.percent_expected_vote) for x in out if x.unit != "u"] == [("v", True, None)]
    assert grid.on_grid(spark.createDataFrame([], READ)).count() == 0


def test_smoother_matches_the_direct_solution():
    """The filter-smoother equals conditioning the joint Gaussian of all levels."""
    t = np.array([0.0, 100.0, 250.0, 400.0, 600.0])
    x = np.array([[[1.0], [np.nan], [3.0], [np.nan], [5.5]]])
    q, r = 1e-5, 0.04
    dt = np.diff(t, prepend=t[0])[None]
    a, v = grid.smooth(dt, x, np.array([[r]]), np.array([[q]]))
    size = 6.5
    n = len(t)
    f = lambda d: np.array([[1, d], [0, 1]])
    mean0, cov0 = np.array([1.0, 0.0]), np.diag([(2 * size) ** 2, (size / 600) ** 2])
    mean, blocks, trans = [], [], []
    m, p = mean0, cov0
    for d in dt[0]:
        m = f(d) @ m
        p = f(d) @ p @ f(d).T + q * np.array([[d**3 / 3, d**2 / 2], [d**2 / 2, d]])
        mean.append(m)
        blocks.append(p)
        trans.append(f(d))
    cov = np.zeros((2 * n, 2 * n))
    for i in range(n):
        c = blocks[i]
        cov[2 * i : 2 * i + 2, 2 * i : 2 * i + 2] = c
        for j in range(i + 1, n):
            c = trans[j] @ c
            cov[2 * j : 2 * j + 2, 2 * i : 2 * i + 2] = c
            cov[2 * i : 2 * i + 2, 2 * j : 2 * j + 2] = c.T
    h = np.zeros((3, 2 * n))
    for k, i in enumerate((0, 2, 4)):
        h[k, 2 * i] = 1
    y = np.array([1.0, 3.0, 5.5])
    mu = np.concatenate(mean)
    gain = cov @ h.T @ np.linalg.inv(h @ cov @ h.T + r * np.eye(3))
    post, pcov = mu + gain @ (y - h @ mu), cov - gain @ h @ cov
    assert np.allclose(a[0, :, 0], post[::2], atol=1e-6)
    assert np.allclose(v[0, :, 0], np.diag(pcov)[::2], atol=1e-5)


REF = "id long, a string, b string, at timestamp, _spans string"
TGT = "a string, b string, added_at timestamp, removed_at timestamp"


def orphan_ids(spark, rows, targets, match):
    out = orphans.orphans(spark.createDataFrame(rows, REF), targets, "at", match)
    return sorted((x.id, x._field) for x in out.collect())


def test_match_semantics_by_null_mask(spark):
    t = spark.createDataFrame([("x", "1", at(0), None), ("y", "2", at(0), at(10)), ("y", "2", at(20), None), ("y", "2", at(20), None), (None, "9", at(0), None)], TGT)
    rows = [(1, "x", "1", at(5), ""), (2, "x", "2", at(5), ""), (3, "x", None, at(5), ""), (4, None, "9", at(5), ""), (5, None, None, at(5), ""), (6, "y", "2", at(15), ""), (7, "y", "2", at(25), ""), (8, "z", None, at(5), ""), (9, "x", "1", None, "")]
    assert orphan_ids(spark, rows, {("a", "b"): t}, "simple") == [(2, "a+b"), (6, "a+b"), (9, "a+b")]
    assert orphan_ids(spark, rows, {("a", "b"): t}, "partial") == [(2, "a+b"), (6, "a+b"), (8, "a"), (9, "a+b")]
    assert orphan_ids(spark, rows, {("a",): t}, "each") == [(6, "a"), (8, "a"), (9, "a")]
    assert orphan_ids(spark, [], {("a",): t}, "each") == []
    assert orphan_ids(spark, rows[:1], {("a",): t.limit(0)}, "each") == [(1, "a")]


LOAD = "load_id long, results_weights double, results_normalized_margin double, percent_expected_vote double, extra string"


def test_findings(spark, tmp_path):
    rows = [(1, float(i), i / 100, float(i), "x") for i in range(60)]
    rows += [(2, float(i), i / 100, float(i % 3), "x") for i in range(60)]
    rows += [(3, i + 0.5 if i == 7 else float(i), math.nan if i < 9 else i / 100, math.inf if i == 3 else float(i % 3), "x") for i in range(60)]
    rows += [(3, None, None, None, None)]
    spark.createDataFrame(rows, LOAD).repartition(3).write.parquet(str(tmp_path / "l.parquet"))
    reg = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3)], "load_id long, prev_load_id long")
    got = {tuple(x) for x in quality.findings(spark, spark.read.parquet(str(tmp_path / "l.parquet")), reg).collect()}
    want = {(2, "percent_expected_vote", "distinct"), (2, "percent_expected_vote", "distribution"), (3, "results_weights", "pattern"), (3, "results_normalized_margin", "nulls"), (3, "percent_expected_vote", "range")}
    assert got == want


def test_quartiles_are_exact(spark):
    r = np.random.default_rng(3)
    v = np.round(np.concatenate([r.normal(0, 1, 301), r.normal(50, 20, 200), np.zeros(40)]), 2)
    rows = [(1, float(x), float(x), float(x), "") for x in v] + [(2, 1.0, 1.0, 1.0, ""), (3, None, None, None, "")]
    out = {x.load_id: x for x in quality.load_statistics(spark.createDataFrame(rows, LOAD)).filter("column_name = 'results_weights'").collect()}
    assert [out[1].q1, out[1].median, out[1].q3] == pytest.approx(list(np.quantile(v, [0.25, 0.5, 0.75])))
    assert (out[2].q1, out[2].median, out[2].q3) == (1.0, 1.0, 1.0)
    assert out[3].median is None and out[3].n_null == 1 and out[3].n_distinct == 0


def test_partial_keys_are_matched_mask_by_mask(spark):
    import itertools

    rng = np.random.default_rng(8)
    pick = lambda *v: v[rng.integers(len(v))]
    target = [(pick("a", "b", None), pick("x", "y", "z", None), at(int(rng.integers(0, 20))), pick(None, at(int(rng.integers(20, 40))))) for _ in range(25)]
    refs = [(i, pick("a", "b", "c", None), pick("x", "y", "w", None), pick(at(int(rng.integers(0, 45))), None)) for i in range(120)] * 2
    t = spark.createDataFrame(target, "p string, q string, added_at timestamp, removed_at timestamp")
    r = spark.createDataFrame(refs, "id long, p string, q string, at timestamp")
    for match, masks in (("partial", {(1, 0), (0, 1), (1, 1)}), ("simple", {(1, 1)})):
        want = []
        for i, p, q, when in refs:
            mask = (int(p is not None), int(q is not None))
            if mask in masks:
                held = any((p is None or p == tp) and (q is None or q == tq) and when is not None and a <= when and (e is None or e > when) for tp, tq, a, e in target)
                want += [] if held else [(i, "+".join(itertools.compress("pq", mask)))]
        got = [(x.id, x._field) for x in orphans.orphans(r, {("p", "q"): t}, "at", match).collect()]
        assert sorted(got) == sorted(want) and want


def test_orphans_scan_each_table_once(spark, data):
    plan = orphans.p5_found(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_id") and sum(line.count("Relation [row_id") for line in plan.split("\n")) == 3


def test_profile_with_and_without_statistics(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    t = pa.table({"i": pa.array([1, None, 3, 3]), "x": pa.array([1.0, math.nan, None, -2.0]), "s": pa.array(["b", "a", None, "a"]), "n": pa.array([None] * 4, pa.int64()), "z": pa.array([[1], [2], None, [3]])})
    (tmp_path / "p.parquet").mkdir()
    pq.write_table(t, tmp_path / "p.parquet/a.parquet")
    pq.write_table(t, tmp_path / "p.parquet/b.parquet", write_statistics=False)
    out = {x.column_name: x for x in quality.profile(spark, spark.read.parquet(str(tmp_path / "p.parquet"))).collect()}
    assert set(out) == {"i", "x", "s", "n"}
    assert (out["i"].n_rows, out["i"].n_null, out["i"].n_distinct, out["i"].low, out["i"].high) == (8, 2, 2, 1.0, 3.0)
    assert (out["x"].n_null, out["x"].n_distinct, out["x"].low, out["x"].high) == (4, 2, -2.0, 1.0)
    assert (out["s"].n_null, out["s"].n_distinct, out["s"].low_text, out["s"].high_text) == (2, 2, "a", "b")
    assert (out["n"].n_null, out["n"].n_distinct, out["n"].low) == (8, 0, None)


def test_profile_of_every_kind_is_exact(spark, tmp_path):
    import decimal

    import pyarrow as pa
    import pyarrow.parquet as pq

    n = 300
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(days=i % 100) for i in range(n)]
    t = pa.table({
        "big": pa.array([9007199254740993 + i for i in range(n)]), "day": pa.array(days), "money": pa.array([decimal.Decimal(i % 50) / 4 for i in range(n)], pa.decimal128(10, 2)),
        "flag": pa.array([i % 3 == 0 for i in range(n)]), "small": pa.array([i % 7 - 3 for i in range(n)], pa.int8()), "when": pa.array([T0 + datetime.timedelta(microseconds=i) for i in range(n)], pa.timestamp("us")),
        "long_text": pa.array(["x" * 100 + str(i % 9) for i in range(n)]), "raw": pa.array([bytes([i % 5]) for i in range(n)]), "real": pa.array([float(i % 20) if i % 4 else math.nan for i in range(n)], pa.float32()), "zero": pa.array([0.0 if i % 2 else -0.0 for i in range(n)]),
    })
    (tmp_path / "k.parquet").mkdir()
    for k, options in enumerate(({}, {"use_dictionary": False}, {"dictionary_pagesize_limit": 64, "compression": "zstd"}, {"data_page_version": "2.0", "compression": "gzip", "write_statistics": False})):
        pq.write_table(t, tmp_path / f"k.parquet/{k}.parquet", row_group_size=130, **options)
    out = {x.column_name: x for x in quality.profile(spark, spark.read.parquet(str(tmp_path / "k.parquet"))).collect()}
    assert {c: x.n_distinct for c, x in out.items()} == {"big": n, "day": 100, "money": 50, "flag": 2, "small": 7, "when": n, "long_text": 9, "raw": 5, "real": 15, "zero": 1}
    assert (out["big"].low_whole, out["big"].high_whole) == (9007199254740993, 9007199254740992 + n)
    assert (out["day"].low_whole, out["day"].high_whole) == (19723, 19822)
    assert (out["money"].low_decimal, out["money"].high_decimal) == (0, decimal.Decimal("12.25"))
    assert (out["flag"].low_whole, out["flag"].high_whole, out["small"].low, out["small"].high) == (0, 1, -3, 3)
    assert (out["long_text"].low_text, out["long_text"].high_text) == ("x" * 100 + "0", "x" * 100 + "8")
    assert out["real"].n_null == 4 * 75 and (out["real"].low, out["real"].high) == (1.0, 19.0)
    assert out["when"].high_whole - out["when"].low_whole == n - 1


def test_chunks_apart_count_alone(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "a.parquet").mkdir()
    for k in range(4):
        pq.write_table(pa.table({"id": list(range(100 * k, 100 * k + 100)), "s": [f"{k}{i % 10}" for i in range(100)], "both": [i % 13 + 5 * k for i in range(100)]}), tmp_path / f"a.parquet/{k}.parquet")
    out = {x.column_name: x.n_distinct for x in quality.profile(spark, spark.read.parquet(str(tmp_path / "a.parquet"))).collect()}
    assert out == {"id": 400, "s": 40, "both": 28}


def test_dictionaries_name_all_values_or_nothing(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from countflow.sources import pages

    t = pa.table({"s": pa.array(["b", None, "a", "b"] * 50), "x": pa.array([1.5, None, math.nan, 1.5] * 50), "i": pa.array([3, 4, None, 3] * 50, pa.int32())})
    for k, (options, some) in enumerate((({}, True), ({"use_dictionary": False}, False), ({"compression": "none"}, True), ({"data_page_size": 16, "write_batch_size": 8, "data_page_version": "2.0"}, True))):
        path = str(tmp_path / f"{k}.parquet")
        pq.write_table(t, path, **options)
        got = [pages.dictionary(path, 0, c) for c in range(3)]
        assert [g is not None for g in got] == [some] * 3
        if some:
            assert got[0].to_pylist() == ["b", "a"] and got[1].to_pylist()[0] == 1.5 and math.isnan(got[1].to_pylist()[1]) and got[2].to_pylist() == [3, 4]
    unlike = pa.table({"x": [float(i) for i in range(5000)]})
    pq.write_table(unlike, str(tmp_path / "f.parquet"), dictionary_pagesize_limit=1000, data_page_size=1000, write_batch_size=100)
    assert pages.dictionary(str(tmp_path / "f.parquet"), 0, 0) is None


def test_clean_chunks_are_not_read(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    from countflow.sources import pages

    rows = [(1, 1.0, 0.5, 5.0, "")] * 10
    spark.createDataFrame(rows, LOAD).coalesce(1).write.parquet(str(tmp_path / "l.parquet"))
    scan = spark.read.parquet(str(tmp_path / "l.parquet"))
    path = pages.paths(scan).first()[0]
    _, f = pages.open_file(path)
    names = [f.metadata.row_group(0).column(c).path_in_schema for c in range(f.metadata.num_columns)]
    work = pa.RecordBatch.from_pylist([{"path": path, "row_group": 0, "_chunks": [{"column_no": names.index(c), "column_name": c} for c in quality.RULES]}])
    monkeypatch.setattr(type(f), "read_row_group", lambda *a, **k: pytest.fail("a clean chunk was read"))
    assert list(quality._break_chunks(iter([work]))) == []
    monkeypatch.undo()
    assert quality.form_breaks(scan).count() == 0


def test_rows_without_a_load_find_nothing(spark, tmp_path):
    rows = [(None, -5.0, 7.0, 500.5555, "")] * 3 + [(1, 1.0, 0.5, 5.0, "")] * 3
    spark.createDataFrame(rows, LOAD).coalesce(1).write.parquet(str(tmp_path / "n.parquet"))
    reg = spark.createDataFrame([(1, None)], "load_id long, prev_load_id long")
    assert quality.findings(spark, spark.read.parquet(str(tmp_path / "n.parquet")), reg).count() == 0
