"""Problem 6: column-level data quality profile.

The footers of the columnar files give exact null counts and extrema for chunks whose
statistics are valid; distinct candidates come from the chunks' dictionaries, which also
tell whether a chunk holds NaN (it counts as null here, and no footer tells it from a
value); only chunks whose statistics are insufficient are scanned. All of it is read on
the executors, one open file for each row group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from countflow.functions.common import bounded, cut, table
from countflow.sources.pages import dictionary, open_file, paths

#: Lengths from which writers may cut a text's extrema short.
CUT_TEXT = 64
EXACT = pa.decimal128(38, 18)
FOOTER = "path string, row_group int, column_no int, column_name string, kind string, n_rows long, n_null long, low double, high double, low_text string, high_text string, known boolean"


def _kind(t: pa.DataType) -> str:
    """real, whole (also times and dates, as their integers), decimal, text or other."""
    if pa.types.is_floating(t):
        return "real"
    if pa.types.is_integer(t) and t != pa.uint64() or pa.types.is_timestamp(t) or pa.types.is_date32(t) or pa.types.is_boolean(t):
        return "whole"
    return "decimal" if pa.types.is_decimal(t) else "text" if pa.types.is_string(t) or pa.types.is_large_string(t) else "other"


def _whole(a: pa.Array) -> pa.Array:
    """Integers as they are; times in microseconds, dates in days since 1970; booleans as 0 and 1."""
    if pa.types.is_timestamp(a.type):
        a = a.cast(pa.timestamp("us", a.type.tz), safe=False)
    return a.cast(pa.int32()).cast(pa.int64()) if pa.types.is_date32(a.type) or pa.types.is_boolean(a.type) else a.cast(pa.int64())


def _per_unit(t: pa.DataType) -> float:
    return 1e6 if pa.types.is_timestamp(t) else 1.0


def _read_footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FOOTER.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in FOOTER.split(", ")])
    for batch in batches:
        rows = []
        for path in batch.column(0).to_pylist():
            _, f = open_file(path)
            for g in range(f.metadata.num_row_groups):
                group = f.metadata.row_group(g)
                for c in range(group.num_columns):
                    chunk = group.column(c)
                    name = chunk.path_in_schema
                    if "." in name:
                        continue
                    kind, s = _kind(f.schema_arrow.field(name).type), chunk.statistics
                    n_null = s.null_count if s is not None and s.has_null_count else None
                    low = high = low_text = high_text = None
                    ok = s is not None and s.has_min_max and kind in ("real", "whole", "text")
                    if ok and kind == "text":
                        ok = isinstance(s.min, str) and max(len(s.min.encode()), len(s.max.encode())) < CUT_TEXT
                        low_text, high_text = (s.min, s.max) if ok else (None, None)
                    elif ok:
                        ends = pa.array([s.min, s.max]) if kind == "real" else _whole(pa.array([s.min, s.max], f.schema_arrow.field(name).type))
                        low, high = (float(x) for x in ends.to_pylist())
                        # Beyond 53 bits a double cannot tell neighbours apart; such a chunk is looked into.
                        ok = not (math.isnan(low) or math.isnan(high)) and (kind == "real" or max(abs(low), abs(high)) < 2.0**53)
                    known = n_null is not None and (n_null == group.num_rows or ok and kind != "real")
                    rows.append((path, g, c, name, kind, group.num_rows, n_null, low if ok else None, high if ok else None, low_text, high_text, known))
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)


def footers(scan: DataFrame) -> DataFrame:
    """One row per file, row group and flat column with what its footer proves.

    `known`: nulls and extrema are both exact (a chunk of reals may hold NaN, which only its
    values tell). low and high of whole kinds are those of their integers.
    """
    return paths(scan).mapInArrow(_read_footers, FOOTER)


FACT = "_c int, n_null long, low double, high double, low_whole long, high_whole long, low_decimal decimal(38,18), high_decimal decimal(38,18), low_text string, high_text string, n_own long, num long, text string"
_FACTS = pa.schema([("_c", pa.int32()), ("n_null", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("low_whole", pa.int64()), ("high_whole", pa.int64()), ("low_decimal", EXACT), ("high_decimal", EXACT), ("low_text", pa.string()), ("high_text", pa.string()), ("n_own", pa.int64()), ("num", pa.int64()), ("text", pa.string())])


def _candidates(values: pa.Array) -> tuple[pa.Array | None, pa.Array | None]:
    """Distinct values as 64 bits or as text, one of both."""
    kind = _kind(values.type)
    if kind == "real":
        # Both zeros are one value.
        return pc.unique(pa.array((values.cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0).view(np.int64))), None
    if kind == "whole":
        return _whole(values), None
    if kind in ("decimal", "text"):
        return None, values.cast(pa.string())
    return None, pa.array([str(x) for x in values.to_pylist()], pa.string())


def _facts_of(values: pa.Array, kind: str) -> dict:
    """Extrema of distinct non-null values without NaN."""
    if not len(values) or kind == "other":
        return {}
    if kind == "decimal":
        ends = pc.min_max(values)
        try:
            return {"low_decimal": ends["min"].cast(EXACT).as_py(), "high_decimal": ends["max"].cast(EXACT).as_py()}
        except pa.ArrowInvalid:
            return {}
    ends = pc.min_max(_whole(values) if kind == "whole" else values)
    low, high = ends["min"].as_py(), ends["max"].as_py()
    if kind == "text":
        return {"low_text": low, "high_text": high}
    if kind == "real":
        return {"low": float(low), "high": float(high)}
    per = _per_unit(values.type)
    return {"low": low / per, "high": high / per, "low_whole": low, "high_whole": high}


def _look(names: list[str]):
    """For each row group: facts of every chunk, and the candidates of chunks whose ranges meet others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                path, g = row["path"], row["row_group"]
                _, f = open_file(path)
                facts = []
                for c in row["_chunks"]:
                    name, kind, n_null = c["column_name"], c["kind"], c["n_null"]
                    values = dictionary(path, g, c["column_no"])
                    nan = values is not None and kind == "real" and pc.any(pc.is_nan(values)).as_py()
                    if values is None or nan or n_null is None:
                        whole = f.read_row_group(g, columns=[name]).column(0).combine_chunks()
                        if kind == "real":
                            whole = pc.if_else(pc.is_nan(whole), None, whole)
                        n_null = whole.null_count
                        try:
                            values = pc.unique(whole).drop_null()
                        except pa.ArrowNotImplementedError:
                            values = whole.drop_null()
                    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
                    num, text = _candidates(values)
                    n = names.index(name)
                    alone = c["alone"] and kind != "other"
                    facts.append({"_c": n, "n_null": n_null, "n_own": len(num if num is not None else text) if alone else 0, **_facts_of(values, kind)})
                    if alone:
                        continue
                    some = num if num is not None else text
                    for i in range(0, len(some), 50_000):
                        part = some.slice(i, 50_000)
                        columns = {"_c": pa.array(np.full(len(part), n, np.int32)), "num" if num is not None else "text": part}
                        yield pa.RecordBatch.from_arrays([columns.get(x.name, pa.nulls(len(part), x.type)) for x in _FACTS], schema=_FACTS)
                yield pa.RecordBatch.from_pylist(facts, schema=_FACTS)

    return run


EXTREMA = ("low", "high", "low_whole", "high_whole", "low_decimal", "high_decimal", "low_text", "high_text")


def profile(spark: SparkSession, scan: DataFrame) -> DataFrame:
    """Rows, nulls (NaN too), distinct values and extrema of every flat column of a table of Parquet files.

    Exact. low and high are doubles (times in seconds since 1970); low_whole and high_whole
    hold the integers of whole numbers, times (microseconds), dates (days) and booleans;
    low_decimal and high_decimal those of decimals that fit decimal(38, 18); text has
    low_text and high_text. Columns of other kinds (binary) have no extrema. A column
    without values has null extrema and 0 distinct values; an empty table gives rows only
    for columns of files that exist. scan must be the files' own, without filters.

    A chunk whose range meets no other chunk's counts its distinct values alone; only
    candidates of chunks that overlap travel to be counted once.
    """
    chunks = cut(footers(scan))
    names = [f.name for f in scan.schema.fields]
    by = Window.partitionBy("column_name")
    alone = F.lit(False)
    for low, high in (("low", "high"), ("low_text", "high_text")):
        order = by.orderBy(low, high, "path", "row_group")
        before = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
        after = F.lead(low).over(order)
        apart = F.col(low).isNotNull() & (before.isNull() | (before < F.col(low))) & (after.isNull() | (F.col(high) < after))
        alone = alone | apart
    # Chunks of unknown range might meet any other.
    known = F.bool_and(F.col("low").isNotNull() | F.col("low_text").isNotNull() | F.coalesce(F.col("n_null") == F.col("n_rows"), F.lit(False))).over(by)
    each = chunks.withColumn("alone", F.coalesce(alone & known, F.lit(False)))
    n = max(1, min(4096, chunks.select("path", "row_group").distinct().count()))
    groups = each.groupBy("path", "row_group").agg(F.collect_list(F.struct("column_no", "column_name", "kind", "n_null", "alone")).alias("_chunks")).repartition(n, "path", "row_group")
    found = groups.mapInArrow(_look(names), FACT)
    # Repeated candidates meet per value, not per column, before they are counted.
    ends = [(F.min if c.startswith("low") else F.max)(c).alias(c) for c in EXTREMA]
    values = found.groupBy("_c", "num", "text").agg(F.sum("n_null").alias("n_null"), F.sum("n_own").alias("n_own"), *ends)
    candidate = (F.col("num").isNotNull() | F.col("text").isNotNull()).cast("long")
    facts = values.groupBy("_c").agg(F.sum("n_null").alias("n_null"), (F.sum(candidate) + F.sum("n_own")).alias("n_distinct"), *ends)
    facts = facts.withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0))).select(F.get(F.array(*[F.lit(x) for x in names]), F.col("_c")).alias("column_name"), "n_null", "n_distinct", *EXTREMA)
    return chunks.groupBy("column_name").agg(F.sum("n_rows").alias("n_rows")).join(facts, "column_name")


LARGE = ("versioned_results", "result_snapshots", "current_loads")


def p6_profile(spark, sf_dir: str) -> DataFrame:
    out = None
    for name in LARGE:
        part = profile(spark, table(spark, sf_dir, name)).drop("low_decimal", "high_decimal").withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


# --- findings per load ------------------------------------------------------------------------

#: Column: lowest and highest value, decimals (fixed values of the problem).
RULES = {"results_weights": (0.0, math.inf, 0), "results_normalized_margin": (-1.0, 1.0, 6), "percent_expected_vote": (0.0, 105.0, 2)}
NULLS, DISTINCT, SHIFT, SPREAD = 0.10, 4, 0.5, (0.5, 2.0)
ROUNDING = 1e-6


def _odd(name: str, v: np.ndarray) -> dict[str, np.ndarray]:
    """Which values are out of range or infinite, and which have more decimals than allowed; NaN is neither."""
    low, high, decimals = RULES[name]
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = v * 10.0**decimals
        off = np.abs(scaled - np.rint(scaled)) > ROUNDING * np.maximum(1.0, np.abs(scaled) * 1e-9)
        return {"range": (v < low) | (v > high) | np.isinf(v), "pattern": off & np.isfinite(v)}


def _break_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("load_id", pa.int64()), ("column_name", pa.string()), ("finding", pa.string())])
    for batch in batches:
        for row in batch.to_pylist():
            path, g = row["path"], row["row_group"]
            _, f = open_file(path)
            for c in row["_chunks"]:
                name = c["column_name"]
                values = dictionary(path, g, c["column_no"])
                if values is not None and not any(x.any() for x in _odd(name, values.cast(pa.float64()).to_numpy(zero_copy_only=False)).values()):
                    continue
                t = f.read_row_group(g, columns=["load_id", name])
                v = pc.fill_null(t.column(name).cast(pa.float64()), math.nan).to_numpy()
                for finding, odd in _odd(name, v).items():
                    loads = pc.unique(t.column("load_id").filter(pa.array(odd))).drop_null()
                    yield pa.RecordBatch.from_arrays([loads.cast(pa.int64()), pa.array([name] * len(loads)), pa.array([finding] * len(loads))], schema=schema)


def form_breaks(scan: DataFrame) -> DataFrame:
    """(load_id, column_name, finding) for values out of range (`range`) or form (`pattern`).

    A chunk's dictionary names all its values; only chunks without a dictionary, or with a
    breaking value in it, are scanned for the loads that hold such values. Rows without a
    load belong to none. scan must be the files' own, without filters.
    """
    chunks = footers(scan).filter(F.col("column_name").isin(*RULES))
    groups = chunks.groupBy("path", "row_group").agg(F.collect_list(F.struct("column_no", "column_name")).alias("_chunks"))
    return groups.mapInArrow(_break_chunks, "load_id long, column_name string, finding string").distinct()


def load_statistics(scan: DataFrame) -> DataFrame:
    """Per load and column: rows, nulls, distinct values, exact quartiles.

    Values are first reduced to (load, column, value, count), which combines before the
    shuffle. Ranks of quartiles are then located in value buckets, monotone steps of asinh,
    by a prefix sum over the few buckets of a load, and resolved inside the buckets that
    hold them, so one load may hold any share of all rows.
    """
    stacked = scan.select("load_id", F.explode(F.array(*[F.struct(F.lit(k).alias("_c"), F.nanvl(F.col(c), F.lit(None).cast("double")).alias("v")) for k, c in enumerate(RULES)])).alias("_s"))
    values = stacked.select("load_id", "_s._c", (F.col("_s.v") + F.lit(0.0)).alias("v")).groupBy("load_id", "_c", "v").agg(F.count(F.lit(1)).alias("k"))
    # Columns travel as numbers.
    values = cut(values).withColumn("column_name", F.get(F.array(*[F.lit(c) for c in RULES]), F.col("_c"))).drop("_c")
    finite = F.abs("v") < math.inf
    facts = values.groupBy("load_id", "column_name").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("v").isNull(), F.col("k")).otherwise(0)).alias("n_null"), F.count("v").alias("n_distinct"))
    held = values.filter(F.col("v").isNotNull())
    step = F.when(F.col("v") == math.inf, 10**9).when(F.col("v") == -math.inf, -(10**9)).otherwise(F.floor(F.asinh(F.when(finite, F.col("v")).otherwise(0.0)) * 64)).cast("long")
    held = held.withColumn("_b", step)
    by = ["load_id", "column_name"]
    ordered = Window.partitionBy(*by).orderBy("_b")
    buckets = held.groupBy(*by, "_b").agg(F.sum("k").alias("_k"))
    buckets = buckets.withColumns({"_before": F.sum("_k").over(ordered) - F.col("_k"), "_total": F.sum("_k").over(Window.partitionBy(*by))})
    ranks = F.array(*[F.struct(F.lit(q).alias("q"), (q * (F.col("_total") - 1)).alias("h")) for q in (0.25, 0.5, 0.75)])
    want = buckets.select(*by, "_b", "_before", "_k", F.explode(ranks).alias("_r"))
    want = want.select(*by, "_b", "_before", "_k", "_r.q", "_r.h", F.explode(F.array(F.floor("_r.h"), F.ceil("_r.h"))).alias("rank")).distinct()
    want = want.filter((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_k"))).select(*by, "_b", "_before", "q", "h", "rank")
    want = cut(want)
    inner = held.join(bounded(want.select(*by, "_b", "_before").distinct()), [*by, "_b"])
    inside = Window.partitionBy(*by, "_b").orderBy("v")
    inner = inner.withColumn("_upto", F.col("_before") + F.sum("k").over(inside)).withColumn("_from", F.col("_upto") - F.col("k"))
    got = inner.drop("_before").join(bounded(want), [*by, "_b"]).filter((F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_upto")))
    quart = got.groupBy(*by, "q", "h").agg(F.min_by("v", "rank").alias("lo"), F.max_by("v", "rank").alias("hi"))
    quart = quart.withColumn("x", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + (F.col("h") - F.floor("h")) * (F.col("hi") - F.col("lo"))))
    quart = quart.groupBy(*by).agg(*[F.max(F.when(F.col("q") == q, F.col("x"))).alias(n) for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    return facts.join(quart, by, "left")


def findings(spark: SparkSession, scan: DataFrame, register: DataFrame) -> DataFrame:
    """Each load and column that breaks its form or range or departs from the load before.

    Loads that the register does not name are compared with nothing. Loads without rows
    give nothing; a column without values has no quartiles and so no finding on them.
    Repeated rows count as rows. Rows without a load belong to none. Quartiles, distinct
    values and nulls of a load are in no footer, since row groups hold several loads, so they
    take one scan of the three columns; range and form are answered by dictionaries.
    """
    stats = cut(load_statistics(scan.filter(F.col("load_id").isNotNull())))
    links = bounded(register.filter(F.col("prev_load_id").isNotNull()).select("load_id", "prev_load_id").distinct())
    before = stats.select(F.col("load_id").alias("prev_load_id"), "column_name", *[F.col(c).alias(f"p_{c}") for c in ("n", "n_null", "n_distinct", "q1", "median", "q3")])
    both = stats.join(links, "load_id").join(before, ["prev_load_id", "column_name"])
    iqr, p_iqr = F.col("q3") - F.col("q1"), F.col("p_q3") - F.col("p_q1")
    tests = {
        "nulls": F.col("n_null") / F.col("n") - F.col("p_n_null") / F.col("p_n") >= NULLS - 1e-12,
        "distinct": DISTINCT * F.col("n_distinct") < F.col("p_n_distinct"),
        "distribution": (F.abs(F.col("median") - F.col("p_median")) > SHIFT * p_iqr) | (iqr < SPREAD[0] * p_iqr) | (iqr > SPREAD[1] * p_iqr),
    }
    named = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))
    out = both.select("load_id", "column_name", F.explode(named).alias("finding"))
    return out.unionByName(form_breaks(scan))


def p6_found(spark, sf_dir: str) -> DataFrame:
    return findings(spark, table(spark, sf_dir, "current_loads"), table(spark, sf_dir, "load_register"))
