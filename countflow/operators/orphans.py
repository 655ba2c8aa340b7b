"""Problem 5: references to records that do not exist at the time of the reference.

References are grouped by the mask of their null columns. Each mask is anti-joined on its
non-null columns only, with the declared match semantics: `simple` (a reference with a
null column refers to nothing), `partial` (its non-null columns must match together) or
`each` (every non-null column must match its own table). All masks share one scan of the
references and one join per target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countflow.functions.common import bounded, repaired_id, repaired_state, table


def spans(target: DataFrame, keys: list[str], added: str = "added_at", removed: str = "removed_at") -> DataFrame:
    """The target reduced to one row per key with the spans in which the key exists."""
    return target.groupBy(*keys).agg(F.collect_set(F.struct(F.col(added).alias("a"), F.col(removed).alias("r"))).alias("_cf_spans"))


def _at(moment: Column) -> Column:
    """Whether one of the spans holds the moment; unknown moments lie in no span."""
    inside = F.exists("_cf_spans", lambda s: (s["a"] <= moment) & (s["r"].isNull() | (s["r"] > moment)))
    return F.coalesce(inside, F.lit(False))


def _held(target: DataFrame, keys: list[str], masks: list[int]) -> DataFrame:
    """The spans of the target's keys once for each mask, with null for the columns that the mask leaves out."""
    out = None
    for mask in masks:
        used = [k for i, k in enumerate(keys) if mask >> i & 1]
        part = spans(target.dropna(subset=used), used)
        part = part.select(F.lit(mask).alias("_cf_m"), *[(F.col(k) if k in used else F.lit(None).cast(target.schema[k].dataType)).alias(f"_cf_t_{k}") for k in keys], "_cf_spans")
        out = part if out is None else out.unionByName(part)
    return out


def orphans(refs: DataFrame, targets: dict[tuple[str, ...], DataFrame], at: str, match: str = "each") -> DataFrame:
    """References that no target holds, with `_field`, the column (or columns, joined by '+') that fail.

    targets maps key columns of refs to the table they refer to, whose key columns have
    the same names. Every reference gets the mask of its non-null key columns, and one join
    per target compares each mask on its own columns: `simple` checks the full mask only,
    `partial` every mask, `each` every non-null column by itself. A row whose keys are all
    null refers to nothing and is never an orphan. Values of refs are compared as they
    are, so repair them before.

    refs is scanned once. A target of proven size is broadcast, so a key that a third of
    all rows refer to needs no shuffle; a larger one is joined by shuffle, where AQE splits
    hot partitions. One row per mask and key means a join never multiplies rows.
    """
    if match == "each":
        targets = {(k,): target.select(k, "added_at", "removed_at") for keys, target in targets.items() for k in keys}
    rows, failed, names = refs, [], []
    for n, (keys, target) in enumerate(targets.items()):
        full = (1 << len(keys)) - 1
        masks = list(range(1, full + 1)) if match == "partial" else [full]
        mask = sum((F.when(F.col(k).isNotNull(), 1 << i).otherwise(0) for i, k in enumerate(keys)), F.lit(0))
        held, name = bounded(_held(target, list(keys), masks)), f"_cf_mask_{n}"
        rows = rows.withColumn(name, mask)
        same = F.col(name) == F.col("_cf_m")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_cf_t_{k}"))
        rows = rows.join(held, same, "left")
        missing = F.col(name).isin(masks) & ~_at(F.col(at))
        field = F.array_join(F.array_compact(F.array(*[F.when(F.col(name).bitwiseAND(1 << i) > 0, F.lit(k)) for i, k in enumerate(keys)])), "+")
        rows = rows.withColumn(f"_cf_fail_{n}", F.when(missing, field)).drop("_cf_m", "_cf_spans", *[f"_cf_t_{k}" for k in keys])
        failed.append(f"_cf_fail_{n}")
        names.append(name)
    rows = rows.filter(F.coalesce(*failed).isNotNull())
    return rows.withColumn("_field", F.explode(F.array_compact(F.array(*failed)))).drop(*failed, *names)


TABLES = ("versioned_results", "result_snapshots", "current_loads")


def _references(spark, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name).select("row_id", "received_at", repaired_id("geographic_unit_fips").alias("geographic_unit_fips"), repaired_state("postal_code").alias("postal_code"))


def _orphans_of(spark, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "baseline_units").select(repaired_id("geographic_unit_fips").alias("geographic_unit_fips"), "added_at", "removed_at")
    states = table(spark, sf_dir, "state_weights").select(repaired_state("postal_code").alias("postal_code"), "added_at", "removed_at")
    targets = {("geographic_unit_fips",): units, ("postal_code",): states}
    out = None
    for name in TABLES:
        part = orphans(_references(spark, sf_dir, name), targets, "received_at").withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def p5_found(spark, sf_dir: str) -> DataFrame:
    return _orphans_of(spark, sf_dir).select("table_name", "row_id", F.col("_field").alias("field"))


def orphan_counts(spark, sf_dir: str) -> DataFrame:
    """Orphan references per table, field and day of receipt (null where unknown)."""
    day = F.to_date("received_at").cast("string").alias("period")
    return _orphans_of(spark, sf_dir).groupBy("table_name", F.col("_field").alias("field"), day).agg(F.count(F.lit(1)).alias("n"))


def partial_counts(spark, sf_dir: str) -> DataFrame:
    """Orphans of the composite reference (state, unit) to the units, per table, non-null columns and day: a reference with one of both must match on that one."""
    units = table(spark, sf_dir, "baseline_units").select(repaired_id("geographic_unit_fips").alias("geographic_unit_fips"), repaired_state("postal_code").alias("postal_code"), "added_at", "removed_at")
    out = None
    for name in TABLES:
        part = orphans(_references(spark, sf_dir, name), {("postal_code", "geographic_unit_fips"): units}, "received_at", "partial").withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("table_name", F.col("_field").alias("field"), F.to_date("received_at").cast("string").alias("period")).agg(F.count(F.lit(1)).alias("n"))
