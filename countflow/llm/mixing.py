"""Problem 8: mixing sources to target weights, by weighted fair queueing.

The documents of each source are shuffled (by a hash) and queued. A document's virtual
finish time is the tokens of its source up to and including it, divided by the source's
target weight; a repeated pass continues the count. Taking documents by finish time serves
every source in proportion to its weight. The global order is cut at the total budget.

Both running sums, within a source and over the whole mix, are taken by counting buckets,
prefix-summing the few bucket totals and summing inside buckets, so that a source with a
third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countflow.functions.common import bounded, cut, table
from countflow.llm.tokens import VOCABULARY, source_name, with_sizes

#: Rows per bucket of the running sums (buckets follow from the number of rows), and the seed of the shuffle.
BUCKET_ROWS, SEED = 4_000, 20_24


def running_sum(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: str, name: str) -> DataFrame:
    """df with `name`, the exact sum of value over the rows of its keys up to and including it, by (bucket, order)."""
    df = df.withColumn("_b", bucket)
    sums = df.groupBy(*keys, "_b").agg(F.sum(value).alias("_v"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bounded(cut(sums.withColumn("_offset", F.coalesce(F.sum("_v").over(before), F.lit(0))).drop("_v")))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(offsets, [*keys, "_b"]).withColumn(name, F.sum(value).over(inside) + F.col("_offset")).drop("_b", "_offset")


def shuffled(c: str, seed: int = SEED) -> Column:
    """A seeded shuffle as a number: the first 60 bits of a hash that every SQL engine has."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(c).cast("string"))), 1, 15), 16, 10).cast("long")


def mix(sized: DataFrame, targets: DataFrame, budget_tokens: int | None = None, seed: int = SEED) -> DataFrame:
    """The drawn documents: (mix_id, source, doc_id, repeat_no, n_tokens, finish, upto_tokens).

    sized: doc_id, source (repaired), n_tokens. targets: mix_id, source, target_share,
    max_repeats. Sources that hold no tokens cannot be drawn; the shares of the others are
    scaled up to 1. Without a budget each mix gets the largest at which every source can
    meet its share within max_repeats. With a larger budget, sources that run out leave
    their place to the others, and the shares reached tell so. Documents of null source or
    without tokens are never drawn; rows repeated in the input count as documents each.
    """
    docs = cut(sized.filter((F.col("n_tokens") > 0) & F.col("source").isNotNull()).select("doc_id", "source", "n_tokens"))
    totals = docs.groupBy("source").agg(F.sum("n_tokens").alias("_total"), F.count(F.lit(1)).alias("_n"))
    per_mix = Window.partitionBy("mix_id")
    t = bounded(targets.filter((F.col("target_share") > 0) & (F.col("max_repeats") > 0))).join(totals, "source")
    t = t.withColumn("_weight", F.col("target_share") / F.sum("target_share").over(per_mix))
    most = F.min(F.col("max_repeats") * F.col("_total") / F.col("_weight")).over(per_mix)
    t = t.withColumn("_budget", F.lit(float(budget_tokens)) if budget_tokens is not None else most)
    t = cut(t.select("mix_id", "source", "max_repeats", "_total", "_weight", "_budget"))

    # Buckets are ranges of the hash (its top bits), about BUCKET_ROWS documents each.
    bits = max(1, min(20, (docs.count() // BUCKET_ROWS).bit_length()))
    buckets = 1 << bits
    docs = docs.withColumn("_h", shuffled("doc_id", seed))
    queued = running_sum(docs, ["source"], F.shiftrightunsigned("_h", 60 - bits), ["_h", "doc_id"], "n_tokens", "_upto").drop("_h")

    rows = queued.join(bounded(t), "source")
    # With exhausted sources virtual time runs ahead of served tokens, so no pass can be left out beforehand.
    reach = F.col("_budget") * F.col("_weight") if budget_tokens is None else F.col("max_repeats") * F.col("_total")
    passes = F.least(F.col("max_repeats").cast("double"), F.ceil((reach - F.col("_upto")) / F.col("_total") + 1.0) + 1.0)
    rows = rows.filter(passes >= 1).withColumn("repeat_no", F.explode(F.sequence(F.lit(1), passes.cast("int"))))
    finish = ((F.col("repeat_no") - 1) * F.col("_total") + F.col("_upto")) / F.col("_weight")
    rows = rows.withColumn("finish", finish)
    part = F.floor(F.least(F.col("finish") / F.col("_budget"), F.lit(1e9)) * buckets).cast("long")
    ranked = running_sum(rows, ["mix_id"], part, ["finish", "source", "doc_id", "repeat_no"], "n_tokens", "upto_tokens")
    return ranked.filter(F.col("upto_tokens") <= F.col("_budget")).select("mix_id", "source", "doc_id", "repeat_no", "n_tokens", "finish", "upto_tokens")


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and reached share of every source of every mix; sources that were not drawn have share 0."""
    got = drawn.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("draws"), F.max("repeat_no").alias("repeats"))
    all_ = bounded(targets).join(got, ["mix_id", "source"], "left")
    total = F.sum("tokens").over(Window.partitionBy("mix_id"))
    share = F.coalesce(F.col("tokens") / total, F.lit(0.0)).alias("reached_share")
    return all_.select("mix_id", "source", "target_share", share, F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("draws", F.lit(0)).alias("draws"), F.coalesce("repeats", F.lit(0)).alias("repeats"), "max_repeats")


def _sized(spark, sf_dir: str, vocabulary: str) -> DataFrame:
    return with_sizes(table(spark, sf_dir, "documents").select("doc_id", source_name().alias("source"), "text"), vocabulary)


def p8_mix(spark, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return mix(_sized(spark, sf_dir, vocabulary), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return shares(p8_mix(spark, sf_dir, vocabulary), table(spark, sf_dir, "mix_targets"))


def p8_by_characters(spark, sf_dir: str) -> DataFrame:
    """The same queues with sizes in characters, which SQL can count."""
    sized = table(spark, sf_dir, "documents").select("doc_id", source_name().alias("source"), F.length("text").cast("long").alias("n_tokens"))
    return mix(sized, table(spark, sf_dir, "mix_targets")).select("mix_id", "source", "doc_id", "repeat_no", F.col("n_tokens").alias("n_characters"), F.col("upto_tokens").alias("upto_characters"))


BY_CHARACTERS = f"""
with docs as (select doc_id, lower(translate(trim(source, ' '), '-', '_')) as source, length(text) as n, cast('0x' || substr(md5('{SEED}:' || doc_id), 1, 15) as bigint) as h
  from documents where length(text) > 0 and source is not null),
queue as (select *, sum(n) over (partition by source order by h, doc_id) as own, sum(n) over (partition by source) as total from docs),
targets as (select mix_id, source, max_repeats, total, target_share / sum(target_share) over (partition by mix_id) as weight
  from mix_targets join (select distinct source, total from queue) using (source) where target_share > 0 and max_repeats > 0),
budgets as (select *, min(max_repeats * total / weight) over (partition by mix_id) as budget from targets),
passes as (select b.mix_id, b.source, q.doc_id, r.repeat_no, q.n, ((r.repeat_no - 1) * q.total + q.own) / b.weight as finish, b.budget
  from budgets b join queue q using (source) join (select unnest(range(1, 1001)) as repeat_no) r on r.repeat_no <= b.max_repeats),
served as (select *, sum(n) over (partition by mix_id order by finish, source, doc_id, repeat_no) as upto from passes)
select mix_id, source, doc_id, cast(repeat_no as int) as repeat_no, n as n_characters, cast(upto as bigint) as upto_characters from served where upto <= budget
"""
