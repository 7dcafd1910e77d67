"""Mixing sources to target weights by Poisson replication, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from calorine.functions.session import partitions

#: Sources whose rates are sent as a broadcast table; more are joined by key.
BROADCAST_SOURCES = 10_000
#: A rate is drawn as the sum of so many equal draws that each stays below this, for exp(-rate) must stay a normal number.
RATE_STEP = 200.0
ALPHA, EPOCHS, SEED = 0.5, 1.0, "mix-1"


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from the parts' MD5."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_quantile(u: Column, rate: Column) -> Column:
    """The least k with u < CDF(k); a null or non-positive rate gives 0.

    The terms end where the tail is below the steps of `uniform`.
    """
    start = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("c"))
    step = lambda s, i: F.struct(F.when(u >= s["c"], i).otherwise(s["k"]).alias("k"), (s["p"] * rate / i).alias("p"), (s["c"] + s["p"] * rate / i).alias("c"))
    terms = F.ceil(rate + 9 * F.sqrt(rate) + 30).cast("int")
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), terms), start, step, lambda s: s["k"])).otherwise(F.lit(0))


def poisson_count(seed: str, key: Column, rate: Column) -> Column:
    """Poisson(rate) at the hash of seed and key: one draw, or the sum of equal ones where the rate is high.

    It depends on this rate alone, not on the rates of other sources.
    """
    draws = F.greatest(F.ceil(rate / F.lit(RATE_STEP)), F.lit(1)).cast("int")
    one = poisson_quantile(uniform(F.lit(seed), key), rate / draws)
    more = F.aggregate(F.sequence(F.lit(1), draws - 1), F.lit(0), lambda n, i: n + poisson_quantile(uniform(F.lit(seed), key, i), rate / draws))
    return F.when(rate > 0, one + F.when(draws > 1, more).otherwise(F.lit(0))).otherwise(F.lit(0))


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = EPOCHS, alpha: float = ALPHA) -> DataFrame:
    """(mix_source, rate) of all sources: target rows over rows present.

    Target weights are given by source (absent ones weigh nothing), or else
    proportional to rows ** alpha. Targets add up to `epochs` times all rows.
    """
    sizes = docs.groupBy(F.col("source").alias("mix_source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(alpha))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("mix_source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    sizes = sizes.withColumn("w", weight)
    all_of = sizes.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    return sizes.crossJoin(F.broadcast(all_of)).select("mix_source", (F.lit(epochs) * F.col("all_n") * F.col("w") / F.nullif(F.col("all_w"), F.lit(0.0)) / F.col("n")).alias("rate"))  # all_of is one row


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = EPOCHS, alpha: float = ALPHA, seed: str = SEED) -> DataFrame:
    """docs, each row repeated Poisson(rate of its source) times, in a global random order.

    The count inverts the distribution at a hash of seed and doc_id, so it does not
    depend on partitioning, and equal doc_ids (and null ones) draw equal counts.
    Columns of docs follow, then `mix_copy` (1, 2, ...) and `mix_key`, by which the
    result is dealt and sorted. Null is a source like any other; text is not looked
    at. An empty table gives an empty one.
    """
    extra = [c for c in ("mix_source", "rate", "mix_count", "mix_copy", "mix_key") if c in docs.columns]
    docs = docs.withColumnsRenamed({c: f"docs_{c}" for c in extra})
    rates = source_rates(docs, weights, epochs, alpha)
    first = rates.limit(BROADCAST_SOURCES + 1).collect()
    if len(first) > BROADCAST_SOURCES:
        joined = docs.join(rates, docs["source"].eqNullSafe(F.col("mix_source")))
    else:
        table = docs.sparkSession.createDataFrame([tuple(r) for r in first], rates.schema)
        joined = docs.join(F.broadcast(table), docs["source"].eqNullSafe(F.col("mix_source")))
    copies = joined.withColumn("mix_count", poisson_count(seed, F.col("doc_id"), F.col("rate"))).where("mix_count > 0")
    copies = copies.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_count"))))
    key = F.md5(F.concat_ws(":", F.lit(seed + "-order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("mix_copy").cast("string")))
    out = copies.drop("mix_source", "rate", "mix_count").withColumn("mix_key", key)
    return out.repartitionByRange(partitions(docs), "mix_key").sortWithinPartitions("mix_key")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
with sizes as (select source, count(*) as n, pow(cast(count(*) as double), {ALPHA}) as w from documents group by source),
rates as (select source, {EPOCHS} * sum(n) over () * w / sum(w) over () / n as rate from sizes),
ks as (select source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) as p from rates, range(0, 400) t(k)),
cdf as (select source, k, coalesce(sum(p) over (partition by source order by k rows between unbounded preceding and 1 preceding), 0) as lo, sum(p) over (partition by source order by k) as hi from ks),
draws as (select *, cast(cast('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id as varchar), 'null')), 1, 13) as bigint) as double) / 4503599627370496.0 as u from documents),
counts as (select d.doc_id, d.text, d.lang, d.source, d.n_chars, max(c.k) + 0 as k from draws d join cdf c on d.source is not distinct from c.source and d.u >= c.lo and d.u < c.hi group by all)
select doc_id, text, lang, source, n_chars, cast(i as integer) as mix_copy, md5('{SEED}-order:' || coalesce(cast(doc_id as varchar), 'null') || ':' || cast(i as varchar)) as mix_key
from counts, unnest(range(1, k + 1)) t(i)
"""
