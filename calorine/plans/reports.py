"""Reports of stages: each one aggregation of its rows, and the dictionary that is written as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def missing_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, missing) of all columns in one pass."""
    columns = columns or df.columns
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*columns))).alias("column_name", "missing"))


def extent(detections: DataFrame) -> DataFrame:
    """One row: bounds of place and time, NULL over nothing."""
    return detections.agg(F.min("latitude").alias("lat_min"), F.max("latitude").alias("lat_max"), F.min("longitude").alias("lon_min"), F.max("longitude").alias("lon_max"), F.min("acq_datetime").alias("start_utc"), F.max("acq_datetime").alias("end_utc"))


def quantiles(df: DataFrame, column: str) -> DataFrame:
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75), F.lit(0.95))).alias("q")
    return df.agg(F.count(column).alias("n"), F.min(column).alias("min"), q, F.max(column).alias("max"), F.avg(column).alias("mean")).select("n", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"), F.col("q")[3].alias("p95"), "max", "mean")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("UNKNOWN")).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def longest(events: DataFrame, n: int = 5) -> DataFrame:
    return events.orderBy(F.desc_nulls_last("observed_duration_hours"), "event_id").limit(n)


def sanity(scored: DataFrame) -> DataFrame:
    """(check_name, triggered, share): whether one feature rules the priorities alone; a check over no rows is not triggered."""
    p = F.col("investigation_priority")
    share = lambda rows, good: F.avg(F.when(rows, good.cast("double")))
    rules: list[tuple[str, Column, Column]] = [
        ("within_facility_all_critical", share(F.col("facility_association_method") == "WITHIN_FACILITY", p == "CRITICAL"), F.lit(0.95)),
        ("no_facility_all_low", share(F.col("facility_association_method") == "NO_FACILITY_ASSOCIATION", p == "LOW"), F.lit(1.0)),
        ("persistent_all_critical", share(F.col("persistence_label") == "PERSISTENT", p == "CRITICAL"), F.lit(0.95)),
        ("missing_sta_all_low", share(~F.coalesce("sta_evidence_available", F.lit(False)), p == "LOW"), F.lit(0.98)),
    ]
    found = scored.agg(*[s.alias(n) for n, s, _ in rules], F.count_distinct("risk_score").alias("values"), F.max(F.col("risk_score").isNull().cast("int")).alias("none"))
    rows = [F.struct(F.lit(n).alias("check_name"), F.coalesce((F.col(n) >= most) if n == "no_facility_all_low" else (F.col(n) > most), F.lit(False)).alias("triggered"), F.col(n).alias("share")) for n, _, most in rules]
    few = F.col("values") + F.coalesce("none", F.lit(0)) <= 3
    rows.append(F.struct(F.lit("risk_score_near_constant").alias("check_name"), few.alias("triggered"), F.lit(None).cast("double").alias("share")))
    return found.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def same_keys(before: DataFrame, after: DataFrame, key: str = "event_id") -> DataFrame:
    """One row: keys lost, gained and doubled between a stage's input and its output; all 0 where it keeps its events."""
    sides = before.select(F.col(key).alias("k"), F.lit(1).alias("b"), F.lit(0).alias("a")).union(after.select(key, F.lit(0), F.lit(1)))
    per = sides.groupBy("k").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    return per.agg(F.count_if((F.col("b") > 0) & (F.col("a") == 0)).alias("lost"), F.count_if((F.col("b") == 0) & (F.col("a") > 0)).alias("gained"), F.count_if(F.col("a") > 1).alias("doubled"))


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def only_first(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]  # a few rows of an aggregation


def preprocessing_report(raw: DataFrame, pattern: str = "yyyy-MM-dd") -> dict:
    from calorine.plans import clean

    kept = clean.clean(raw, pattern)
    return {"counts": _rows(clean.quality_counts(raw, pattern))[0], "extent": _rows(extent(kept))[0], "confidence": _rows(value_counts(kept, "confidence")), "daynight": _rows(value_counts(kept, "daynight")), "missing": _rows(missing_values(kept))}


def association_report(associated: DataFrame) -> dict:
    from calorine.plans import association

    return {"methods": _rows(value_counts(associated, "facility_association_method")), "confidence": _rows(value_counts(associated, "facility_attribution_confidence")), "candidates": _rows(association.candidate_histogram(associated)), "distance": _rows(quantiles(associated, "facility_distance_km"))[0]}


def fingerprint_report(made: DataFrame) -> dict:
    return {"statuses": _rows(value_counts(made, "baseline_history_status")), "events": _rows(quantiles(made, "event_count"))[0], "peak_frp": _rows(quantiles(made, "peak_frp_median"))[0]}


def persistence_report(events: DataFrame) -> dict:
    return {"labels": _rows(value_counts(events, "persistence_label")), "durations": _rows(quantiles(events, "observed_duration_hours"))[0], "longest": _rows(longest(events).select("event_id", "observed_duration_hours"))}


def risk_report(scored: DataFrame) -> dict:
    from calorine.plans import risk

    checks = _rows(sanity(scored))
    return {"priorities": _rows(value_counts(scored, "investigation_priority")), "context": _rows(risk.crosstab(scored)), "uncertainty": _rows(risk.token_tallies(scored)), "risk": _rows(risk.distribution(scored))[0], "checks": checks, "status": "ATTENTION" if any(c["triggered"] for c in checks) else "OK"}


def missing_source(stage: str, paths: list[str]) -> dict:
    """The report of a stage whose source is not there: it says so and makes up nothing."""
    return {"stage": stage, "status": "SOURCE_UNAVAILABLE", "searched": paths, "matched_events": None}
