"""Cleaning of raw detections: every column arrives as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from calorine.functions.parsing import MISSING_NUMBER, acquired, is_missing, normal_confidence, normal_daynight, require_columns, to_double

RAW_COLUMNS = ("latitude", "longitude", "bright_ti4", "scan", "track", "acq_date", "acq_time", "satellite", "instrument", "confidence", "version", "bright_ti5", "frp", "daynight", "type")
NUMERIC_COLUMNS = ("latitude", "longitude", "bright_ti4", "scan", "track", "bright_ti5", "frp", "version", "type")
DATE_PATTERNS = ("yyyy-MM-dd", "dd-MM-yyyy")


def detect_date_pattern(raw: DataFrame, column: str = "acq_date", least: float = 0.99) -> str:
    """The date pattern that parses at least `least` of all non-blank dates."""
    rates = raw.where(~is_missing(column)).agg(*[F.avg(F.try_to_timestamp(F.trim(column), F.lit(p)).isNotNull().cast("double")).alias(f"p{i}") for i, p in enumerate(DATE_PATTERNS)]).first()
    for p, rate in zip(DATE_PATTERNS, rates, strict=True):
        if rate is not None and rate >= least:
            return p
    raise ValueError(f"{column} fits no known date pattern")


def frp_valid(c: Column) -> Column:
    return F.coalesce(c >= 0, F.lit(False))


def annotate(raw: DataFrame, pattern: str = "yyyy-MM-dd") -> DataFrame:
    """Typed columns and the flags coords_valid, time_valid, is_duplicate (first row by input order kept).

    Duplicates are judged after normalisation, NULL equal to NULL; input order is
    `row_no` where given, else a hash of the row.
    """
    require_columns(raw, RAW_COLUMNS)
    typed = raw.withColumns({c: to_double(c) for c in NUMERIC_COLUMNS} | {f"missing_{c}": is_missing(c, MISSING_NUMBER) for c in NUMERIC_COLUMNS})
    typed = typed.withColumns({"confidence": normal_confidence("confidence"), "daynight": normal_daynight("daynight"), "acq_datetime": acquired("acq_date", "acq_time", pattern)})
    typed = typed.withColumns({"coords_valid": F.coalesce(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180), F.lit(False)), "time_valid": F.col("acq_datetime").isNotNull(), "frp_valid": frp_valid(F.col("frp"))})
    order = "row_no" if "row_no" in raw.columns else F.xxhash64(*RAW_COLUMNS)
    return typed.withColumn("is_duplicate", F.row_number().over(Window.partitionBy(*RAW_COLUMNS).orderBy(order)) > 1)


def clean(raw: DataFrame, pattern: str | None = "yyyy-MM-dd") -> DataFrame:
    """Detections with valid place and time, without exact duplicates, and derived calendar columns.

    Without a pattern, the one that the dates fit is taken, by one pass over them.
    """
    kept = annotate(raw, pattern or detect_date_pattern(raw)).where("coords_valid and time_valid and not is_duplicate")
    t = F.col("acq_datetime")
    kept = kept.withColumns({"hour_utc": F.hour(t), "day_of_week": F.weekday(t), "month": F.month(t), "day_of_year": F.dayofyear(t)})
    return kept.drop(*[f"missing_{c}" for c in NUMERIC_COLUMNS], "coords_valid", "time_valid", "is_duplicate")


def quality_counts(raw: DataFrame, pattern: str = "yyyy-MM-dd") -> DataFrame:
    """One row of counters: missing and non-numeric by column, power, place, time, duplicates, rows kept."""
    a = annotate(raw, pattern)
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    aggs = [F.count(F.lit(1)).alias("rows_in")]
    for c in NUMERIC_COLUMNS:
        aggs += [count(F.col(f"missing_{c}")).alias(f"{c}_missing"), count(~F.col(f"missing_{c}") & F.col(c).isNull()).alias(f"{c}_invalid")]
    aggs += [count(F.col("frp") < 0).alias("frp_negative"), count(F.col("frp").between(0, 0.999999999)).alias("frp_valid_low"), count(F.col("frp_valid")).alias("frp_valid_rows")]
    aggs += [count(~F.col("coords_valid")).alias("coords_invalid"), count(~F.col("time_valid")).alias("time_invalid"), count(F.col("is_duplicate")).alias("duplicates")]
    aggs += [count(F.col("coords_valid") & F.col("time_valid") & ~F.col("is_duplicate")).alias("rows_out")]
    return a.agg(*aggs)
