"""Event formation: clusters of detections to one row per event, and persistence labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from calorine.functions.parsing import hours, require_columns
from calorine.operators.stdbscan import ClusterConfig, cluster, numbered

DETECTION_COLUMNS = ("det_id", "latitude", "longitude", "acq_datetime", "frp", "frp_valid", "bright_ti4", "bright_ti5", "confidence", "daynight")


def form(detections: DataFrame, config: ClusterConfig = ClusterConfig()) -> tuple[DataFrame, DataFrame]:
    """(labelled detections with event_id, noise with neighbour count and reason)."""
    require_columns(detections, DETECTION_COLUMNS)
    found = cluster(detections, config)
    labelled = found.where("cluster is not null").join(numbered(found).hint("merge"), "cluster").drop("cluster")  # not broadcast: there are as many as events
    n = F.col("spatiotemporal_neighbor_count")
    alone = F.format_string("no neighbour within %.1f km and %.1f h", F.lit(config.eps_km), F.lit(config.eps_hours))
    few = F.format_string("%d in the neighbourhood, below the minimum of %d", n, F.lit(config.min_samples))
    noise = found.where("cluster is null").drop("cluster").withColumn("noise_reason", F.when(n <= 1, alone).otherwise(few))
    return labelled, noise


def features(labelled: DataFrame) -> DataFrame:
    """One row per event_id: place, time, power, brightness and class counts. Power statistics use valid rows only.

    Sums run over an event's rows in their order of time, in one go: a count of distinct days or a median among the
    aggregates would part them, and the last bits of means would depend on how.
    """
    w = Window.partitionBy("event_id").orderBy("acq_datetime", "det_id")
    gap = hours(F.lag("acq_datetime").over(w), F.col("acq_datetime"))
    power = F.when(F.col("frp_valid"), F.col("frp"))
    day = F.to_date("acq_datetime")
    rows = labelled.withColumns({"gap": gap, "p": power, "new_day": day.isNotNull() & ~day.eqNullSafe(F.lag(day).over(w))})
    of_event = Window.partitionBy("event_id")
    rows = rows.withColumn("p_median", F.median("p").over(of_event))
    rows = rows.withColumn("p_mad", F.median(F.abs(F.col("p") - F.col("p_median"))).over(of_event))
    conf = F.lower("confidence")
    t0, t1 = F.min("acq_datetime"), F.max("acq_datetime")
    dur = hours(t0, t1)
    return rows.groupBy("event_id").agg(
        F.count(F.lit(1)).cast("int").alias("detection_count"),
        F.avg("latitude").alias("centroid_latitude"),
        F.avg("longitude").alias("centroid_longitude"),
        F.min("latitude").alias("min_latitude"),
        F.max("latitude").alias("max_latitude"),
        F.min("longitude").alias("min_longitude"),
        F.max("longitude").alias("max_longitude"),
        t0.alias("event_start"),
        t1.alias("event_end"),
        dur.alias("observed_duration_hours"),
        F.count_if("new_day").cast("int").alias("distinct_detection_days"),
        F.avg("gap").alias("mean_gap_hours"),
        F.max("gap").alias("max_gap_hours"),
        F.when(dur > 0, F.count(F.lit(1)) / (dur / 24)).alias("detection_frequency_per_day"),
        F.max("p").alias("peak_frp"),
        F.avg("p").alias("mean_frp"),
        F.first("p_median").alias("median_frp"),
        F.stddev_pop("p").alias("frp_std"),
        F.first("p_mad").alias("frp_mad"),
        F.sum("p").alias("total_frp"),
        F.count("p").cast("int").alias("frp_valid_count"),
        F.max("bright_ti4").alias("max_bright_ti4"),
        F.avg("bright_ti4").alias("mean_bright_ti4"),
        F.max("bright_ti5").alias("max_bright_ti5"),
        F.avg("bright_ti5").alias("mean_bright_ti5"),
        F.count_if(F.col("daynight") == "D").cast("int").alias("day_detection_count"),
        F.count_if(F.col("daynight") == "N").cast("int").alias("night_detection_count"),
        F.count_if(conf == "n").cast("int").alias("nominal_confidence_count"),
        F.count_if(conf == "l").cast("int").alias("low_confidence_count"),
        F.count_if(conf == "h").cast("int").alias("high_confidence_count"),
    )


def confidence_distribution(labelled: DataFrame) -> DataFrame:
    """(event_id, confidence_distribution): counts by non-null confidence."""
    counts = labelled.where("confidence is not null").groupBy("event_id", "confidence").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("event_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("confidence", "n")))).alias("confidence_distribution"))


def hull(x: np.ndarray, y: np.ndarray) -> list[tuple[float, float]]:
    """Convex hull by the monotone chain, counter-clockwise; collinear points give their two ends."""
    points = sorted(set(zip(x.tolist(), y.tolist(), strict=True)))
    if len(points) < 3:
        return points
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    sides = []
    for order in (points, points[::-1]):
        side: list[tuple[float, float]] = []
        for p in order:
            while len(side) > 1 and turn(side[-2], side[-1], p) <= 0:
                side.pop()
            side.append(p)
        sides.append(side[:-1])
    return sides[0] + sides[1]


def _outline(places: list[dict]) -> str:
    h = hull(*(np.array([p[c] for p in places]) for c in ("x", "y")))
    text = ", ".join(f"{a!r} {b!r}" for a, b in (h + h[:1] if len(h) > 2 else h))
    return f"POINT ({text})" if len(h) == 1 else f"LINESTRING ({text})" if len(h) == 2 else f"POLYGON (({text}))"


def shapes(labelled: DataFrame) -> DataFrame:
    """(event_id, centroid_latitude, centroid_longitude, centroid_wkt, footprint_wkt): a point, a line or the hull of the event's distinct places.

    Distinct places are gathered per event, which bounds a row by the event's sites, not its detections.
    Everything comes from one aggregation, and hulls from a scan of its rows: a pandas group for each event takes minutes for a million of them.
    """
    place = F.struct(F.col("longitude").alias("x"), F.col("latitude").alias("y"))
    centre = F.concat(F.lit("POINT ("), F.avg("longitude").cast("string"), F.lit(" "), F.avg("latitude").cast("string"), F.lit(")"))
    rows = labelled.groupBy("event_id").agg(F.avg("latitude").alias("centroid_latitude"), F.avg("longitude").alias("centroid_longitude"), centre.alias("centroid_wkt"), F.collect_set(place).alias("places"))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([_outline(p) for p in b.column("places").to_pylist()], pa.string())
            kept = b.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), made], names=[*kept, "footprint_wkt"])

    return rows.mapInArrow(drawn, "event_id string, centroid_latitude double, centroid_longitude double, centroid_wkt string, footprint_wkt string")


def footprints(labelled: DataFrame) -> DataFrame:
    """(event_id, centroid_wkt, footprint_wkt) of shapes."""
    return shapes(labelled).select("event_id", "centroid_wkt", "footprint_wkt")


@dataclass(frozen=True)
class PersistenceConfig:
    min_detections: int = 3
    short_hours: float = 48.0
    duty_cycle: float = 0.85
    gap_hours: float = 24.0


def persistence(events: DataFrame, config: PersistenceConfig = PersistenceConfig()) -> DataFrame:
    """events with span_days, duty_cycle, persistence_label and persistence_basis."""
    require_columns(events, ("event_id", "detection_count", "event_start", "event_end", "observed_duration_hours", "distinct_detection_days", "max_gap_hours"))
    span = F.datediff(F.to_date("event_end"), F.to_date("event_start")) + 1
    duty = F.least(F.col("distinct_detection_days") / F.col("span_days"), F.lit(1.0))
    few = F.col("detection_count") < config.min_detections
    short = F.col("observed_duration_hours") <= config.short_hours
    steady = (F.col("duty_cycle") >= config.duty_cycle) | F.coalesce(F.col("max_gap_hours") <= config.gap_hours, F.lit(False))
    label = F.when(few, "INSUFFICIENT_OBSERVATIONS").when(short, "SHORT_LIVED").when(steady, "PERSISTENT").otherwise("RECURRING")
    basis = F.when(few, F.format_string("%d detections, below %d", F.col("detection_count"), F.lit(config.min_detections))).when(short, F.format_string("%.2f h observed", F.col("observed_duration_hours"))).otherwise(F.format_string("duty cycle %.2f, longest gap %.2f h", F.col("duty_cycle"), F.coalesce("max_gap_hours", F.lit(0.0))))
    return events.withColumn("span_days", span).withColumn("duty_cycle", duty).withColumn("persistence_label", label).withColumn("persistence_basis", basis)
