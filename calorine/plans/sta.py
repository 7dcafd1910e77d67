"""Static-anomaly evidence: layers of polygons and detections around events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from calorine.functions.geo import distance, intersects
from calorine.functions.parsing import hours
from calorine.plans.association import event_geometry, met, planar


@dataclass(frozen=True)
class StaConfig:
    radius_km: float = 1.0
    tolerance_km: float = 0.1
    near_hours: float = 24.0
    max_candidates: int = 20
    cell_m: float = 5_000.0


def temporal_relation(layer: Column, observed: Column, start: Column, end: Column, near_hours: float) -> Column:
    gap = F.least(F.abs(hours(start, observed)), F.abs(hours(end, observed)))
    missing = observed.isNull() | start.isNull() | end.isNull()
    return F.when(layer == "MASK", "NOT_APPLICABLE").when(missing, "UNKNOWN").when(observed.between(start, end), "SAME_PERIOD").when(gap <= near_hours, "NEAR_EVENT_TIME").otherwise("OUTSIDE_EVENT_PERIOD")


def candidates(events: DataFrame, layers: DataFrame, config: StaConfig = StaConfig()) -> DataFrame:
    """Ranked pairs up to the cap. layers: sta_id, sta_layer_type, geometry_type, rings, observation_datetime."""
    e = event_geometry(events).select("event_id", "event_start", "event_end", "foot_edges", "foot_areal", "cx", "cy", F.col("foot_w").alias("l_w"), F.col("foot_s").alias("l_s"), F.col("foot_e").alias("l_e"), F.col("foot_n").alias("l_n"))
    s = planar(layers, "rings", F.col("geometry_type"), "sta").select("sta_id", "sta_layer_type", "observation_datetime", "sta_edges", "sta_areal", F.col("sta_w").alias("r_w"), F.col("sta_e").alias("r_e"), F.col("sta_s").alias("r_s"), F.col("sta_n").alias("r_n"))
    pairs = met(e, s, config.radius_km * 1000, config.cell_m)
    hit = intersects(F.col("foot_edges"), F.col("foot_areal"), F.col("sta_edges"), F.col("sta_areal"))
    to = distance(F.col("cx"), F.col("cy"), F.col("sta_edges"), F.col("sta_areal"))
    pairs = pairs.withColumns({"hit": hit, "distance_km": to / 1000}).where(F.col("hit") | (F.col("distance_km") <= config.radius_km))
    relation = F.when(F.col("hit"), "INTERSECTS").otherwise("NEAR")
    when = temporal_relation(F.col("sta_layer_type"), F.col("observation_datetime"), F.col("event_start"), F.col("event_end"), config.near_hours)
    pairs = pairs.select("event_id", "sta_id", "sta_layer_type", relation.alias("spatial_relation"), "distance_km", when.alias("temporal_relation"))
    w = Window.partitionBy("event_id").orderBy(F.when(F.col("spatial_relation") == "INTERSECTS", 0).otherwise(1), "distance_km", F.when(F.col("sta_layer_type") == "MASK", 0).otherwise(1), "sta_id")
    return pairs.withColumn("candidate_rank", F.row_number().over(w)).where(F.col("candidate_rank") <= config.max_candidates)


def evidence(events: DataFrame, layers: DataFrame, config: StaConfig = StaConfig()) -> DataFrame:
    """events with status, quality, nearest distance and match count (after the cap)."""
    at = lambda c, k: F.max(F.when(F.col("candidate_rank") == k, F.col(c)))
    g = candidates(events, layers, config).groupBy("event_id").agg(F.count(F.lit(1)).cast("int").alias("sta_match_count"), *[at(c, 1).alias(c) for c in ("sta_id", "sta_layer_type", "spatial_relation", "distance_km", "temporal_relation")], at("spatial_relation", 2).alias("r2"), at("distance_km", 2).alias("d2"))
    unclear = F.coalesce((F.col("r2") == F.col("spatial_relation")) & (F.abs(F.col("d2") - F.col("distance_km")) <= config.tolerance_km), F.lit(False))
    quality = F.when(unclear, "LOW").when(F.col("spatial_relation") == "INTERSECTS", "HIGH").when(F.col("distance_km") <= 0.5 * config.radius_km, "MEDIUM").otherwise("LOW")
    own = lambda c: F.when(~unclear, F.col(c))
    g = g.select("event_id", "sta_match_count", F.when(unclear, "AMBIGUOUS").otherwise("STA_ASSOCIATED").alias("sta_association_status"), quality.alias("sta_evidence_quality"), own("sta_id").alias("sta_id"), own("sta_layer_type").alias("sta_layer_type"), own("spatial_relation").alias("sta_spatial_relation"), own("temporal_relation").alias("sta_temporal_relation"), F.col("distance_km").alias("sta_nearest_distance_km"))
    out = events.join(g, "event_id", "left")
    return out.withColumns({"sta_match_count": F.coalesce("sta_match_count", F.lit(0)), "sta_association_status": F.coalesce("sta_association_status", F.lit("NO_STA_ASSOCIATION")), "sta_evidence_quality": F.coalesce("sta_evidence_quality", F.lit("NONE")), "sta_evidence_available": F.col("sta_id").isNotNull()})


def normalize(layer: DataFrame, layer_type: str, id_columns: tuple[str, ...] = ("id", "sta_id", "objectid"), time_columns: tuple[str, ...] = ("observation_datetime", "datetime", "date")) -> DataFrame:
    """A raw layer (rings, geometry_type, any columns) in canonical form, with is_valid and rejection_reason."""
    from calorine.functions.parsing import first_present, sta_id, to_utc

    have = {c.lower(): c for c in layer.columns}
    native = first_present(*[have[c] for c in id_columns if c in have]) if any(c in have for c in id_columns) else F.lit(None).cast("string")
    observed = F.coalesce(*[to_utc(have[c]) for c in time_columns if c in have], F.lit(None).cast("timestamp"))
    reason = F.when(F.col("rings").isNull(), "null_geometry").when(F.size("rings") == 0, "empty_geometry").when(~F.upper("geometry_type").isin("POINT", "POLYGON", "MULTIPOLYGON", "MULTIPOINT"), "unsupported_geometry_type")
    made = layer.withColumns({"sta_layer_type": F.lit(layer_type), "observation_datetime": observed, "sta_id": sta_id(F.lit(layer_type), native, F.to_json(F.struct("rings"))), "rejection_reason": reason})
    return made.withColumn("is_valid", F.col("rejection_reason").isNull())
