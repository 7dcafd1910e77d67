"""Events and facilities: a grid-cell spatial join, ranks, and the choice with explicit ambiguity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from calorine.functions.geo import areal_type, cells, distance, edges, inside, intersects, parse_wkt, projected, wkt_type
from calorine.functions.session import let_go, saved

METHODS = ("WITHIN_FACILITY", "INTERSECTS_FACILITY", "NEAR_FACILITY")


@dataclass(frozen=True)
class AssociationConfig:
    radius_km: float = 5.0
    tolerance_km: float = 0.5
    max_candidates: int = 10
    cell_m: float = 10_000.0


def planar(df: DataFrame, rings: str, kind: Column, prefix: str) -> DataFrame:
    """df with projected edges, an areal flag and the bounding box of a ring column."""
    p = projected(F.col(rings))
    df = df.withColumn(f"{prefix}_edges", edges(p)).withColumn(f"{prefix}_areal", areal_type(kind))
    xs = lambda k: F.flatten(F.transform(f"{prefix}_edges", lambda e: F.array(e[f"a{k}"], e[f"b{k}"])))
    return df.withColumns({f"{prefix}_w": F.array_min(xs("x")), f"{prefix}_e": F.array_max(xs("x")), f"{prefix}_s": F.array_min(xs("y")), f"{prefix}_n": F.array_max(xs("y"))})


def event_geometry(events: DataFrame) -> DataFrame:
    """events with planar footprints and centroids: footprint, else centroid_wkt, else the centroid's coordinates."""
    point = F.array(F.array(F.struct(F.col("centroid_longitude").cast("double").alias("x"), F.col("centroid_latitude").cast("double").alias("y"))))
    foot = F.coalesce(parse_wkt(F.col("footprint_wkt")), parse_wkt(F.col("centroid_wkt")), point)
    centre = F.coalesce(parse_wkt(F.col("centroid_wkt")), point)
    kind = F.when(parse_wkt(F.col("footprint_wkt")).isNotNull(), wkt_type(F.col("footprint_wkt"))).otherwise("POINT")
    df = planar(events.withColumns({"foot_rings": foot, "centre_rings": centre}), "foot_rings", kind, "foot")
    centre_edge = F.get(edges(projected(F.col("centre_rings"))), F.lit(0))
    return df.withColumns({"cx": centre_edge["ax"], "cy": centre_edge["ay"]}).drop("foot_rings", "centre_rings")


def met(left: DataFrame, right: DataFrame, reach_m: float, cell_m: float) -> DataFrame:
    """Rows of left (l_w, l_s, l_e, l_n) and right (r_*) whose boxes come within reach, each pair once.

    Both sides are dealt to the grid cells they cover and joined on the cell; a pair
    is kept in the cell of its boxes' common lower corner only, so no distinct is needed.
    Boxes of right are grown by the reach, as it mostly has the fewer and lighter rows, and left goes to its own cells only.
    Spark takes the rings of right for a few bytes, so this is a merge, never a broadcast.
    """
    grow = F.lit(reach_m)
    a = left.withColumn("cell", F.explode(cells(F.col("l_w"), F.col("l_s"), F.col("l_e"), F.col("l_n"), cell_m)))
    b = right.withColumn("cell", F.explode(cells(F.col("r_w") - grow, F.col("r_s") - grow, F.col("r_e") + grow, F.col("r_n") + grow, cell_m)))
    both = a.join(b.hint("merge"), "cell")
    overlap = (F.col("r_w") <= F.col("l_e") + grow) & (F.col("r_e") >= F.col("l_w") - grow) & (F.col("r_s") <= F.col("l_n") + grow) & (F.col("r_n") >= F.col("l_s") - grow)
    first = (F.col("cell.cx") == F.floor(F.greatest(F.col("r_w") - grow, "l_w") / cell_m)) & (F.col("cell.cy") == F.floor(F.greatest(F.col("r_s") - grow, "l_s") / cell_m))
    return both.where(overlap & first).drop("cell")


def candidates(events: DataFrame, facilities: DataFrame, config: AssociationConfig = AssociationConfig()) -> DataFrame:
    """Pairs (event_id, facility_id, facility_name, facility_type, geometry_type, distance_km, spatial_relation, candidate_rank, candidate_score).

    facilities: facility_id, facility_name, facility_type, geometry_type, rings. A facility is a
    candidate when the centroid lies within it, the footprint meets it, or the
    centroid is within the radius of it. Both sides are written to the shared folder: filters on boxes
    and cells would repeat their whole geometry in the plan otherwise, which the driver has to hold.
    """
    e = event_geometry(events).select("event_id", "foot_edges", "foot_areal", "cx", "cy", F.least("foot_w", "cx").alias("l_w"), F.least("foot_s", "cy").alias("l_s"), F.greatest("foot_e", "cx").alias("l_e"), F.greatest("foot_n", "cy").alias("l_n"))
    f = planar(facilities, "rings", F.col("geometry_type"), "fac").select("facility_id", "facility_name", "facility_type", "geometry_type", "fac_edges", "fac_areal", F.col("fac_w").alias("r_w"), F.col("fac_s").alias("r_s"), F.col("fac_e").alias("r_e"), F.col("fac_n").alias("r_n"))
    e, f = saved(e, "association-events"), saved(f, "association-facilities")
    let_go(events.sparkSession)
    pairs = met(e, f, config.radius_km * 1000, config.cell_m)
    d = distance(F.col("cx"), F.col("cy"), F.col("fac_edges"), F.col("fac_areal"))
    edge = F.array_min(F.transform("fac_edges", lambda s: F.sqrt(F.pow(s["ax"] - F.col("cx"), F.lit(2)) + F.pow(s["ay"] - F.col("cy"), F.lit(2)))))
    within = F.when(F.col("fac_areal"), inside(F.col("cx"), F.col("cy"), F.col("fac_edges"), F.col("fac_areal"))).otherwise(edge == 0)
    pairs = pairs.withColumns({"d": d, "within": within, "meets": intersects(F.col("foot_edges"), F.col("foot_areal"), F.col("fac_edges"), F.col("fac_areal"))})
    kept = pairs.where(F.col("within") | F.col("meets") | (F.col("d") <= config.radius_km * 1000))
    relation = F.when(F.col("within"), "WITHIN").when(F.col("meets"), "INTERSECTS").otherwise("NEAR")
    return ranked(kept.select("event_id", "facility_id", "facility_name", "facility_type", "geometry_type", (F.col("d") / 1000).alias("distance_km"), relation.alias("spatial_relation")))


def tier(relation: Column) -> Column:
    return F.when(relation == "WITHIN", 0).when(relation == "INTERSECTS", 1).otherwise(2)


def ranked(pairs: DataFrame) -> DataFrame:
    t = tier(F.col("spatial_relation"))
    point = F.when(areal_type(F.col("geometry_type")), 0).otherwise(1)
    w = Window.partitionBy("event_id").orderBy(t, "distance_km", point, "facility_type", "facility_id")
    return pairs.withColumns({"candidate_rank": F.row_number().over(w), "candidate_score": (2 - t) * 10_000.0 - F.col("distance_km")})


def select(pairs: DataFrame, config: AssociationConfig = AssociationConfig()) -> DataFrame:
    """(event_id, facility columns, method, confidence, distance, candidate count and ids): one row per event with candidates."""
    at = lambda c, k: F.max(F.when(F.col("candidate_rank") == k, F.col(c)))
    g = pairs.withColumn("t", tier(F.col("spatial_relation"))).groupBy("event_id").agg(
        F.count(F.lit(1)).cast("int").alias("facility_candidate_count"),
        F.array_join(F.array_sort(F.collect_list("facility_id")), ",").alias("candidate_facility_ids"),
        *[at(c, 1).alias(c) for c in ("facility_id", "facility_name", "facility_type", "spatial_relation", "distance_km", "t")],
        at("t", 2).alias("t2"),
        at("distance_km", 2).alias("d2"),
    )
    unclear = F.coalesce((F.col("t2") == F.col("t")) & (F.abs(F.col("d2") - F.col("distance_km")) <= config.tolerance_km), F.lit(False))
    confidence = F.when(unclear, "LOW").when(F.col("t") < 2, "HIGH").when(F.col("facility_candidate_count") == 1, "MEDIUM").otherwise("LOW")
    own = lambda c: F.when(~unclear, F.col(c))
    return g.select("event_id", own("facility_id").alias("facility_id"), own("facility_name").alias("facility_name"), own("facility_type").alias("facility_type"), F.when(unclear, "AMBIGUOUS").otherwise(F.concat("spatial_relation", F.lit("_FACILITY"))).alias("facility_association_method"), confidence.alias("facility_attribution_confidence"), F.bround(own("distance_km"), 6).alias("facility_distance_km"), "facility_candidate_count", "candidate_facility_ids")


def associate(events: DataFrame, facilities: DataFrame, config: AssociationConfig = AssociationConfig()) -> tuple[DataFrame, DataFrame]:
    """(events with eight facility columns, candidates up to the cap); every event is kept. Lists of candidates can be long, so they are not broadcast."""
    pairs = candidates(events, facilities, config)
    out = events.join(select(pairs, config).hint("merge"), "event_id", "left").withColumns({"facility_association_method": F.coalesce("facility_association_method", F.lit("NO_FACILITY_ASSOCIATION")), "facility_attribution_confidence": F.coalesce("facility_attribution_confidence", F.lit("NONE")), "facility_candidate_count": F.coalesce("facility_candidate_count", F.lit(0))})
    return out, pairs.where(F.col("candidate_rank") <= config.max_candidates)


def candidate_histogram(associated: DataFrame) -> DataFrame:
    n = F.col("facility_candidate_count")
    bucket = F.when(n == 0, "0").when(n == 1, "1").when(n <= 5, "2-5").when(n <= 10, "6-10").when(n <= 50, "11-50").when(n <= 200, "51-200").otherwise("201+")
    return associated.groupBy(bucket.alias("candidates")).agg(F.count(F.lit(1)).alias("events"))
