"""Environmental context: land cover at a place, and vector layers around a footprint."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from calorine.functions.geo import distance, inside, raster_cell
from calorine.plans.association import event_geometry, met, planar


@dataclass(frozen=True)
class ContextConfig:
    local_km: float = 1.0
    broad_km: float = 5.0
    cell_m: float = 10_000.0
    slabs: int = 128


def landcover_raster(events: DataFrame, pixels: DataFrame, x0: float, y0: float, dx: float, dy: float, nodata: float | None = None, classes: dict[int, str] | None = None) -> DataFrame:
    """events with dominant_landcover_class from pixels(row, col, value); outside or nodata: unavailable."""
    row, col = raster_cell(F.col("centroid_longitude"), F.col("centroid_latitude"), x0, y0, dx, dy)
    px = pixels.where(F.col("value") != nodata) if nodata is not None else pixels
    out = events.withColumns({"row": row, "col": col}).join(px, ["row", "col"], "left").drop("row", "col")
    code = F.when(F.col("value") == F.floor("value"), F.col("value").cast("long").cast("string")).otherwise(F.col("value").cast("string"))
    name = code
    for k, v in (classes or {}).items():
        name = F.when(code == str(k), F.lit(v)).otherwise(name)
    seen = F.col("value").isNotNull()
    return out.withColumns({"landcover_available": seen, "dominant_landcover_class": name, "landcover_fraction": F.when(seen, 1.0), "landcover_class_count": F.when(seen, 1)}).drop("value")


def satellite(events: DataFrame, pixels: DataFrame | None, x0: float = 0.0, y0: float = 0.0, dx: float = 1.0, dy: float = 1.0, nodata: float | None = None, source: str = "local_satellite_context") -> DataFrame:
    """events with the value of a satellite raster at their centroid; outside, nodata or no raster: not available, NULL."""
    if pixels is None:
        seen, out = F.lit(False), events.withColumn("value", F.lit(None).cast("double"))
    else:
        row, col = raster_cell(F.col("centroid_longitude"), F.col("centroid_latitude"), x0, y0, dx, dy)
        px = pixels.where(F.col("value") != nodata) if nodata is not None else pixels
        out = events.withColumns({"row": row, "col": col}).join(px, ["row", "col"], "left").drop("row", "col")
        seen = F.col("value").isNotNull() & ~F.isnan("value")
    out = out.withColumns({"satellite_context_available": seen, "satellite_source": F.when(seen, source), "satellite_value": F.when(seen, F.col("value")), "satellite_value_name": F.when(seen, "band_1")})
    return out.drop("value")


def landcover_vector(events: DataFrame, polygons: DataFrame, class_column: str = "class") -> DataFrame:
    """Same from polygons(rings, geometry_type, class, ordinal): the first polygon that holds the centroid."""
    e = event_geometry(events).select("event_id", "cx", "cy", F.col("cx").alias("l_w"), F.col("cy").alias("l_s"), F.col("cx").alias("l_e"), F.col("cy").alias("l_n"))
    p = planar(polygons, "rings", F.col("geometry_type"), "p").select(F.col(class_column).cast("string").alias("dominant_landcover_class"), "ordinal", "p_edges", "p_areal", F.col("p_w").alias("r_w"), F.col("p_s").alias("r_s"), F.col("p_e").alias("r_e"), F.col("p_n").alias("r_n"))
    hit = met(e, p, 0.0, 10_000.0).where(inside(F.col("cx"), F.col("cy"), F.col("p_edges"), F.col("p_areal")))
    first = hit.groupBy("event_id").agg(F.min_by("dominant_landcover_class", "ordinal").alias("dominant_landcover_class"))
    out = events.join(first, "event_id", "left")
    return out.withColumn("landcover_available", F.col("dominant_landcover_class").isNotNull())


def unavailable(events: DataFrame, prefix: str) -> DataFrame:
    """The columns of an absent layer: not available, all else NULL (never 0)."""
    return events.withColumns({f"{prefix}_available": F.lit(False), f"{prefix}_present": F.lit(None).cast("boolean"), f"{prefix}_coverage_fraction": F.lit(None).cast("double"), f"{prefix}_distance_km": F.lit(None).cast("double")})


def union_share(cx: float, cy: float, radius: float, shapes: list[np.ndarray], slabs: int) -> float:
    """Share of a disc that a union of edge lists covers: exact chords along `slabs` lines, so overlaps count once."""
    ys = cy - radius + (np.arange(slabs) + 0.5) * 2 * radius / slabs
    half = np.sqrt(np.maximum(radius * radius - (ys - cy) ** 2, 0.0))
    runs = []
    for e in shapes:
        line, at = np.nonzero(((e[:, 1, None] > ys) != (e[:, 3, None] > ys)).T)
        c = e[at]
        xs = c[:, 0] + (ys[line] - c[:, 1]) * (c[:, 2] - c[:, 0]) / (c[:, 3] - c[:, 1])
        order = np.lexsort((xs, line))
        xs, line = xs[order], line[order]
        turn = np.arange(len(line)) - np.searchsorted(line, line)
        a = np.flatnonzero((turn[:-1] % 2 == 0) & (line[1:] == line[:-1]))
        runs += zip(line[a].tolist(), np.maximum(xs[a], cx - half[line[a]]).tolist(), np.minimum(xs[a + 1], cx + half[line[a]]).tolist(), strict=True)
    total, last, end = 0.0, -1, -np.inf
    for k, a, b in sorted(r for r in runs if r[1] < r[2]):
        end = end if k == last else -np.inf
        total += max(0.0, b - max(a, end))
        last, end = k, max(end, b)
    return float(min(1.0, total * (2 * radius / slabs) / (np.pi * radius * radius)))


def vector_presence(events: DataFrame, layer: DataFrame | None, prefix: str, config: ContextConfig = ContextConfig()) -> DataFrame:
    """events with prefix_available, _present, _coverage_fraction and _distance_km.

    Present: a feature within local_km of the footprint. Coverage: share of the local disc around the
    centroid under the union of polygons. Distance: nearest feature to the centroid within
    broad_km. None is an absent layer; an empty layer is present and covers nothing.
    """
    if layer is None:
        return unavailable(events, prefix)
    e = event_geometry(events).select("event_id", "cx", "cy", "foot_edges", F.least("foot_w", "cx").alias("l_w"), F.least("foot_s", "cy").alias("l_s"), F.greatest("foot_e", "cx").alias("l_e"), F.greatest("foot_n", "cy").alias("l_n"))
    p = planar(layer, "rings", F.col("geometry_type"), "p").select("p_edges", "p_areal", F.col("p_w").alias("r_w"), F.col("p_s").alias("r_s"), F.col("p_e").alias("r_e"), F.col("p_n").alias("r_n"))
    local, broad = config.local_km * 1000, config.broad_km * 1000
    pairs = met(e, p, broad, config.cell_m)
    gap = F.array_min(F.transform("foot_edges", lambda s: distance(s["ax"], s["ay"], F.col("p_edges"), F.col("p_areal"))))
    pairs = pairs.withColumns({"gap": gap, "d": distance(F.col("cx"), F.col("cy"), F.col("p_edges"), F.col("p_areal"))})
    near = pairs.groupBy("event_id").agg(F.max(F.col("gap") <= local).alias("present"), F.min(F.when(F.col("d") <= broad, F.col("d") / 1000)).alias("km"))
    touching = pairs.where((F.col("gap") <= local) & F.col("p_areal")).select("event_id", "cx", "cy", F.transform("p_edges", lambda s: F.array(s["ax"], s["ay"], s["bx"], s["by"])).alias("es"))

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)], strict=True)
            shares = [union_share(cx, cy, local, [np.array(es) for es in shapes], config.slabs) for cx, cy, shapes in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shares, pa.float64())], names=["event_id", "share"])

    kind = events.schema["event_id"].dataType.simpleString()
    gathered = touching.groupBy("event_id").agg(F.first("cx"), F.first("cy"), F.collect_list("es"))
    covered = gathered.mapInArrow(share, f"event_id {kind}, share double")
    out = events.join(near, "event_id", "left").join(covered, "event_id", "left")
    return out.withColumns({f"{prefix}_available": F.lit(True), f"{prefix}_present": F.coalesce("present", F.lit(False)), f"{prefix}_coverage_fraction": F.coalesce("share", F.lit(0.0)), f"{prefix}_distance_km": F.col("km")}).drop("present", "km", "share")


def context(events: DataFrame, layers: dict[str, DataFrame | None], config: ContextConfig = ContextConfig()) -> DataFrame:
    """events with all vector layers (vegetation, builtup, water, agriculture) and environmental_context_available."""
    for name in ("vegetation", "builtup", "water", "agriculture"):
        events = vector_presence(events, layers.get(name), name, config)
    flags = [F.col(f"{n}_available") for n in ("vegetation", "builtup", "water", "agriculture")]
    if "landcover_available" in events.columns:
        flags.append(F.col("landcover_available"))
    return events.withColumn("environmental_context_available", F.greatest(*flags))


def first_row(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__r = 1").drop("__r")
