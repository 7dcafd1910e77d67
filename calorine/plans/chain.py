"""All stages one after another: from raw rows or labelled detections to prioritised events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from calorine.functions.session import saved
from calorine.plans import anomaly, association, clean, environment, events, fingerprint, fusion, risk, sta

LAYERS = ("vegetation", "builtup", "water", "agriculture")


def form(raw: DataFrame, pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(labelled detections, noise) of raw text rows."""
    rows = saved(clean.clean(raw, pattern), "clean")
    return events.form(rows.withColumn("det_id", F.xxhash64(*[c for c in clean.RAW_COLUMNS if c in rows.columns], "acq_datetime")))


def describe(labelled: DataFrame) -> DataFrame:
    """Events of labelled detections: features, persistence and footprints."""
    made = events.persistence(events.features(labelled))
    shapes = events.footprints(labelled)
    return made.join(shapes.select("event_id", *[c for c in shapes.columns if c not in made.columns]), "event_id")


def without_sta(rows: DataFrame) -> DataFrame:
    """The columns of static-anomaly evidence where there is no source: not available, no match is claimed."""
    return rows.withColumns({"sta_association_status": F.lit("NO_STA_ASSOCIATION"), "sta_evidence_quality": F.lit("NONE"), "sta_evidence_available": F.lit(False), "sta_match_count": F.lit(None).cast("int")})


def judge(described: DataFrame, facilities: DataFrame, layers: dict[str, DataFrame | None] | None = None, sta_layers: DataFrame | None = None, history: DataFrame | None = None) -> dict[str, DataFrame]:
    """Association, baselines, anomaly, evidence and risk of events; history holds other, already associated events of their facilities.

    Returns the frames `events` (all columns of all stages), `candidates` and `fingerprints`.
    """
    associated, candidates = association.associate(described, facilities)
    associated = saved(associated, "associated")
    known = associated if history is None else associated.unionByName(history.select(*[c for c in associated.columns if c in history.columns]), allowMissingColumns=True)
    prints = fingerprint.fingerprints(known, facilities.select("facility_id", "facility_name", "facility_type"))
    scored = anomaly.score(known)
    if history is not None:
        scored = scored.join(associated.select("event_id"), "event_id", "left_semi")
    base = scored.join(prints.select("facility_id", "baseline_history_status"), "facility_id", "left")
    with_sta = sta.evidence(base, sta_layers) if sta_layers is not None else without_sta(base)
    judged = risk.prioritize(fusion.fuse(environment.context(with_sta, layers or {})))
    return {"events": judged, "candidates": candidates, "fingerprints": prints}


def run(raw: DataFrame, facilities: DataFrame, layers: dict[str, DataFrame | None] | None = None, sta_layers: DataFrame | None = None, pattern: str | None = None) -> dict[str, DataFrame]:
    """Raw text rows to prioritised events, with noise, candidates and fingerprints; the pattern of dates is found where none is given."""
    labelled, noise = form(raw, pattern)
    labelled = saved(labelled, "labelled")
    return judge(describe(labelled), facilities, layers, sta_layers) | {"noise": noise, "labelled": labelled}
