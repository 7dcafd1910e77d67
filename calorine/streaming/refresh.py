"""What a batch of near-real-time observations changes: the events it touched, run through all stages again, and their facilities."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from calorine.plans import chain, fingerprint
from calorine.plans.anomaly import confirmed
from calorine.sources.readers import merge


def touched(actions: DataFrame) -> DataFrame:
    """(event_id) of the events that a batch made or added to."""
    return actions.where(F.col("action").isin("created", "matched")).select("event_id").distinct()


def linked(observations: DataFrame, actions: DataFrame) -> DataFrame:
    """Observations with the event that took them, in order of time and hash."""
    took = actions.where(F.col("action").isin("created", "matched")).select("observation_hash", "event_id")
    return observations.drop("event_id").join(took, "observation_hash").orderBy("acq_datetime", "observation_hash")


def unassigned(observations: DataFrame, limit: int | None = None) -> DataFrame:
    """Observations that no event has taken, oldest first, those without a time last."""
    rows = observations.where("event_id is null").orderBy(F.asc_nulls_last("acq_datetime"), "observation_hash")
    return rows if limit is None else rows.limit(limit)


def clear_orphans(observations: DataFrame, events: DataFrame) -> DataFrame:
    """observations whose event is not stored lose it, so that they are folded again."""
    known = events.select(F.col("event_id").alias("__known")).distinct()
    joined = observations.join(known, F.col("event_id") == F.col("__known"), "left")
    return joined.withColumn("event_id", F.col("__known")).drop("__known")


def facility_events(events: DataFrame, facilities: DataFrame) -> DataFrame:
    """The events that baselines of given facilities read: those confirmed there, and ambiguous ones that name them."""
    keys = facilities.select(F.col("facility_id").alias("__f")).distinct()
    own = events.where(confirmed()).join(keys, F.col("facility_id") == F.col("__f"), "left_semi")
    named = events.where("facility_association_method = 'AMBIGUOUS'").withColumn("__c", F.explode(F.split("candidate_facility_ids", ",")))
    ids = named.join(keys, F.col("__c") == F.col("__f"), "left_semi").select("event_id").distinct()
    return own.unionByName(events.join(ids, "event_id", "left_semi"))


def affected_facilities(before: DataFrame, after: DataFrame, candidates: DataFrame) -> DataFrame:
    """(facility_id) whose baselines change: where touched events were confirmed before or are now, and all candidates of ambiguous ones."""
    was = before.where(confirmed()).select("facility_id")
    now = after.where(confirmed()).select("facility_id")
    unclear = after.where("facility_association_method = 'AMBIGUOUS'").select("event_id")
    return was.union(now).union(candidates.join(unclear, "event_id", "left_semi").select("facility_id")).where("facility_id is not null").distinct()


def refresh(stored: DataFrame | None, detections: DataFrame, actions: DataFrame, facilities: DataFrame, layers: dict[str, DataFrame | None] | None = None, sta_layers: DataFrame | None = None) -> dict[str, DataFrame]:
    """Stored events with the touched ones run through all stages again, their candidates, and the fingerprints of affected facilities.

    detections: those of all touched events, labelled with event_id. Other events serve as history
    for anomaly scores and baselines and stay as they are. The same batch again gives the same rows.
    """
    own = detections.join(touched(actions), "event_id", "left_semi")
    described = chain.describe(own)
    history = stored.join(described.select("event_id"), "event_id", "left_anti") if stored is not None else None
    made = chain.judge(described, facilities, layers, sta_layers, history)
    before = stored.join(described.select("event_id"), "event_id", "left_semi") if stored is not None else made["events"].limit(0)
    changed = affected_facilities(before, made["events"], made["candidates"])
    every = merge(stored, made["events"], "event_id") if stored is not None else made["events"]
    universe = facilities.join(changed, "facility_id", "left_semi").select("facility_id", "facility_name", "facility_type")
    prints = fingerprint.fingerprints(facility_events(every, changed), universe)
    return {"events": every, "touched": made["events"], "candidates": made["candidates"], "fingerprints": prints}


def changed_rows(before: DataFrame, after: DataFrame, columns: list[str], key: str = "event_id") -> DataFrame:
    """Keys whose columns differ between two states of a table."""
    old = before.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return after.join(old, key, "left").where(~same).select(key)


def temporal_features(times: list[datetime]) -> dict:
    """Duration, days and gaps of one event's detection times: what the persistence rule reads."""
    ordered = sorted(times)
    if not ordered:
        return {"detection_count": 0, "observed_duration_hours": None, "distinct_detection_days": 0, "span_days": None, "mean_gap_hours": None, "max_gap_hours": None}
    gaps = [(b - a).total_seconds() / 3600 for a, b in zip(ordered, ordered[1:], strict=False)]
    return {
        "detection_count": len(ordered),
        "observed_duration_hours": (ordered[-1] - ordered[0]).total_seconds() / 3600,
        "distinct_detection_days": len({t.date() for t in ordered}),
        "span_days": (ordered[-1].date() - ordered[0].date()).days + 1,
        "mean_gap_hours": sum(gaps) / len(gaps) if gaps else None,
        "max_gap_hours": max(gaps, default=None),
    }
