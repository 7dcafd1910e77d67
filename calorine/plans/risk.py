"""Investigation priority, 0 to 100, from severity, persistence, anomaly, facility and evidence."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from calorine.functions.parsing import to_boolean
from calorine.operators.stdbscan import with_rank

RELATION = {"WITHIN_FACILITY": 1.0, "INTERSECTS_FACILITY": 0.95, "NEAR_FACILITY": 0.45, "AMBIGUOUS": 0.20, "NO_FACILITY_ASSOCIATION": 0.0}
CONFIDENCE = {"HIGH": 1.0, "MEDIUM": 0.75, "LOW": 0.45, "NONE": 0.0}
PERSISTENCE = {"RECURRING": 1.0, "PERSISTENT": 0.85, "SHORT_LIVED": 0.25}
ANOMALY = {"ANOMALOUS": 1.0, "ELEVATED": 0.55, "NORMAL": 0.10}


@dataclass(frozen=True)
class RiskConfig:
    thermal: float = 25.0
    persistence: float = 15.0
    anomaly: float = 25.0
    facility: float = 15.0
    evidence: float = 20.0
    ambiguity_max: float = 8.0
    frp_log_cap: float = 8.0
    detection_cap: float = 50.0
    duration_cap: float = 168.0
    medium: float = 25.0
    high: float = 50.0
    critical: float = 75.0
    types: dict[str, float] = field(default_factory=lambda: {"REFINERY": 1.0, "LNG_TERMINAL": 1.0, "POWER_PLANT": 0.9, "MINE": 0.75, "INDUSTRIAL_AREA": 0.6, "OTHER_INDUSTRIAL": 0.5, "UNKNOWN": 0.35})


def lookup(c: Column, table: dict[str, float], default: float) -> Column:
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))
    return F.coalesce(F.try_element_at(m, F.coalesce(c, F.lit(""))), F.lit(default))


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def prioritize(events: DataFrame, config: RiskConfig = RiskConfig(), nrt_rank: bool = False) -> DataFrame:
    """events with component points, risk_score, priority, action, uncertainty and explanation.

    The power rank is an ordinal over all events (ties by event_id), found from range
    partitions without gathering them; nrt_rank leaves it at 0, as for one event alone.
    """
    frp = F.coalesce(F.col("peak_frp").cast("double"), F.lit(0.0))
    if nrt_rank:
        df = events.withColumn("frp_rank", F.lit(0.0))
    else:
        keyed = events.withColumn("__frp", frp)
        n = events.count()
        r = with_rank(keyed.select("event_id", "__frp"), ["__frp", "event_id"], "__r").select("event_id", "__r")
        df = keyed.join(r, "event_id").withColumn("frp_rank", F.when(F.col("__frp") > 0, (F.col("__r") - 1) / max(n - 1, 1)).otherwise(0.0)).drop("__frp", "__r")
    base = 0.6 * clip(F.log1p(F.greatest(frp, F.lit(0.0))) / config.frp_log_cap) + 0.25 * clip(F.coalesce(F.col("detection_count"), F.lit(0)) / config.detection_cap) + 0.15 * clip(F.coalesce(F.col("observed_duration_hours"), F.lit(0.0)) / config.duration_cap)
    level = 0.7 * base + 0.3 * F.col("frp_rank")
    df = df.withColumn("__level", clip(level))
    band = F.when(F.col("__level") >= 0.85, "EXTREME").when(F.col("__level") >= 0.60, "HIGH").when(F.col("__level") >= 0.30, "MODERATE").otherwise("LOW")
    method, conf = F.coalesce("facility_association_method", F.lit("NO_FACILITY_ASSOCIATION")), F.coalesce("facility_attribution_confidence", F.lit("NONE"))
    lone = lookup(F.col("anomaly_status"), ANOMALY, 0.0)
    boosted = F.when(F.col("anomaly_score").isNotNull() & (lone > 0), F.least(F.lit(1.0), lone + 0.15 * clip(F.col("anomaly_score") / 5, 0.0, 0.25))).otherwise(lone)
    relation = lookup(method, RELATION, 0.0)
    facility = F.when(method == "NO_FACILITY_ASSOCIATION", 0.0).when(method == "AMBIGUOUS", 0.20).otherwise(relation * (0.55 + 0.45 * lookup(F.col("facility_type"), config.types, 0.35)) * (0.4 + 0.6 * lookup(conf, CONFIDENCE, 0.0)))
    points = {"thermal_severity_score": F.col("__level") * config.thermal, "persistence_priority_score": lookup(F.col("persistence_label"), PERSISTENCE, 0.0) * config.persistence, "anomaly_priority_score": boosted * config.anomaly, "facility_context_score": facility * config.facility, "industrial_evidence_component": clip(F.coalesce(F.col("industrial_evidence_score"), F.lit(0)) / 14.0) * config.evidence}
    df = df.withColumns({k: F.bround(v, 4) for k, v in points.items()} | {"thermal_severity_band": band})
    total = sum((F.col(k) for k in points), F.lit(0.0))
    unclear = (method == "AMBIGUOUS") | (F.coalesce("candidate_interpretation", F.lit("")) == "AMBIGUOUS_EVIDENCE")
    damp = F.when(unclear, F.least(F.lit(config.ambiguity_max), 0.12 * total)).otherwise(0.0)
    raw = clip(total - damp, 0.0, 100.0)
    rung = F.when(raw >= config.critical, "CRITICAL").when(raw >= config.high, "HIGH").when(raw >= config.medium, "MEDIUM").otherwise("LOW")
    df = df.withColumns({"ambiguity_dampening": F.bround(damp, 4), "risk_score": F.bround(raw, 4), "investigation_priority": F.when((rung == "LOW") & (F.col("thermal_severity_band") == "EXTREME"), "MEDIUM").otherwise(rung)})
    p = F.col("investigation_priority")
    cand = F.coalesce("candidate_interpretation", F.lit(""))
    context = F.when(cand == "INDUSTRIAL_ACTIVITY_CANDIDATE", "STRONG").when(cand == "POSSIBLE_INDUSTRIAL_ACTIVITY", "POSSIBLE").when(cand.isin("AMBIGUOUS_EVIDENCE", "MIXED_OR_CONFLICTING"), "AMBIGUOUS").otherwise("INSUFFICIENT")
    df = df.withColumns({"recommended_action": F.when(p == "CRITICAL", "URGENT_REVIEW").when(p == "HIGH", "PRIORITIZE_INVESTIGATION").when(p == "MEDIUM", "REVIEW").otherwise("MONITOR"), "industrial_context": context})
    return explained(uncertain(df, method, conf), list(points)).drop("__level")


def uncertain(df: DataFrame, method: Column, conf: Column) -> DataFrame:
    """Points and bands for what is not known; unavailable sources are counted, never held against an event."""
    off = lambda c: ~F.coalesce(to_boolean(c), F.lit(False)) if c in df.columns else F.lit(True)
    none, unclear = method == "NO_FACILITY_ASSOCIATION", method == "AMBIGUOUS"
    hist = F.coalesce("anomaly_history_status", F.lit("")).isin("NO_PRIOR_OBSERVATIONS", "INSUFFICIENT_HISTORY", "NOT_APPLICABLE")
    few, base = F.coalesce(F.col("persistence_label") == "INSUFFICIENT_OBSERVATIONS", F.lit(False)), F.coalesce(F.col("anomaly_status") == "INSUFFICIENT_HISTORY", F.lit(False))
    rules = [(none, 25, "NO_FACILITY_ASSOCIATION", "NO_FACILITY_ASSOCIATION"), (unclear, 30, "AMBIGUOUS_FACILITY_ASSOCIATION", "AMBIGUOUS_FACILITY_ASSOCIATION"), (~none & ~unclear & (conf == "LOW"), 12, "LOW_FACILITY_ATTRIBUTION_CONFIDENCE", None), (hist, 15, "INSUFFICIENT_OR_NO_FACILITY_HISTORY", "INSUFFICIENT_HISTORY"), (few, 10, "INSUFFICIENT_OBSERVATIONS", None), (base, 10, "NO_ANOMALY_BASELINE", None), (off("sta_evidence_available"), 8, "STA_UNAVAILABLE", "STA_UNAVAILABLE"), (off("environmental_context_available"), 8, "ENVIRONMENTAL_CONTEXT_UNAVAILABLE", "ENVIRONMENTAL_CONTEXT_UNAVAILABLE")]
    points = F.least(F.lit(100.0), sum((F.when(c, float(k)).otherwise(0.0) for c, k, _, _ in rules), F.lit(0.0)))
    factors = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, _, t, _ in rules]))
    limits = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, _, _, t in rules if t]))
    earlier = F.filter(F.transform(F.split(F.coalesce(F.col("limiting_evidence_codes"), F.lit("")), ";"), F.trim), lambda x: x != "") if "limiting_evidence_codes" in df.columns else F.array().cast("array<string>")
    df = df.withColumns({"uncertainty_score": points, "uncertainty_factors": F.array_join(factors, ";"), "risk_limiting_codes": F.array_join(F.array_distinct(F.concat(limits, earlier)), ";")})
    u = F.col("uncertainty_score")
    return df.withColumn("uncertainty_band", F.when(u >= 70, "VERY_HIGH").when(u >= 45, "HIGH").when(u >= 25, "MODERATE").otherwise("LOW"))


def explained(df: DataFrame, parts: list[str]) -> DataFrame:
    structs = F.array(*[F.struct((-F.col(p)).alias("o"), F.lit(i).alias("i"), F.lit(p).alias("name"), F.col(p).alias("v")) for i, p in enumerate(parts)])
    top = F.slice(F.filter(F.array_sort(structs), lambda s: s["v"] > 0), 1, 3)
    names = F.array_join(F.transform(top, lambda s: F.format_string("%s=%.2f", s["name"], s["v"])), ", ")
    text = F.concat(F.format_string("Priority %s (%.2f of 100)", F.col("investigation_priority"), F.col("risk_score")), F.when(F.size(top) > 0, F.concat(F.lit("; led by "), names)).otherwise(F.lit("")), F.format_string("; uncertainty %s", F.col("uncertainty_band")))
    return df.withColumns({"dominant_risk_factors": F.array_join(F.transform(top, lambda s: s["name"]), ";"), "priority_explanation": text})


def crosstab(scored: DataFrame, rows: str = "industrial_context") -> DataFrame:
    return scored.groupBy(rows).pivot("investigation_priority", ["LOW", "MEDIUM", "HIGH", "CRITICAL"]).count().na.fill(0)


def token_tallies(scored: DataFrame, column: str = "uncertainty_factors") -> DataFrame:
    return scored.select(F.explode(F.split(column, ";")).alias("token")).where("token <> ''").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def distribution(scored: DataFrame) -> DataFrame:
    q = F.percentile("risk_score", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.95)]))
    return scored.agg(F.min("risk_score").alias("min"), q.alias("q"), F.max("risk_score").alias("max"), F.avg("risk_score").alias("mean")).select("min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"), F.col("q")[3].alias("p95"), "max", "mean")
