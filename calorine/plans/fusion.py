"""Evidence fusion: ordinal scores by family, conflicts, and a candidate interpretation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from calorine.functions.parsing import clean_text, to_boolean

CONFIRMED = ("WITHIN_FACILITY", "INTERSECTS_FACILITY", "NEAR_FACILITY")
STRONG = ("WITHIN_FACILITY", "INTERSECTS_FACILITY")
STRONG_TYPES = ("REFINERY", "POWER_PLANT", "MINE", "LNG_TERMINAL")
WEAK_TYPES = ("OTHER_INDUSTRIAL", "INDUSTRIAL_AREA", "UNKNOWN")
DOMAINS = ("temporal", "infrastructure", "sta", "environmental")
INDUSTRIAL_MAX = 14


def _has(df: DataFrame, c: str) -> bool:
    return c in df.columns


def _text(df: DataFrame, c: str, default: str | None) -> Column:
    v = clean_text(c) if _has(df, c) else F.lit(None).cast("string")
    return v if default is None else F.coalesce(v, F.lit(default))


def signals(events: DataFrame) -> DataFrame:
    """events with the signal of each family and whether its domain is available (missing stays missing)."""
    temporal = _has(events, "persistence_label") and _has(events, "anomaly_status")
    infra = _has(events, "facility_association_method")
    sta = _has(events, "sta_association_status")
    env = [c for c in ("vegetation", "agriculture", "builtup", "water", "landcover") if _has(events, f"{c}_available")]
    method = _text(events, "facility_association_method", "NO_FACILITY_ASSOCIATION")
    cols = {
        "temporal_evidence_available": F.lit(temporal),
        "infrastructure_evidence_available": F.lit(infra),
        "sta_domain_available": F.lit(sta),
        "environmental_domain_available": F.coalesce(F.greatest(*[F.coalesce(to_boolean(f"{c}_available"), F.lit(False)) for c in env], F.lit(False)), F.lit(False)) if env else F.lit(False),
        "f_persistence": _text(events, "persistence_label", "UNAVAILABLE"),
        "f_anomaly": _text(events, "anomaly_status", "UNAVAILABLE"),
        "f_method": method,
        "f_confidence": _text(events, "facility_attribution_confidence", "NONE"),
        "f_type": _text(events, "facility_type", None),
        "f_history": _text(events, "baseline_history_status", "UNAVAILABLE"),
        "f_assoc": F.when(method.isin(*CONFIRMED), "CONFIRMED").when(method == "AMBIGUOUS", "AMBIGUOUS").otherwise("NONE"),
        "sta_association_signal": _text(events, "sta_association_status", "NO_STA_ASSOCIATION") if sta else F.lit("UNAVAILABLE"),
        "f_sta_quality": _text(events, "sta_evidence_quality", "NONE"),
    }
    for c in ("vegetation", "agriculture", "builtup", "water"):
        seen = F.coalesce(to_boolean(f"{c}_available"), F.lit(False)) if _has(events, f"{c}_available") else F.lit(False)
        flag = to_boolean(f"{c}_present") if _has(events, f"{c}_present") else F.lit(None).cast("boolean")
        cols[f"f_{c}"] = F.when(seen, F.when(flag, "PRESENT").when(~flag, "ABSENT"))
    return events.withColumns(cols)


def scores(df: DataFrame) -> DataFrame:
    """Ordinal support by family, the industrial aggregate, corroboration and strength."""
    m, conf, kind = F.col("f_method"), F.col("f_confidence"), F.col("f_type")
    yes = lambda c: F.coalesce(c, F.lit(False))
    strong_kind, weak_kind = yes(kind.isin(*STRONG_TYPES)), yes(kind.isin(*WEAK_TYPES))
    at = F.when(conf == "LOW", 2).otherwise(3)
    at = F.when(weak_kind & (conf != "HIGH"), F.least(at, F.lit(2))).otherwise(at)
    at = F.when(strong_kind & conf.isin("HIGH", "MEDIUM"), 3).otherwise(at)
    near = F.when(conf.isin("HIGH", "MEDIUM") | (strong_kind & (conf == "LOW")), 2).otherwise(1)
    ok = lambda d, c: F.when(F.col(d), c).otherwise(0)
    confirmed = m.isin(*CONFIRMED)
    df = df.withColumns(
        {
            "infrastructure_score": ok("infrastructure_evidence_available", F.when(m.isin(*STRONG), at).when(m == "NEAR_FACILITY", near).otherwise(0)),
            "temporal_score": ok("temporal_evidence_available", F.when(F.col("f_persistence").isin("PERSISTENT", "RECURRING"), 2).otherwise(0)),
            "historical_score": ok("infrastructure_evidence_available", F.when(confirmed, F.when(F.col("f_history") == "ESTABLISHED_BASELINE", 3).when(F.col("f_history") == "LIMITED_HISTORY", 2).when(F.col("f_history") == "INSUFFICIENT_HISTORY", 1).otherwise(0)).otherwise(0)),
            "anomaly_support_score": ok("temporal_evidence_available", F.when(F.col("f_anomaly") == "ANOMALOUS", 2).when(F.col("f_anomaly") == "ELEVATED", 1).otherwise(0)),
            "sta_score": ok("sta_domain_available", F.when((F.col("sta_association_signal") == "STA_ASSOCIATED") & F.col("f_sta_quality").isin("HIGH", "MEDIUM"), 2).when(F.col("sta_association_signal") == "STA_ASSOCIATED", 1).otherwise(0)),
            "environmental_score": ok("environmental_domain_available", F.least(F.lit(3), F.when(yes(F.col("f_vegetation") == "PRESENT"), 2).otherwise(0) + F.when(yes(F.col("f_agriculture") == "PRESENT"), 2).otherwise(0))),
            "builtup_bonus": ok("environmental_domain_available", F.when(yes(F.col("f_builtup") == "PRESENT"), 1).otherwise(0)),
        }
    )
    i, t, h, a, s = (F.col(c) for c in ("infrastructure_score", "temporal_score", "historical_score", "anomaly_support_score", "sta_score"))
    backed = F.when(i > 0, F.least(h, F.lit(2)) + F.least(a, F.lit(2))).otherwise(0)
    total = 2 * i + F.least(t, F.lit(2)) + backed + F.least(s, F.lit(2))
    total = F.least(F.lit(INDUSTRIAL_MAX), total + F.when(i > 0, F.col("builtup_bonus")).otherwise(0))
    df = df.withColumns({"industrial_evidence_score": total, "corroboration_score": F.least(t, F.lit(2)) + backed + s})
    x = F.col("industrial_evidence_score")
    return df.withColumns({"evidence_fusion_score": x, "evidence_strength": F.when(x <= 0, "NONE").when(x <= 3, "WEAK").when(x <= 7, "MODERATE").otherwise("STRONG")})


def _codes(*pairs: tuple[Column, Column | str]) -> Column:
    return F.array_join(F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(v) if isinstance(v, str) else v) for c, v in pairs]))), ";")


def fuse(events: DataFrame) -> DataFrame:
    """events with availability, scores, conflicts, candidate interpretation and code lists."""
    df = scores(signals(events))
    yes = lambda c: F.coalesce(c, F.lit(False))
    veg, ag, built = (yes(F.col(f"f_{c}") == "PRESENT") for c in ("vegetation", "agriculture", "builtup"))
    sta_ok, env_ok = F.col("sta_domain_available"), F.col("environmental_domain_available")
    temp_ok, infra_ok = F.col("temporal_evidence_available"), F.col("infrastructure_evidence_available")
    assoc, sig = F.col("f_assoc"), F.col("sta_association_signal")
    none, unclear, sure = assoc == "NONE", assoc == "AMBIGUOUS", assoc == "CONFIRMED"
    flags = [temp_ok, infra_ok, sta_ok, env_ok]
    names = lambda want: F.array_compact(F.array(*[F.when(f if want else ~f, F.lit(d)) for d, f in zip(DOMAINS, flags, strict=True)]))
    present = sum((f.cast("int") for f in flags), F.lit(0))
    conflicts = _codes(
        (sure & env_ok & ag, "FACILITY_VS_AGRICULTURE"),
        (sure & env_ok & veg & ~built, "FACILITY_VS_VEGETATION"),
        (sta_ok & sig.isin("STA_ASSOCIATED", "AMBIGUOUS") & none & env_ok & veg, "STA_WITHOUT_FACILITY_WITH_VEGETATION"),
        (unclear & sta_ok & (sig == "STA_ASSOCIATED"), "AMBIGUOUS_FACILITY_WITH_STA"),
        (none & env_ok & ag & veg, "AGRICULTURE_AND_VEGETATION_BOTH_PRESENT"),
    )
    listed = lambda a: F.when(F.size(a) > 0, F.array_join(a, ",")).otherwise(F.lit("none"))
    df = df.withColumns(
        {
            "evidence_sources_present_count": present,
            "evidence_sources_present": F.array_join(names(True), ";"),
            "evidence_sources_missing": F.array_join(names(False), ";"),
            "evidence_availability_summary": F.concat(F.format_string("present=%d/4 [", present), listed(names(True)), F.lit("]; missing=["), listed(names(False)), F.lit("]")),
            "evidence_coverage": F.concat(present.cast("string"), F.lit("/4")),
            "evidence_conflict_codes": conflicts,
        }
    ).withColumn("evidence_conflict", F.col("evidence_conflict_codes") != "")
    i, c, x, e = F.col("infrastructure_score"), F.col("corroboration_score"), F.col("industrial_evidence_score"), F.col("environmental_score")
    bad = F.col("evidence_conflict")
    branches = [
        (unclear | (sta_ok & (sig == "AMBIGUOUS") & (i <= 0)), "AMBIGUOUS_EVIDENCE", "PARTIAL", F.lit("HIGH"), F.lit("LOW")),
        (bad & (i >= 2) & (e >= 2), "MIXED_OR_CONFLICTING", "PARTIAL", F.lit("HIGH"), F.lit("LOW")),
        ((x >= 6) & (i >= 2) & (e >= 2), "MIXED_OR_CONFLICTING", "PARTIAL", F.lit("HIGH"), F.lit("LOW")),
        (ag & (i <= 0), "ENVIRONMENTAL_AGRICULTURE_CONTEXT", "PARTIAL", F.lit("HIGH"), F.lit("LOW")),
        (veg & (i <= 0), "ENVIRONMENTAL_VEGETATION_CONTEXT", "PARTIAL", F.lit("HIGH"), F.lit("LOW")),
        (i >= 3, "INDUSTRIAL_ACTIVITY_CANDIDATE", "SUFFICIENT_FOR_CANDIDATE", F.when((c >= 3) & (F.col("sta_score") > 0), "LOW").when((c >= 2) & (F.col("evidence_sources_present_count") >= 2), "MEDIUM").otherwise("HIGH"), F.when(c >= 1, "MEDIUM").otherwise("LOW")),
        (((i >= 2) & (c >= 1)) | ((i >= 1) & (c >= 2)), "POSSIBLE_INDUSTRIAL_ACTIVITY", "PARTIAL", F.lit("HIGH"), F.lit("LOW")),
        (i >= 1, "INSUFFICIENT_EVIDENCE", "INSUFFICIENT", F.lit("HIGH"), F.lit("NONE")),
        (F.lit(True), "INSUFFICIENT_EVIDENCE", "INSUFFICIENT", F.when(F.col("evidence_sources_present_count") <= 2, "VERY_HIGH").otherwise("HIGH"), F.lit("NONE")),
    ]

    def pick(k: int) -> Column:
        out = None
        for b in branches:
            v = b[k] if isinstance(b[k], Column) else F.lit(b[k])
            out = F.when(b[0], v) if out is None else out.when(b[0], v)
        return out

    unc = pick(3)
    raised = F.when(~sta_ok | ~env_ok, F.when(unc == "LOW", "MEDIUM").when(unc == "MEDIUM", "HIGH").otherwise(unc)).otherwise(unc)
    t, a = F.col("temporal_score"), F.col("anomaly_support_score")
    label, anomaly = F.col("f_persistence"), F.col("f_anomaly")
    j = lambda *p: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in p])
    hist_known = ~F.col("f_history").isin("NOT_APPLICABLE", "UNAVAILABLE")
    h = F.col("historical_score")
    profile = _codes((temp_ok, j("PERSISTENCE:", label)), (temp_ok, j("ANOMALY:", anomaly)), (infra_ok, j("FACILITY:", assoc)), (infra_ok, j("INFRA_SCORE:", i.cast("string"))), (infra_ok & none, "FACILITY_NONE_NOT_NATURAL"), (infra_ok & hist_known, j("HISTORY:", F.col("f_history"))), (sta_ok, j("STA:", sig)), (sta_ok & (sig == "NO_STA_ASSOCIATION"), "STA_NONE_NOT_ANTI_INDUSTRIAL"), (env_ok & veg, "ENV_VEGETATION_PRESENT"), (env_ok & ag, "ENV_AGRICULTURE_PRESENT"), (env_ok & built, "ENV_BUILTUP_PRESENT"))
    support = _codes((temp_ok & (t > 0), j("TEMPORAL_", label)), (temp_ok & (a > 0), j("TEMPORAL_", anomaly, "_DEVIATION")), (infra_ok & (i > 0), j("FACILITY_", F.col("f_method"))), (infra_ok & (i > 0), j("FACILITY_CONFIDENCE_", F.col("f_confidence"))), (infra_ok & (i > 0) & F.col("f_type").isNotNull(), j("FACILITY_TYPE_", F.col("f_type"))), (infra_ok & hist_known & (h > 0), j("HISTORICAL_", F.col("f_history"))), (sta_ok & (F.col("sta_score") > 0), j("STA_", sig)), (env_ok & veg, "ENV_VEGETATION_PRESENT"), (env_ok & ag, "ENV_AGRICULTURE_PRESENT"), (env_ok & built, "ENV_BUILTUP_PRESENT"))
    limits = _codes((~temp_ok, "TEMPORAL_UNAVAILABLE"), (infra_ok & none, "NO_FACILITY_ASSOCIATION"), (infra_ok & hist_known & (h <= 0) & sure, "NO_ESTABLISHED_HISTORY"), (~infra_ok, "INFRASTRUCTURE_UNAVAILABLE"), (sta_ok & (sig == "NO_STA_ASSOCIATION"), "NO_STA_MATCH"), (~sta_ok, "STA_UNAVAILABLE"), (~env_ok, "ENVIRONMENTAL_CONTEXT_UNAVAILABLE"))
    doubts = F.concat_ws(";", F.nullif(_codes((infra_ok & unclear, "FACILITY_AMBIGUOUS"), (bad, "EVIDENCE_CONFLICT")), F.lit("")), F.nullif(F.col("evidence_conflict_codes"), F.lit("")), F.nullif(_codes(((i <= 0) & (t > 0), "PERSISTENT_OR_TEMPORAL_WITHOUT_FACILITY"), ((i <= 0) & (a > 0), "ANOMALY_WITHOUT_FACILITY_NOT_INDUSTRIAL")), F.lit("")))
    out = df.withColumns({"candidate_interpretation": pick(1), "evidence_sufficiency": pick(2), "interpretation_uncertainty": raised, "interpretation_confidence": pick(4), "evidence_profile_codes": profile, "supporting_evidence_codes": support, "ambiguous_evidence_codes": doubts, "limiting_evidence_codes": limits})
    text = F.format_string("%s: infrastructure %d, corroboration %d, industrial %d of 14, environment %d", F.col("candidate_interpretation"), i, c, x, e)
    return out.withColumn("interpretation_rationale", text).drop(*[k for k in out.columns if k.startswith("f_")])
