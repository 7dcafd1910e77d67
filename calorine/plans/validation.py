"""Evaluation against independent references: matching, binary and multiclass metrics, thresholds, errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from calorine.functions.geo import haversine
from calorine.functions.parsing import clean_text, hours
from calorine.functions.session import saved

# Reference label vocabulary, in the order in which parts of words are tried.
LABELS = {
    "industrial": "INDUSTRIAL", "industrial_fire": "INDUSTRIAL", "industry": "INDUSTRIAL", "factory": "INDUSTRIAL", "power_plant": "INDUSTRIAL", "gas_flare": "INDUSTRIAL", "flare": "INDUSTRIAL",
    "natural": "NATURAL", "wildfire": "NATURAL", "forest_fire": "NATURAL", "vegetation": "NATURAL", "bushfire": "NATURAL",
    "agricultural": "AGRICULTURAL", "agriculture": "AGRICULTURAL", "crop": "AGRICULTURAL", "stubble": "AGRICULTURAL", "ag_burn": "AGRICULTURAL",
    "other": "OTHER", "unknown": "UNKNOWN", "ambiguous": "AMBIGUOUS", "uncertain": "AMBIGUOUS",
}
ABSTAIN = ("AMBIGUOUS_EVIDENCE", "MIXED_OR_CONFLICTING", "INSUFFICIENT_EVIDENCE")


@dataclass(frozen=True)
class MatchConfig:
    radius_km: float = 5.0
    max_hours: float = 72.0
    tolerance_km: float = 0.5


def normalize_label(c: Column | str) -> Column:
    t = F.regexp_replace(F.lower(clean_text(c)), "[- ]", "_")
    out = F.when(t.isNull(), "UNKNOWN")
    for k, v in LABELS.items():
        out = out.when(t == k, v)
    for k, v in LABELS.items():
        out = out.when(F.contains(t, F.lit(k)), v)
    return out.otherwise("UNKNOWN")


def independent(c: Column | str, required: bool = True) -> Column:
    t = F.lower(F.coalesce(clean_text(c), F.lit("")))
    return F.when(t.rlike("firms|viirs|modis|self|derived|model"), False).when(t.rlike("independent|curated|official|manual"), True).otherwise(not required)


def match(references: DataFrame, events: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """references with matched event_id, distance, time gap and status; grid join, then the nearest by (distance, gap, id).

    References of one place and date find the same event, and of events of one place and time only the
    least id can be found, so each such group meets once; how many events it stands for decides the status.
    """
    cell = config.radius_km / 111.0 * 1.001
    to = lambda c: F.floor(F.col(c) / cell).cast("long")
    lon_width = lambda lat: F.lit(cell) / F.greatest(F.cos(F.radians(F.least(F.abs(lat) + 3 * cell, F.lit(89.9)))), F.lit(1e-3))
    spot = {"m_rlat": "reference_latitude", "m_rlon": "reference_longitude", "m_date": "reference_date"}
    r = references.select(*[F.col(c).alias(k) for k, c in spot.items()]).distinct()
    r = r.withColumn("band", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: to("m_rlat") + i)))
    r = r.withColumn("col", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.floor(F.col("m_rlon") / lon_width((F.col("band") + F.lit(0.5)) * cell)).cast("long") + i)))
    e = events.groupBy(F.col("centroid_latitude").alias("m_lat"), F.col("centroid_longitude").alias("m_lon"), F.col("event_start").alias("m_start"), F.col("event_end").alias("m_end")).agg(F.min("event_id").alias("m_event"), F.count(F.lit(1)).alias("m_n")).withColumn("band", to("m_lat"))
    e = e.withColumn("col", F.floor(F.col("m_lon") / lon_width((F.col("band") + F.lit(0.5)) * cell)).cast("long"))
    day = F.col("m_date")
    start, end = F.coalesce("m_start", "m_end"), F.coalesce("m_end", "m_start")
    gap = F.when(day.isNull(), F.lit(None).cast("double")).when(day.between(start, end), 0.0).otherwise(F.least(F.abs(hours(start, day)), F.abs(hours(end, day))))
    pairs = r.join(e.hint("merge"), ["band", "col"]).withColumns({"d": haversine(F.col("m_rlat"), F.col("m_rlon"), F.col("m_lat"), F.col("m_lon")), "gap": gap})
    pairs = pairs.where((F.col("d") <= config.radius_km) & (day.isNull() | (F.col("gap") <= config.max_hours)))
    # The two nearest groups decide; a filter on the row number alone lets each task drop the others before the shuffle.
    w = Window.partitionBy(*spot).orderBy("d", F.asc_nulls_last("gap"), "m_event")
    best = pairs.select(*spot, "d", "gap", "m_event", "m_n").withColumn("k", F.row_number().over(w)).where("k <= 2")
    first = lambda c: F.max(F.when(F.col("k") == 1, F.col(c)))
    top = best.groupBy(*spot).agg(first("m_event").alias("event_id"), first("d").alias("match_distance_km"), first("gap").alias("match_gap_hours"), first("m_n").alias("m_n"), F.max(F.when(F.col("k") == 2, F.col("d"))).alias("d2"))
    several = (F.col("m_n") > 1) | (F.abs(F.col("d2") - F.col("match_distance_km")) <= config.tolerance_km)
    top = top.select(*spot, "event_id", "match_distance_km", "match_gap_hours", F.when(several, "MULTIPLE_POSSIBLE_MATCHES").otherwise("MATCHED").alias("match_status"))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"m.{k}")) for k, c in spot.items()]
    found = references.alias("x").join(top.alias("m"), same, "left").drop(*spot)
    ahead = [c for c in references.columns if c != "validation_id"]
    return found.select("validation_id", *ahead, "event_id", "match_distance_km", "match_gap_hours", F.coalesce("match_status", F.lit("NO_MATCH")).alias("match_status"))


def to_binary(candidate: Column, mode: str = "strict") -> Column:
    positive = ("INDUSTRIAL_ACTIVITY_CANDIDATE",) if mode == "strict" else ("INDUSTRIAL_ACTIVITY_CANDIDATE", "POSSIBLE_INDUSTRIAL_ACTIVITY")
    out = F.when(candidate.isNull() | candidate.isin(*ABSTAIN), F.lit(None)).when(candidate.isin(*positive), "INDUSTRIAL")
    return (out.when(candidate == "POSSIBLE_INDUSTRIAL_ACTIVITY", F.lit(None)) if mode == "strict" else out).otherwise("NON_INDUSTRIAL")


def binary_metrics(rows: DataFrame, truth: str = "truth", predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """Counts and rates; a rate over nothing is NULL. A NULL prediction abstains."""
    t, p = F.col(truth) == "INDUSTRIAL", F.col(predicted) == "INDUSTRIAL"
    c = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    g = rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), c(t & p).alias("tp"), c(~t & p).alias("fp"), c(~t & ~p).alias("tn"), c(t & ~p).alias("fn"), F.count_if(F.col(predicted).isNull()).alias("abstained"))
    r = lambda a, b: F.try_divide(a, b)
    tp, fp, tn, fn = (F.col(k) for k in ("tp", "fp", "tn", "fn"))
    g = g.withColumns({"precision": r(tp, tp + fp), "recall": r(tp, tp + fn), "specificity": r(tn, tn + fp), "npv": r(tn, tn + fn), "accuracy": r(tp + tn, tp + tn + fp + fn), "f1": r(2 * tp, 2 * tp + fp + fn), "coverage": r(F.col("n") - F.col("abstained"), F.col("n")), "abstention_rate": r(F.col("abstained"), F.col("n"))})
    return g.withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2)


def confusion(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Per class: support, precision, recall, f1."""
    pairs = saved(confusion(rows, truth, predicted), "confusion")  # a row for each pair of classes; read twice
    t = pairs.groupBy(F.col(truth).alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)).alias("tp"))
    p = pairs.groupBy(F.col(predicted).alias("label")).agg(F.sum("n").alias("claimed"))
    out = t.join(p, "label", "full").na.fill(0, ["support", "tp", "claimed"])
    return out.select("label", "support", F.try_divide("tp", "claimed").alias("precision"), F.try_divide("tp", "support").alias("recall"), F.try_divide(2 * F.col("tp"), F.col("claimed") + F.col("support")).alias("f1"))


def class_averages(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """One row: macro precision, recall and f1 over classes that occur, f1 weighted by support, rows."""
    c = class_metrics(rows, truth, predicted).where("support > 0")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    return c.agg(F.avg(zero("precision")).alias("macro_precision"), F.avg(zero("recall")).alias("macro_recall"), F.avg(zero("f1")).alias("macro_f1"), F.try_divide(F.sum(zero("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"), F.sum("support").alias("sample_count"))


def thresholds(rows: DataFrame, floors: tuple[int, ...] = (0, 4, 6, 8, 10), score: str = "industrial_evidence_score", truth: str = "truth") -> DataFrame:
    """binary_metrics of score >= floor for each floor, in one pass over rows."""
    each = rows.withColumn("floor", F.explode(F.array(*[F.lit(f) for f in floors])))
    return binary_metrics(each.withColumn("predicted", F.when(F.col(score) >= F.col("floor"), "INDUSTRIAL").otherwise("NON_INDUSTRIAL")), truth, "predicted", ["floor"])


#: Families that each variant adds to the infrastructure score.
VARIANTS = {
    "infrastructure_only": (),
    "infrastructure_plus_temporal": ("temporal",),
    "infrastructure_plus_history": ("history",),
    "infrastructure_plus_anomaly": ("anomaly",),
    "infrastructure_plus_temporal_history_anomaly": ("temporal", "history", "anomaly"),
}
FULL = "full_available_i7"


def evaluable(rows: DataFrame) -> DataFrame:
    """Matches to one event by references from an independent source."""
    return rows.where((F.col("match_status") == "MATCHED") & F.coalesce(F.col("independent"), F.lit(False)))


def gated_candidate(method: Column, infrastructure: Column, temporal: Column, history: Column, anomaly: Column) -> Column:
    """The interpretation by facility, persistence, history and anomaly alone; the last two count only where there is a facility."""
    backing = temporal + F.when(infrastructure > 0, F.least(history, F.lit(2)) + F.least(anomaly, F.lit(2))).otherwise(0)
    possible = ((infrastructure >= 2) & (backing >= 1)) | ((infrastructure >= 1) & (backing >= 2))
    return F.when(method == "AMBIGUOUS", "AMBIGUOUS_EVIDENCE").when(infrastructure >= 3, "INDUSTRIAL_ACTIVITY_CANDIDATE").when(possible, "POSSIBLE_INDUSTRIAL_ACTIVITY").otherwise("INSUFFICIENT_EVIDENCE")


def ablation(rows: DataFrame, truth: str = "truth") -> DataFrame:
    """binary_metrics of the candidates that subsets of the families give, and of the candidate at hand, over evaluable rows."""
    zero = F.lit(0)
    scores = {"temporal": F.col("temporal_score"), "history": F.col("historical_score"), "anomaly": F.col("anomaly_support_score")}
    made = [F.struct(F.lit(name).alias("variant"), gated_candidate(F.col("facility_association_method"), F.col("infrastructure_score"), *[scores[f] if f in families else zero for f in scores]).alias("candidate")) for name, families in VARIANTS.items()]
    made.append(F.struct(F.lit(FULL).alias("variant"), F.col("candidate_interpretation").alias("candidate")))
    each = evaluable(rows).withColumn("v", F.explode(F.array(*made))).select(truth, "v.variant", to_binary(F.col("v.candidate")).alias("predicted"))
    return binary_metrics(each, truth, "predicted", ["variant"])


#: The kinds of disagreement.
ERRORS = ("FALSE_INDUSTRIAL", "MISSED_INDUSTRIAL", "FALSE_NON_INDUSTRIAL", "ABSTENTION_ON_INDUSTRIAL", "ABSTENTION_ON_NON_INDUSTRIAL", "AMBIGUOUS_OR_UNKNOWN_LABEL", "MULTIPLE_POSSIBLE_MATCHES")


def errors(rows: DataFrame, examples: int = 5) -> DataFrame:
    """(category, n, examples): kinds of disagreement over evaluable rows, each with its first validation_id:event_id, and references with several matches.

    All kinds come out, those without a case with n = 0.
    """
    rows = saved(rows.select("validation_id", "event_id", "truth", "candidate_interpretation", "match_status", "independent"), "matches")  # read three times
    t, p = F.col("truth"), to_binary(F.col("candidate_interpretation"))
    kind = F.when(t.isin("AMBIGUOUS", "UNKNOWN"), "AMBIGUOUS_OR_UNKNOWN_LABEL").when(p.isNull(), F.when(t == "INDUSTRIAL", "ABSTENTION_ON_INDUSTRIAL").otherwise("ABSTENTION_ON_NON_INDUSTRIAL"))
    kind = kind.when((t == "INDUSTRIAL") & (p != "INDUSTRIAL"), "MISSED_INDUSTRIAL").when((t != "INDUSTRIAL") & (p == "INDUSTRIAL"), "FALSE_INDUSTRIAL")
    own = evaluable(rows).select(kind.alias("category"), F.concat_ws(":", F.col("validation_id").cast("string"), F.col("event_id").cast("string")).alias("key"))
    several = rows.where(F.col("match_status") == "MULTIPLE_POSSIBLE_MATCHES").select(F.lit("MULTIPLE_POSSIBLE_MATCHES").alias("category"), F.col("validation_id").cast("string").alias("key"))
    each = own.where("category is not null").union(several)
    first = each.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy("key"))).where(F.col("k") <= examples).groupBy("category").agg(F.array_sort(F.collect_list("key")).alias("examples"))
    counts = each.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    kinds = rows.sparkSession.createDataFrame([(k,) for k in ERRORS], "category string")
    none = F.array().cast("array<string>")
    return kinds.join(counts, "category", "left").join(first, "category", "left").select("category", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("examples", none).alias("examples"))


def strength_precision(rows: DataFrame, truth: str = "truth") -> DataFrame:
    """By evidence_strength: what is predicted industrial, how much of it is, and all rows that do not abstain.

    A description only: the scores are ordinal and no probability is fitted to them.
    """
    p = to_binary(F.col("candidate_interpretation"))
    kept = rows.withColumns({"p": p, "strength": F.coalesce(F.nullif("evidence_strength", F.lit("")), F.lit("UNKNOWN"))}).where("p is not null")
    yes = F.col("p") == "INDUSTRIAL"
    out = kept.groupBy("strength").agg(F.count_if(yes).alias("predicted_industrial_count"), F.count_if(yes & (F.col(truth) == "INDUSTRIAL")).alias("tp"), F.count(F.lit(1)).alias("sample_count"))
    return out.select("strength", "predicted_industrial_count", F.try_divide("tp", "predicted_industrial_count").alias("precision"), "sample_count")


METRICS = ("precision", "recall", "f1", "specificity", "balanced_accuracy", "accuracy", "ppv", "npv", "confusion_matrix")


def not_evaluated(reason: str) -> dict:
    """The block that stands for metrics of nothing: no number is made up."""
    return {"metric_status": "NOT_EVALUATED", "reason": reason, **dict.fromkeys(METRICS), "sample_count": 0}


def report(rows: DataFrame, truth: str = "truth") -> dict:
    """All metrics of matched references as one dictionary, or the block for none."""
    good = evaluable(rows)
    if good.isEmpty():
        return not_evaluated("No independent MATCHED records.")
    judged = good.withColumn("predicted", to_binary(F.col("candidate_interpretation")))
    plain = lambda df: [r.asDict(recursive=True) for r in df.collect()]  # noqa: E731  (a few rows each)
    return {"metric_status": "EVALUATED", "binary": plain(binary_metrics(judged, truth))[0], "ablation": plain(ablation(rows, truth)), "errors": plain(errors(rows)), "strength": plain(strength_precision(good, truth))}


def audit(references: DataFrame) -> DataFrame:
    """Rows, missing places and dates, repeated ids, ranges."""
    return references.agg(F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - F.count_distinct("validation_id")).alias("duplicate_ids"), F.count_if(F.col("reference_latitude").isNull() | F.col("reference_longitude").isNull()).alias("missing_place"), F.count_if(F.col("reference_date").isNull()).alias("missing_date"), F.min("reference_date").alias("first_date"), F.max("reference_date").alias("last_date"))


def leakage(references: DataFrame, tokens: tuple[str, ...] = ("firms", "viirs", "modis", "osm")) -> DataFrame:
    """References whose source names an input of the engine."""
    t = F.lower(F.coalesce(F.col("reference_source"), F.lit("")))
    return references.agg(*[F.count_if(F.contains(t, F.lit(k))).alias(f"mentions_{k}") for k in tokens])
