"""Queries over the test tables, one for each group of operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from calorine.adapters import tables as a
from calorine.functions.geo import box_rings, haversine
from calorine.functions.parsing import observation_hash
from calorine.functions.session import saved
from calorine.plans import anomaly, association, clean, environment, events, facilities, fingerprint, fusion, risk, serve, sta, validation
from calorine.streaming import nrt

# ---------------------------------------------------------------- event formation
def _formed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return events.form(a.detections(s, d))


def event_features(s: SparkSession, d: str) -> DataFrame:
    return events.features(_formed(s, d)[0])


def event_noise(s: SparkSession, d: str) -> DataFrame:
    return _formed(s, d)[1].select("det_id", "spatiotemporal_neighbor_count", "noise_reason")


def event_persistence(s: SparkSession, d: str) -> DataFrame:
    return events.persistence(event_features(s, d)).select("event_id", "span_days", "duty_cycle", "persistence_label")


def persistence_counts(s: SparkSession, d: str) -> DataFrame:
    return event_persistence(s, d).groupBy("persistence_label").agg(F.count(F.lit(1)).alias("n"))


def confidence_distribution(s: SparkSession, d: str) -> DataFrame:
    made = events.confidence_distribution(_formed(s, d)[0])
    return made.select("event_id", F.array_join(F.transform(F.map_entries("confidence_distribution"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("distribution"))


def event_footprints(s: SparkSession, d: str) -> DataFrame:
    return events.footprints(_formed(s, d)[0])


_ISLANDS = f"""d as ({a.DETECTIONS_SQL}),
g as (select *, case when lag(acq_datetime) over w is null or epoch_us(acq_datetime) - epoch_us(lag(acq_datetime) over w) > 129600000000 then 1 else 0 end as fresh from d window w as (partition by site order by acq_datetime, det_id)),
i as (select *, sum(fresh) over (partition by site order by acq_datetime, det_id) as island from g),
c as (select *, count(*) over (partition by site, island) as size, min(det_id) over (partition by site, island) as cluster, min(acq_datetime) over (partition by site, island) as t0 from i),
n as (select site, island, printf('EVT_%07d', row_number() over (order by min(t0), min(cluster))) as event_id from c where size > 1 group by site, island),
l as (select c.*, n.event_id from c join n using (site, island)),
p as (select *, case when frp_valid then frp end as pw, (epoch_us(acq_datetime) - epoch_us(lag(acq_datetime) over (partition by event_id order by acq_datetime, det_id))) / 3.6e9 as gap from l),
m as (select *, median(pw) over (partition by event_id) as pm from p)"""
_FEATURES = f"""{_ISLANDS},
f as (select event_id, cast(count(*) as integer) as detection_count, avg(latitude) as centroid_latitude, avg(longitude) as centroid_longitude, min(latitude) as min_latitude, max(latitude) as max_latitude, min(longitude) as min_longitude, max(longitude) as max_longitude,
  min(acq_datetime) as event_start, max(acq_datetime) as event_end, (epoch_us(max(acq_datetime)) - epoch_us(min(acq_datetime))) / 3.6e9 as observed_duration_hours, cast(count(distinct cast(acq_datetime as date)) as integer) as distinct_detection_days, avg(gap) as mean_gap_hours, max(gap) as max_gap_hours,
  case when max(acq_datetime) > min(acq_datetime) then count(*) / ((epoch_us(max(acq_datetime)) - epoch_us(min(acq_datetime))) / 3.6e9 / 24) end as detection_frequency_per_day,
  max(pw) as peak_frp, avg(pw) as mean_frp, median(pw) as median_frp, stddev_pop(pw) as frp_std, median(abs(pw - pm)) as frp_mad, sum(pw) as total_frp, cast(count(pw) as integer) as frp_valid_count,
  max(bright_ti4) as max_bright_ti4, avg(bright_ti4) as mean_bright_ti4, max(bright_ti5) as max_bright_ti5, avg(bright_ti5) as mean_bright_ti5,
  cast(count(*) filter (where daynight = 'D') as integer) as day_detection_count, cast(count(*) filter (where daynight = 'N') as integer) as night_detection_count,
  cast(count(*) filter (where confidence = 'n') as integer) as nominal_confidence_count, cast(count(*) filter (where confidence = 'l') as integer) as low_confidence_count, cast(count(*) filter (where confidence = 'h') as integer) as high_confidence_count
  from m group by event_id)"""
_PERSISTENCE = f"""{_FEATURES},
s as (select *, cast(date_diff('day', cast(event_start as date), cast(event_end as date)) + 1 as integer) as span_days from f),
u as (select *, least(distinct_detection_days / cast(span_days as double), 1.0) as duty_cycle from s),
q as (select event_id, span_days, duty_cycle, case when detection_count < 3 then 'INSUFFICIENT_OBSERVATIONS' when observed_duration_hours <= 48 then 'SHORT_LIVED' when duty_cycle >= 0.85 or coalesce(max_gap_hours <= 24, false) then 'PERSISTENT' else 'RECURRING' end as persistence_label from u)"""


# ---------------------------------------------------------------- association
def association_selection(s: SparkSession, d: str) -> DataFrame:
    formed = event_features(s, d).select("event_id", "centroid_latitude", "centroid_longitude", F.lit(None).cast("string").alias("centroid_wkt"), F.lit(None).cast("string").alias("footprint_wkt"))
    out, _ = association.associate(saved(formed, "event-places"), a.facilities(s, d))
    return out.drop("centroid_wkt", "footprint_wkt")


def association_candidates(s: SparkSession, d: str) -> DataFrame:
    return association.associate(events.shapes(_formed(s, d)[0]), a.facilities(s, d))[1]


def association_histogram(s: SparkSession, d: str) -> DataFrame:
    return association.candidate_histogram(association_selection(s, d))


# ---------------------------------------------------------------- baselines and anomaly
def _universe(s: SparkSession, d: str) -> DataFrame:
    return s.range(97).select(F.concat(F.lit("osm_way_"), F.col("id").cast("string")).alias("facility_id"), F.lit("F").alias("facility_name"), F.lit("REFINERY").alias("facility_type"))


def facility_fingerprints(s: SparkSession, d: str) -> DataFrame:
    return fingerprint.fingerprints(a.events(s, d), _universe(s, d)).select("facility_id", "event_count", "total_detections", "observation_day_count", "observation_span_days", "active_months", "peak_frp_median", "peak_frp_mad", "peak_frp_p25", "peak_frp_p75", "peak_frp_p90", "peak_frp_max", "duration_median", "duration_mad", "distance_median", "detection_count_p90", "daynight_day_count", "daynight_mixed_count", "label_persistent_count", "label_recurring_fraction", "method_within_facility_count", "confidence_high_fraction", "ambiguous_opportunity_count", "baseline_history_status")


def facility_monthly_profile(s: SparkSession, d: str) -> DataFrame:
    return fingerprint.monthly_profile(a.events(s, d))


def anomaly_scores(s: SparkSession, d: str) -> DataFrame:
    base = a.events(s, d).drop("anomaly_status", "anomaly_score", "anomaly_history_status")
    return anomaly.score(base).select("event_id", "baseline_observation_count", "anomaly_history_status", "peak_frp_baseline_median", "peak_frp_deviation", "detection_count_deviation", "persistence_deviation", "monthly_deviation", "anomaly_feature_count", "anomaly_score", "anomaly_status", "anomaly_confidence", "anomaly_unavailable_reason")


def _dev(x: str, p: str) -> str:
    m, q = f"list_aggregate({p}, 'median')", lambda v: f"list_aggregate({p}, 'quantile_cont', {v})"
    mad = f"list_aggregate(list_transform({p}, lambda v: abs(v - {p}_med)), 'median')"
    gap = f"abs({x} - {p}_med)"
    return f"case when len({p}) >= 3 then case when {mad} > 0 then {gap} / {mad} when {gap} <= 1e-15 then 0.0 when {q(0.75)} - {q(0.25)} > 0 then {gap} / ({q(0.75)} - {q(0.25)}) when {x} is not null then 3.0 end end"


_ANOMALY = f"""
with e as (select *, coalesce(facility_id is not null and facility_association_method in ('WITHIN_FACILITY','INTERSECTS_FACILITY','NEAR_FACILITY'), false) as ok from ({a.EVENTS_SQL})),
k as (select *, case when ok then 'f' || facility_id else 'e' || event_id end as key from e),
w as (select *,
  list(peak_frp) filter (where peak_frp is not null) over p as a1, list(cast(detection_count as double)) over p as a2, list(observed_duration_hours) over p as a3, list(facility_distance_km) filter (where facility_distance_km is not null) over p as a4,
  list(persistence_label) filter (where persistence_label is not null) over p as labs, list(peak_frp) filter (where peak_frp is not null) over pm as a6
  from k window p as (partition by key order by event_start, event_id rows between unbounded preceding and 1 preceding), pm as (partition by key, month(event_start) order by event_start, event_id rows between unbounded preceding and 1 preceding)),
x as (select *, coalesce(len(labs), 0) as nl, list_aggregate(a1, 'median') as a1_med, list_aggregate(a2, 'median') as a2_med, list_aggregate(a3, 'median') as a3_med, list_aggregate(a4, 'median') as a4_med, list_aggregate(a6, 'median') as a6_med from w),
h as (select *, case when ok then nl else 0 end as n, case when not ok then 'NOT_APPLICABLE' when nl = 0 then 'NO_PRIOR_OBSERVATIONS' when nl < 3 then 'INSUFFICIENT_HISTORY' when nl < 10 then 'LIMITED_HISTORY' else 'ESTABLISHED_BASELINE' end as hist from x),
d as (select *, {_dev('peak_frp', 'a1')} as d1, {_dev('detection_count', 'a2')} as d2, {_dev('observed_duration_hours', 'a3')} as d3, {_dev('facility_distance_km', 'a4')} as d4, {_dev('peak_frp', 'a6')} as d6,
  case when nl >= 3 and persistence_label is not null then case when len(list_filter(labs, lambda v: v = persistence_label)) / cast(nl as double) >= 0.5 then 0.0 else 3 * (1 - len(list_filter(labs, lambda v: v = persistence_label)) / cast(nl as double) / 0.5) end end as d5 from h),
u as (select *, hist in ('LIMITED_HISTORY', 'ESTABLISHED_BASELINE') as usable from d),
v as (select * replace (case when usable then d1 end as d1, case when usable then d2 end as d2, case when usable then d3 end as d3, case when usable then d4 end as d4, case when usable then d5 end as d5, case when usable then d6 end as d6) from u),
t as (select *, coalesce(d1*0.3,0)+coalesce(d2*0.2,0)+coalesce(d3*0.2,0)+coalesce(d4*0.1,0)+coalesce(d5*0.1,0)+coalesce(d6*0.1,0) as total, (case when d1 is null then 0 else 0.3e0 end)+(case when d2 is null then 0 else 0.2e0 end)+(case when d3 is null then 0 else 0.2e0 end)+(case when d4 is null then 0 else 0.1e0 end)+(case when d5 is null then 0 else 0.1e0 end)+(case when d6 is null then 0 else 0.1e0 end) as weight,
  (d1 is not null)::int+(d2 is not null)::int+(d3 is not null)::int+(d4 is not null)::int+(d5 is not null)::int+(d6 is not null)::int as used from v),
z as (select *, case when weight > 0 then total / weight end as sc from t)
select event_id, cast(n as integer) as baseline_observation_count, hist as anomaly_history_status, case when ok and len(a1) >= 3 then a1_med end as peak_frp_baseline_median, d1 as peak_frp_deviation, d2 as detection_count_deviation, d5 as persistence_deviation, d6 as monthly_deviation, used as anomaly_feature_count, sc as anomaly_score,
  case when sc is null then 'INSUFFICIENT_HISTORY' when sc < 2 then 'NORMAL' when sc < 3.5 then 'ELEVATED' else 'ANOMALOUS' end as anomaly_status,
  case when sc is null then 'NONE' when hist = 'LIMITED_HISTORY' then case when used < 3 then 'LOW' else 'MEDIUM' end when used >= 4 then 'HIGH' when used >= 2 then 'MEDIUM' else 'LOW' end as anomaly_confidence,
  case when not ok then case when facility_association_method = 'AMBIGUOUS' then 'AMBIGUOUS_ASSOCIATION' else 'NO_FACILITY_ASSOCIATION' end when sc is null then hist end as anomaly_unavailable_reason from z"""
_FINGERPRINT = f"""
with e as ({a.EVENTS_SQL}), o as (select *, median(peak_frp) over (partition by facility_id) as pm, median(observed_duration_hours) over (partition by facility_id) as dm from e where facility_id is not null),
s as (select facility_id, cast(count(*) as integer) as event_count, cast(sum(detection_count) as bigint) as total_detections, cast(sum(distinct_detection_days) as bigint) as observation_day_count, cast(date_diff('day', cast(min(event_start) as date), cast(max(event_end) as date)) + 1 as integer) as observation_span_days, cast(count(distinct month(event_start)) as integer) as active_months,
 median(peak_frp) as peak_frp_median, median(abs(peak_frp - pm)) as peak_frp_mad, quantile_cont(peak_frp, 0.25) as peak_frp_p25, quantile_cont(peak_frp, 0.75) as peak_frp_p75, quantile_cont(peak_frp, 0.9) as peak_frp_p90, max(peak_frp) as peak_frp_max, median(observed_duration_hours) as duration_median, median(abs(observed_duration_hours - dm)) as duration_mad, median(facility_distance_km) as distance_median, quantile_cont(cast(detection_count as double), 0.9) as detection_count_p90,
 cast(count(*) filter (where night_detection_count = 0 and day_detection_count > 0) as integer) as daynight_day_count, cast(count(*) filter (where night_detection_count > 0 and day_detection_count > 0) as integer) as daynight_mixed_count, cast(count(*) filter (where persistence_label = 'PERSISTENT') as integer) as label_persistent_count, count(*) filter (where persistence_label = 'RECURRING') / cast(count(*) as double) as label_recurring_fraction, cast(count(*) filter (where facility_association_method = 'WITHIN_FACILITY') as integer) as method_within_facility_count, count(*) filter (where facility_attribution_confidence = 'HIGH') / cast(count(*) as double) as confidence_high_fraction from o group by facility_id),
m as (select f as facility_id, count(*) as n from (select unnest(string_split(candidate_facility_ids, ',')) as f from e where facility_association_method = 'AMBIGUOUS') group by f),
u as (select 'osm_way_' || cast(i as varchar) as facility_id from range(97) t(i))
select u.facility_id, coalesce(s.event_count, 0) as event_count, coalesce(total_detections, 0) as total_detections, coalesce(observation_day_count, 0) as observation_day_count, s.* exclude (facility_id, event_count, total_detections, observation_day_count), coalesce(m.n, 0) as ambiguous_opportunity_count,
 case when coalesce(s.event_count, 0) = 0 then 'NO_OBSERVATIONS' when s.event_count < 3 then 'INSUFFICIENT_HISTORY' when s.event_count < 10 then 'LIMITED_HISTORY' else 'ESTABLISHED_BASELINE' end as baseline_history_status
from u left join s using (facility_id) left join m on m.facility_id = u.facility_id"""


# ---------------------------------------------------------------- fusion and risk
def evidence_fusion(s: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(a.events(s, d)).select("event_id", "infrastructure_score", "temporal_score", "historical_score", "anomaly_support_score", "sta_score", "environmental_score", "industrial_evidence_score", "corroboration_score", "evidence_strength", "evidence_coverage", "evidence_conflict_codes", "candidate_interpretation", "evidence_sufficiency", "interpretation_uncertainty", "interpretation_confidence")


def _scored(s: SparkSession, d: str) -> DataFrame:
    return risk.prioritize(fusion.fuse(a.events(s, d)))


def risk_priority(s: SparkSession, d: str) -> DataFrame:
    return _scored(s, d).select("event_id", "thermal_severity_score", "thermal_severity_band", "persistence_priority_score", "anomaly_priority_score", "facility_context_score", "industrial_evidence_component", "ambiguity_dampening", "risk_score", "investigation_priority", "recommended_action", "industrial_context", "uncertainty_score", "uncertainty_band", "uncertainty_factors")


def risk_explanations(s: SparkSession, d: str) -> DataFrame:
    return _scored(s, d).select("event_id", "dominant_risk_factors", "priority_explanation", "risk_limiting_codes")


def risk_crosstab(s: SparkSession, d: str) -> DataFrame:
    return risk.crosstab(_scored(s, d))


def risk_tokens(s: SparkSession, d: str) -> DataFrame:
    return risk.token_tallies(_scored(s, d))


def risk_distribution(s: SparkSession, d: str) -> DataFrame:
    return risk.distribution(_scored(s, d))


_FUSION = f"""e as (select *, facility_association_method as m, facility_attribution_confidence as cf, facility_type as ft, coalesce(persistence_label, 'UNAVAILABLE') as pl, vegetation_available as env, case when vegetation_available then vegetation_present else false end as veg, case when agriculture_available then agriculture_present else false end as ag, case when builtup_available then builtup_present else false end as bu, sta_association_status as sg from ({a.EVENTS_SQL})),
f1 as (select *, case when m in ('WITHIN_FACILITY','INTERSECTS_FACILITY') then case when coalesce(ft in ('REFINERY','POWER_PLANT','MINE','LNG_TERMINAL'), false) and cf in ('HIGH','MEDIUM') then 3 when coalesce(ft in ('OTHER_INDUSTRIAL','INDUSTRIAL_AREA','UNKNOWN'), false) and cf <> 'HIGH' then 2 when cf = 'LOW' then 2 else 3 end
   when m = 'NEAR_FACILITY' then case when cf in ('MEDIUM','HIGH') or (coalesce(ft in ('REFINERY','POWER_PLANT','MINE','LNG_TERMINAL'), false) and cf = 'LOW') then 2 else 1 end else 0 end as i,
  case when pl in ('PERSISTENT','RECURRING') then 2 else 0 end as t, case when m like '%_FACILITY' and m <> 'NO_FACILITY_ASSOCIATION' then case baseline_history_status when 'ESTABLISHED_BASELINE' then 3 when 'LIMITED_HISTORY' then 2 when 'INSUFFICIENT_HISTORY' then 1 else 0 end else 0 end as h,
  case anomaly_status when 'ANOMALOUS' then 2 when 'ELEVATED' then 1 else 0 end as an, case when sg = 'STA_ASSOCIATED' then case when sta_evidence_quality in ('HIGH','MEDIUM') then 2 else 1 end else 0 end as st, case when env then least(3, veg::int * 2 + ag::int * 2) else 0 end as en from e),
f2 as (select *, case when i > 0 then least(h, 2) + least(an, 2) else 0 end as backed from f1),
f3 as (select *, least(14, 2 * i + t + backed + st + case when i > 0 then bu::int else 0 end) as x, t + backed + st as c, case when m = 'AMBIGUOUS' then 'A' when m = 'NO_FACILITY_ASSOCIATION' then 'N' else 'C' end as ac, 3 + env::int as pres from f2),
f4 as (select *, concat_ws(';', case when ac = 'C' and env and ag then 'FACILITY_VS_AGRICULTURE' end, case when ac = 'C' and env and veg and not bu then 'FACILITY_VS_VEGETATION' end, case when sg in ('STA_ASSOCIATED','AMBIGUOUS') and ac = 'N' and env and veg then 'STA_WITHOUT_FACILITY_WITH_VEGETATION' end, case when ac = 'A' and sg = 'STA_ASSOCIATED' then 'AMBIGUOUS_FACILITY_WITH_STA' end, case when ac = 'N' and env and ag and veg then 'AGRICULTURE_AND_VEGETATION_BOTH_PRESENT' end) as cc from f3),
f5 as (select *, case when ac = 'A' or (sg = 'AMBIGUOUS' and i <= 0) then 1 when cc <> '' and i >= 2 and en >= 2 then 2 when x >= 6 and i >= 2 and en >= 2 then 2 when ag and i <= 0 then 4 when veg and i <= 0 then 5 when i >= 3 then 6 when (i >= 2 and c >= 1) or (i >= 1 and c >= 2) then 7 when i >= 1 then 8 else 9 end as b from f4),
f6 as (select *, case b when 1 then 'AMBIGUOUS_EVIDENCE' when 2 then 'MIXED_OR_CONFLICTING' when 4 then 'ENVIRONMENTAL_AGRICULTURE_CONTEXT' when 5 then 'ENVIRONMENTAL_VEGETATION_CONTEXT' when 6 then 'INDUSTRIAL_ACTIVITY_CANDIDATE' when 7 then 'POSSIBLE_INDUSTRIAL_ACTIVITY' else 'INSUFFICIENT_EVIDENCE' end as cand, case when b = 6 then case when c >= 3 and st > 0 then 'LOW' when c >= 2 and pres >= 2 then 'MEDIUM' else 'HIGH' end when b = 9 and pres <= 2 then 'VERY_HIGH' else 'HIGH' end as un from f5)"""
_RISK = f"""{_FUSION},
r1 as (select *, coalesce(peak_frp, 0) as p0, row_number() over (order by coalesce(peak_frp, 0), event_id) as rn, count(*) over () as nn from f6),
r2 as (select *, 0.7e0 * (0.6e0 * greatest(0, least(1, ln(1 + greatest(p0, 0)) / 8)) + 0.25e0 * least(1, detection_count / 50.0e0) + 0.15e0 * least(1, observed_duration_hours / 168e0)) + 0.3e0 * case when p0 > 0 then (rn - 1) / cast(greatest(nn - 1, 1) as double) else 0 end as lv,
  case coalesce(persistence_label, '') when 'RECURRING' then 1.0e0 when 'PERSISTENT' then 0.85e0 when 'SHORT_LIVED' then 0.25e0 else 0 end * 15 as s2, case anomaly_status when 'ANOMALOUS' then 1.0e0 when 'ELEVATED' then 0.55e0 when 'NORMAL' then 0.10e0 else 0e0 end as al,
  case m when 'WITHIN_FACILITY' then 1.0e0 when 'INTERSECTS_FACILITY' then 0.95e0 when 'NEAR_FACILITY' then 0.45e0 else 0 end as rel, case ft when 'REFINERY' then 1.0e0 when 'LNG_TERMINAL' then 1.0e0 when 'POWER_PLANT' then 0.9e0 when 'MINE' then 0.75e0 when 'INDUSTRIAL_AREA' then 0.6e0 when 'OTHER_INDUSTRIAL' then 0.5e0 else 0.35e0 end as tw, case cf when 'HIGH' then 1.0e0 when 'MEDIUM' then 0.75e0 when 'LOW' then 0.45e0 else 0 end as cw from r1),
r3 as (select *, 25 * greatest(0, least(1, lv)) as s1, 25 * case when anomaly_score is not null and al > 0 then least(1, al + 0.15e0 * greatest(0, least(0.25e0, anomaly_score / 5))) else al end as s3, 15 * case when m = 'NO_FACILITY_ASSOCIATION' then 0 when m = 'AMBIGUOUS' then 0.2e0 else rel * (0.55e0 + 0.45e0 * tw) * (0.4e0 + 0.6e0 * cw) end as s4, 20 * greatest(0, least(1, x / 14.0e0)) as s5 from r2),
r4 as (select *, round_even(s1, 4) as q1, round_even(s2, 4) as q2, round_even(s3, 4) as q3, round_even(s4, 4) as q4, round_even(s5, 4) as q5 from r3),
r5 as (select *, q1 + q2 + q3 + q4 + q5 as tot from r4),
r6 as (select *, case when m = 'AMBIGUOUS' or cand = 'AMBIGUOUS_EVIDENCE' then least(8, 0.12e0 * tot) else 0e0 end as dp from r5),
r7 as (select *, greatest(0, least(100, tot - dp)) as rw, case when lv >= 0.85 then 'EXTREME' when lv >= 0.6 then 'HIGH' when lv >= 0.3 then 'MODERATE' else 'LOW' end as band from r6),
r8 as (select *, case when rw >= 75 then 'CRITICAL' when rw >= 50 then 'HIGH' when rw >= 25 or band = 'EXTREME' then 'MEDIUM' else 'LOW' end as pr, m = 'NO_FACILITY_ASSOCIATION' as u1, m = 'AMBIGUOUS' as u2, m not in ('NO_FACILITY_ASSOCIATION', 'AMBIGUOUS') and cf = 'LOW' as u3, anomaly_history_status in ('NO_PRIOR_OBSERVATIONS', 'INSUFFICIENT_HISTORY', 'NOT_APPLICABLE') as u4, coalesce(persistence_label = 'INSUFFICIENT_OBSERVATIONS', false) as u5, anomaly_status = 'INSUFFICIENT_HISTORY' as u6, not sta_evidence_available as u7, not environmental_context_available as u8 from r7),
r9 as (select *, least(100e0, u1::int * 25 + u2::int * 30 + u3::int * 12 + u4::int * 15 + u5::int * 10 + u6::int * 10 + u7::int * 8 + u8::int * 8) as us from r8),
r as (select event_id, q1 as thermal_severity_score, band as thermal_severity_band, q2 as persistence_priority_score, q3 as anomaly_priority_score, q4 as facility_context_score, q5 as industrial_evidence_component, round_even(dp, 4) as ambiguity_dampening, round_even(rw, 4) as risk_score, pr as investigation_priority, case pr when 'CRITICAL' then 'URGENT_REVIEW' when 'HIGH' then 'PRIORITIZE_INVESTIGATION' when 'MEDIUM' then 'REVIEW' else 'MONITOR' end as recommended_action,
 case cand when 'INDUSTRIAL_ACTIVITY_CANDIDATE' then 'STRONG' when 'POSSIBLE_INDUSTRIAL_ACTIVITY' then 'POSSIBLE' when 'AMBIGUOUS_EVIDENCE' then 'AMBIGUOUS' when 'MIXED_OR_CONFLICTING' then 'AMBIGUOUS' else 'INSUFFICIENT' end as industrial_context, us as uncertainty_score, case when us >= 70 then 'VERY_HIGH' when us >= 45 then 'HIGH' when us >= 25 then 'MODERATE' else 'LOW' end as uncertainty_band,
 concat_ws(';', case when u1 then 'NO_FACILITY_ASSOCIATION' end, case when u2 then 'AMBIGUOUS_FACILITY_ASSOCIATION' end, case when u3 then 'LOW_FACILITY_ATTRIBUTION_CONFIDENCE' end, case when u4 then 'INSUFFICIENT_OR_NO_FACILITY_HISTORY' end, case when u5 then 'INSUFFICIENT_OBSERVATIONS' end, case when u6 then 'NO_ANOMALY_BASELINE' end, case when u7 then 'STA_UNAVAILABLE' end, case when u8 then 'ENVIRONMENTAL_CONTEXT_UNAVAILABLE' end) as uncertainty_factors from r9)"""


# ---------------------------------------------------------------- cleaning
def clean_counts(s: SparkSession, d: str) -> DataFrame:
    return clean.quality_counts(a.raw(s, d)).select("rows_in", "latitude_missing", "latitude_invalid", "longitude_missing", "frp_missing", "frp_negative", "frp_valid_rows", "coords_invalid", "time_invalid", "duplicates", "rows_out")


def clean_detections(s: SparkSession, d: str) -> DataFrame:
    return clean.clean(a.raw(s, d)).select("row_no", "latitude", "longitude", "frp", "frp_valid", "confidence", "daynight", "acq_datetime", "hour_utc", "day_of_week", "month", "day_of_year")


def observation_hashes(s: SparkSession, d: str) -> DataFrame:
    return a.raw(s, d).select("row_no", observation_hash().alias("observation_hash"))


_CLEAN = f"""x as ({a.RAW_SQL}),
y as (select row_no, case when lower(trim(latitude)) in ('', 'nan') then null else try_cast(latitude as double) end as lat, case when lower(trim(longitude)) in ('', 'nan') then null else try_cast(longitude as double) end as lon, try_cast(nullif(trim(frp), '') as double) as f, lower(trim(latitude)) in ('', 'nan') as latm, lower(trim(longitude)) in ('', 'nan') as lonm, trim(frp) = '' as fm, case when regexp_matches(trim(confidence), '^[A-Za-z]+$') then lower(trim(confidence)) else trim(confidence) end as confidence, upper(trim(daynight)) as daynight, try_cast(acq_date as date) as dt, acq_date, cast(acq_time as integer) as hm, acq_time from x),
z as (select *, case when hm between 0 and 2359 and hm % 100 <= 59 then dt + to_minutes(cast(floor(hm / 100) * 60 + hm % 100 as bigint)) end as t, row_number() over (partition by lat, lon, f, confidence, daynight, acq_date, acq_time order by row_no) as r, coalesce(lat between -90 and 90 and lon between -180 and 180, false) as ok from y)"""


# ---------------------------------------------------------------- facilities, sta, environment
def facility_ingest(s: SparkSession, d: str) -> DataFrame:
    """Map objects with tags by part type, from parts."""
    p = a.table(s, d, "part")
    k = F.col("p_partkey")
    m = F.map_filter(F.create_map(F.lit("industrial"), F.when(k % 5 == 0, F.when(k % 10 == 0, "refinery").otherwise("mine")), F.lit("power"), F.when(k % 7 == 0, F.lit("plant")), F.lit("landuse"), F.when(k % 3 == 0, F.when(k % 6 == 0, "quarry").otherwise("industrial")), F.lit("man_made"), F.when(k % 11 == 0, "works")), lambda _, v: v.isNotNull())
    lon, lat = F.expr("cast(70 + p_partkey % 400 * 0.05 as double)"), F.expr("cast(8 + p_partkey % 300 * 0.05 as double)")
    raw = p.select(F.lit("way").alias("osm_type"), k.cast("string").alias("osm_id"), F.col("p_name").alias("name"), m.alias("tags"), F.lit("Polygon").alias("geometry_type"), box_rings(lon, lat, lon + 0.01, lat + 0.01).alias("rings"))
    good, _ = facilities.ingest(raw)
    return good.select("facility_id", "facility_name", "facility_type", "classification_confidence", "tags_json", F.bround("longitude", 6).alias("longitude"), F.bround("latitude", 6).alias("latitude"))


_FACILITY = """with p as (select *, p_partkey as k, case when p_partkey % 5 = 0 then case when p_partkey % 10 = 0 then 'refinery' else 'mine' end end as ind, case when p_partkey % 7 = 0 then 'plant' end as pow, case when p_partkey % 3 = 0 then case when p_partkey % 6 = 0 then 'quarry' else 'industrial' end end as lu, case when p_partkey % 11 = 0 then 'works' end as mm from part)
select 'osm_way_' || cast(k as varchar) as facility_id, p_name as facility_name, case when ind = 'refinery' then 'REFINERY' when ind = 'mine' or lu = 'quarry' then 'MINE' when pow = 'plant' then 'POWER_PLANT' when lu = 'industrial' then 'INDUSTRIAL_AREA' else 'OTHER_INDUSTRIAL' end as facility_type,
 case when ind is null and coalesce(lu, '') = '' and pow is null then 'medium' else 'high' end as classification_confidence,
 '{' || concat_ws(', ', '"industrial": "' || ind || '"', '"landuse": "' || lu || '"', '"man_made": "' || mm || '"', '"power": "' || pow || '"') || '}' as tags_json,
 round_even(cast(70 + k % 400 * 0.05 as double) + 0.005, 6) as longitude, round_even(cast(8 + k % 300 * 0.05 as double) + 0.005, 6) as latitude
from p where ind is not null or pow is not null or lu is not null or mm is not null"""


def _places(s: SparkSession, d: str) -> DataFrame:
    return event_features(s, d).select("event_id", "event_start", "event_end", "centroid_latitude", "centroid_longitude", F.lit(None).cast("string").alias("centroid_wkt"), F.lit(None).cast("string").alias("footprint_wkt"))


def sta_evidence(s: SparkSession, d: str) -> DataFrame:
    layers = a.facilities(s, d).where("geometry_type = 'Polygon'").select(F.concat(F.lit("sta_mask_"), "facility_id").alias("sta_id"), F.lit("MASK").alias("sta_layer_type"), "geometry_type", "rings", F.lit(None).cast("timestamp").alias("observation_datetime"))
    return sta.evidence(_places(s, d), layers).select("event_id", "sta_association_status", "sta_evidence_quality", "sta_id", "sta_nearest_distance_km", "sta_match_count", "sta_temporal_relation")


def environment_context(s: SparkSession, d: str) -> DataFrame:
    layer = a.facilities(s, d).where("geometry_type = 'Polygon'").select("geometry_type", "rings")
    pixels = s.range(40_000).select((F.col("id") / 200).cast("int").alias("row"), (F.col("id") % 200).cast("int").alias("col"), (F.col("id") % 5).cast("double").alias("value"))
    out = environment.landcover_raster(_places(s, d), pixels, 69.5, 36.0, 0.15, 0.15, nodata=0.0)
    return environment.context(out, {"vegetation": layer, "water": None}).select("event_id", "landcover_available", "dominant_landcover_class", "vegetation_present", "vegetation_coverage_fraction", "vegetation_distance_km", "water_available", "environmental_context_available")


def landcover_sample(s: SparkSession, d: str) -> DataFrame:
    pixels = s.range(40_000).select((F.col("id") / 200).cast("int").alias("row"), (F.col("id") % 200).cast("int").alias("col"), (F.col("id") % 5).cast("double").alias("value"))
    return environment.landcover_raster(a.events(s, d), pixels, 69.5, 36.0, 0.15, 0.15, nodata=0.0).select("event_id", "landcover_available", "dominant_landcover_class")


_LANDCOVER = f"""with e as ({a.EVENTS_SQL}), c as (select event_id, cast(floor((36.0e0 - centroid_latitude) / 0.15e0) as integer) as r, cast(floor((centroid_longitude - 69.5e0) / 0.15e0) as integer) as c from e)
select event_id, coalesce((r * 200 + c) % 5 <> 0 and r between 0 and 199 and c between 0 and 199, false) as landcover_available, case when (r * 200 + c) % 5 <> 0 and r between 0 and 199 and c between 0 and 199 then cast((r * 200 + c) % 5 as varchar) end as dominant_landcover_class from c"""


# ---------------------------------------------------------------- validation
def _judged(s: SparkSession, d: str) -> DataFrame:
    fused = fusion.fuse(a.events(s, d))
    truth = F.when(F.expr("cast(substring(event_id, 5, 7) as int) % 3 = 0"), "INDUSTRIAL").otherwise("NATURAL")
    k = F.expr("cast(substring(event_id, 5, 7) as int)")
    status = F.when(k % 11 == 0, "MULTIPLE_POSSIBLE_MATCHES").when(k % 13 == 0, "NO_MATCH").otherwise("MATCHED")
    return fused.withColumns({"truth": F.when(k % 17 == 0, "UNKNOWN").otherwise(truth), "predicted": validation.to_binary(F.col("candidate_interpretation")), "match_status": status, "independent": k % 5 != 0, "validation_id": F.concat(F.lit("VAL_"), k.cast("string"))})


def validation_metrics(s: SparkSession, d: str) -> DataFrame:
    return validation.binary_metrics(_judged(s, d))


def validation_thresholds(s: SparkSession, d: str) -> DataFrame:
    return validation.thresholds(_judged(s, d)).select("floor", "tp", "fp", "tn", "fn", "precision", "recall")


def validation_classes(s: SparkSession, d: str) -> DataFrame:
    return validation.class_metrics(_judged(s, d).where("predicted is not null"))


def validation_ablation(s: SparkSession, d: str) -> DataFrame:
    return validation.ablation(_judged(s, d)).select("variant", "tp", "fp", "tn", "fn", "abstained")


def validation_errors(s: SparkSession, d: str) -> DataFrame:
    out = validation.errors(_judged(s, d))
    return out.select("category", "n", F.array_join("examples", ",").alias("examples"))


def validation_matches(s: SparkSession, d: str) -> DataFrame:
    c = a.table(s, d, "customer").selectExpr("concat('VAL_', cast(c_custkey as string)) as validation_id", "cast(8 + (c_custkey % 600) * 0.04 + 0.01 as double) as reference_latitude", "cast(70 + (c_custkey % 500) * 0.04 as double) as reference_longitude", "cast(null as timestamp) as reference_date")
    found = validation.match(c, a.events(s, d))
    return found.select("validation_id", "match_status", "event_id", "match_distance_km")


def label_normalization(s: SparkSession, d: str) -> DataFrame:
    return a.table(s, d, "part").select("p_partkey", validation.normalize_label(F.concat(F.element_at(F.split(F.lit("Wild-fire,power plant,stubble burn,Other,gas flare site,,forest fire"), ","), (F.col("p_partkey") % 7 + 1).cast("int")))).alias("label"))


_JUDGED = f"""{_FUSION},
j as (select *, cast(substr(event_id, 5, 7) as integer) as k, case when cast(substr(event_id, 5, 7) as integer) % 17 = 0 then 'UNKNOWN' when cast(substr(event_id, 5, 7) as integer) % 3 = 0 then 'INDUSTRIAL' else 'NATURAL' end as truth, case when cand in ('AMBIGUOUS_EVIDENCE', 'MIXED_OR_CONFLICTING', 'INSUFFICIENT_EVIDENCE', 'POSSIBLE_INDUSTRIAL_ACTIVITY') then null when cand = 'INDUSTRIAL_ACTIVITY_CANDIDATE' then 'INDUSTRIAL' else 'NON_INDUSTRIAL' end as predicted from f6)"""


# ---------------------------------------------------------------- serving
def list_events(s: SparkSession, d: str) -> DataFrame:
    scored = a.events(s, d).withColumn("risk_score", F.col("anomaly_score") * 10)
    return serve.list_events(scored, 2, 50, facility_association_method="NEAR_FACILITY", bbox="72,9,85,30", min_risk=5).select("event_id", "risk_score", "event_start")


def list_facilities(s: SparkSession, d: str) -> DataFrame:
    f = a.table(s, d, "customer").selectExpr("cast(c_custkey as string) as facility_id", "c_name as facility_name", "c_mktsegment as facility_type")
    return serve.list_facilities(f, 1, 100, search="00")


def dashboard_totals(s: SparkSession, d: str) -> DataFrame:
    return serve.dashboard_totals(_scored(s, d)).select("events", "with_facility", "anomalous", "alerts", "persistent", "first_start", "last_end")


def dashboard_distributions(s: SparkSession, d: str) -> DataFrame:
    return serve.dashboard_distributions(_scored(s, d))


def facility_summaries(s: SparkSession, d: str) -> DataFrame:
    return serve.facility_summary(_scored(s, d)).select("facility_id", "event_count", "alert_count", "anomalous_count", "latest_event_start")


def distance_to_origin(s: SparkSession, d: str) -> DataFrame:
    return a.events(s, d).select("event_id", haversine(F.col("centroid_latitude"), F.col("centroid_longitude"), F.lit(20.0), F.lit(80.0)).alias("km"))


# ---------------------------------------------------------------- near real time
def nrt_fold(s: SparkSession, d: str) -> DataFrame:
    """All detections as one batch without active events: states of the events that it makes."""
    o = a.detections(s, d).select(F.format_string("%012d", F.col("det_id")).alias("observation_hash"), "latitude", "longitude", "acq_datetime", "frp", "daynight", F.lit(None).cast("string").alias("event_id"))
    states, _ = nrt.advance(s.createDataFrame([], nrt.STATE), o)
    return states.select("event_id", "event_start", "last_detection_at", "detection_count", "frp_valid_count", "peak_frp", "total_frp", "day_detection_count", "is_active")


_NRT = f"""with d as ({a.DETECTIONS_SQL}),
g as (select *, case when lag(acq_datetime) over w is null or epoch_us(acq_datetime) - epoch_us(lag(acq_datetime) over w) > 129600000000 then 1 else 0 end as fresh from d window w as (partition by site order by acq_datetime, det_id)),
i as (select *, sum(fresh) over (partition by site order by acq_datetime, det_id) as island from g),
e as (select site, island, min(acq_datetime) as event_start, max(acq_datetime) as last_detection_at, cast(count(*) as integer) as detection_count, cast(count(*) filter (where frp >= 0) as integer) as frp_valid_count, max(frp) filter (where frp >= 0) as peak_frp, sum(frp) filter (where frp >= 0) as total_frp, cast(count(*) filter (where daynight = 'D') as integer) as day_detection_count, arg_min(det_id, (acq_datetime, det_id)) as first_id from i group by site, island)
select printf('EVT_%07d', row_number() over (order by event_start, first_id)) as event_id, event_start, last_detection_at, detection_count, frp_valid_count, peak_frp, total_frp, day_detection_count, (select epoch_us(max(acq_datetime)) from d) - epoch_us(last_detection_at) <= 129600000000 as is_active from e"""

QUERIES = {f.__name__: f for f in (event_features, event_noise, event_persistence, persistence_counts, confidence_distribution, event_footprints, association_selection, association_candidates, association_histogram, facility_fingerprints, facility_monthly_profile, anomaly_scores, evidence_fusion, risk_priority, risk_explanations, risk_crosstab, risk_tokens, risk_distribution, clean_counts, clean_detections, observation_hashes, facility_ingest, sta_evidence, environment_context, landcover_sample, validation_metrics, validation_thresholds, validation_classes, validation_ablation, validation_errors, validation_matches, label_normalization, list_events, list_facilities, dashboard_totals, dashboard_distributions, facility_summaries, distance_to_origin, nrt_fold)}

_RATES = "tp / nullif(cast(tp + fp as double), 0) as precision, tp / nullif(cast(tp + fn as double), 0) as recall"
_COUNTS = "count(*) filter (where truth = 'INDUSTRIAL' and predicted = 'INDUSTRIAL') as tp, count(*) filter (where truth <> 'INDUSTRIAL' and predicted = 'INDUSTRIAL') as fp, count(*) filter (where truth <> 'INDUSTRIAL' and predicted <> 'INDUSTRIAL') as tn, count(*) filter (where truth = 'INDUSTRIAL' and predicted <> 'INDUSTRIAL') as fn"
_HASH = " || chr(10) || ".join(["'hash_version=v1'", *[f"'{c}=' || case when lower(trim({c})) in ('', 'nan') then '' else trim({c}) end" for c in clean.RAW_COLUMNS]])
ORACLES = {
    "event_features": f"with {_FEATURES} select * from f",
    "event_noise": f"with {_ISLANDS} select det_id, cast(1 as integer) as spatiotemporal_neighbor_count, 'no neighbour within 1.5 km and 36.0 h' as noise_reason from c where size = 1",
    "event_persistence": f"with {_PERSISTENCE} select * from q",
    "persistence_counts": f"with {_PERSISTENCE} select persistence_label, count(*) as n from q group by 1",
    "confidence_distribution": f"with {_ISLANDS}, b as (select event_id, confidence, count(*) as n from l group by all) select event_id, string_agg(confidence || '=' || cast(n as varchar), ',' order by confidence) as distribution from b group by event_id",
    "facility_fingerprints": _FINGERPRINT,
    "facility_monthly_profile": f"with e as ({a.EVENTS_SQL}), b as (select facility_id, cast(month(event_start) as integer) as month, count(*) as event_count, cast(sum(detection_count) as bigint) as detection_count from e where facility_id is not null group by all) select *, event_count / cast(sum(event_count) over (partition by facility_id) as double) as event_fraction from b",
    "anomaly_scores": _ANOMALY,
    "evidence_fusion": f"with {_FUSION} select event_id, i as infrastructure_score, t as temporal_score, h as historical_score, an as anomaly_support_score, st as sta_score, en as environmental_score, x as industrial_evidence_score, c as corroboration_score, case when x <= 0 then 'NONE' when x <= 3 then 'WEAK' when x <= 7 then 'MODERATE' else 'STRONG' end as evidence_strength, cast(pres as varchar) || '/4' as evidence_coverage, cc as evidence_conflict_codes, cand as candidate_interpretation, case when b = 6 then 'SUFFICIENT_FOR_CANDIDATE' when b >= 8 then 'INSUFFICIENT' else 'PARTIAL' end as evidence_sufficiency, case when not env and un = 'LOW' then 'MEDIUM' when not env and un = 'MEDIUM' then 'HIGH' else un end as interpretation_uncertainty, case when b = 6 then case when c >= 1 then 'MEDIUM' else 'LOW' end when b >= 8 then 'NONE' else 'LOW' end as interpretation_confidence from f6",
    "risk_priority": f"with {_RISK} select * from r",
    "risk_crosstab": f"with {_RISK} select industrial_context, " + ", ".join(f"count(*) filter (where investigation_priority = '{p}') as \"{p}\"" for p in ("LOW", "MEDIUM", "HIGH", "CRITICAL")) + " from r group by 1",
    "risk_tokens": f"with {_RISK} select token, count(*) as n from (select unnest(string_split(uncertainty_factors, ';')) as token from r) where token <> '' group by 1",
    "risk_distribution": f"with {_RISK} select min(risk_score) as min, quantile_cont(risk_score, 0.25) as p25, quantile_cont(risk_score, 0.5) as median, quantile_cont(risk_score, 0.75) as p75, quantile_cont(risk_score, 0.95) as p95, max(risk_score) as max, avg(risk_score) as mean from r",
    "clean_counts": f"with {_CLEAN} select count(*) as rows_in, count(*) filter (where latm) as latitude_missing, count(*) filter (where not latm and lat is null) as latitude_invalid, count(*) filter (where lonm) as longitude_missing, count(*) filter (where fm) as frp_missing, count(*) filter (where f < 0) as frp_negative, count(*) filter (where f >= 0) as frp_valid_rows, count(*) filter (where not ok) as coords_invalid, count(*) filter (where t is null) as time_invalid, count(*) filter (where r > 1) as duplicates, count(*) filter (where ok and t is not null and r = 1) as rows_out from z",
    "clean_detections": f"with {_CLEAN} select row_no, lat as latitude, lon as longitude, f as frp, coalesce(f >= 0, false) as frp_valid, confidence, daynight, t as acq_datetime, cast(hour(t) as integer) as hour_utc, cast(isodow(t) - 1 as integer) as day_of_week, cast(month(t) as integer) as month, cast(dayofyear(t) as integer) as day_of_year from z where ok and t is not null and r = 1",
    "observation_hashes": f"with x as ({a.RAW_SQL}) select row_no, sha256({_HASH}) as observation_hash from x",
    "facility_ingest": _FACILITY,
    "landcover_sample": _LANDCOVER,
    "validation_metrics": f"with {_JUDGED}, k as (select count(*) as n, {_COUNTS}, count(*) filter (where predicted is null) as abstained from j), k2 as (select *, {_RATES}, tn / nullif(cast(tn + fp as double), 0) as specificity, tn / nullif(cast(tn + fn as double), 0) as npv, (tp + tn) / nullif(cast(tp + tn + fp + fn as double), 0) as accuracy, 2 * tp / nullif(cast(2 * tp + fp + fn as double), 0) as f1, (n - abstained) / nullif(cast(n as double), 0) as coverage, abstained / nullif(cast(n as double), 0) as abstention_rate from k) select *, (recall + specificity) / 2 as balanced_accuracy from k2",
    "validation_thresholds": f"with {_JUDGED}, v as (select truth, floor, case when x >= floor then 'INDUSTRIAL' else 'NON' end as predicted from j, (values (0), (4), (6), (8), (10)) w(floor)), k as (select floor, {_COUNTS} from v group by floor) select *, {_RATES} from k",
    "validation_ablation": f"""with {_JUDGED}, o as (select * from j where k % 11 <> 0 and k % 13 <> 0 and k % 5 <> 0),
b as (select truth, variant, case when m = 'AMBIGUOUS' then null when i >= 3 then 'INDUSTRIAL' else null end as predicted from o, (values ('infrastructure_only'), ('infrastructure_plus_temporal'), ('infrastructure_plus_history'), ('infrastructure_plus_anomaly'), ('infrastructure_plus_temporal_history_anomaly')) w(variant)
      union all select truth, 'full_available_i7', predicted from o) select variant, {_COUNTS}, count(*) filter (where predicted is null) as abstained from b group by variant""",
    "validation_errors": f"""with {_JUDGED}, o as (select *, 'VAL_' || cast(k as varchar) as vid from j), c as (
select case when truth = 'UNKNOWN' then 'AMBIGUOUS_OR_UNKNOWN_LABEL' when predicted is null then case when truth = 'INDUSTRIAL' then 'ABSTENTION_ON_INDUSTRIAL' else 'ABSTENTION_ON_NON_INDUSTRIAL' end when truth = 'INDUSTRIAL' and predicted <> 'INDUSTRIAL' then 'MISSED_INDUSTRIAL' when truth <> 'INDUSTRIAL' and predicted = 'INDUSTRIAL' then 'FALSE_INDUSTRIAL' end as category, vid || ':' || event_id as key from o where k % 11 <> 0 and k % 13 <> 0 and k % 5 <> 0
union all select 'MULTIPLE_POSSIBLE_MATCHES', vid from o where k % 11 = 0), g as (select category, count(*) as n, array_to_string(list_sort(list(key))[1:5], ',') as examples from c where category is not null group by category)
select category, coalesce(n, 0) as n, coalesce(examples, '') as examples from (values ('FALSE_INDUSTRIAL'), ('MISSED_INDUSTRIAL'), ('FALSE_NON_INDUSTRIAL'), ('ABSTENTION_ON_INDUSTRIAL'), ('ABSTENTION_ON_NON_INDUSTRIAL'), ('AMBIGUOUS_OR_UNKNOWN_LABEL'), ('MULTIPLE_POSSIBLE_MATCHES')) v(category) left join g using (category)""",
    "label_normalization": "select p_partkey, case p_partkey % 7 when 0 then 'UNKNOWN' when 1 then 'INDUSTRIAL' when 2 then 'AGRICULTURAL' when 3 then 'OTHER' when 4 then 'INDUSTRIAL' when 5 then 'UNKNOWN' else 'NATURAL' end as label from part",
    "list_events": f"with e as (select *, anomaly_score * 10 as risk_score from ({a.EVENTS_SQL})) select event_id, risk_score, event_start from e where facility_association_method = 'NEAR_FACILITY' and centroid_longitude between 72 and 85 and centroid_latitude between 9 and 30 and risk_score >= 5 order by risk_score desc nulls last, event_start desc nulls last, event_id limit 50 offset 50",
    "list_facilities": "select cast(c_custkey as varchar) as facility_id, c_name as facility_name, c_mktsegment as facility_type from customer where c_name ilike '%00%' or cast(c_custkey as varchar) ilike '%00%' order by c_name nulls last, cast(c_custkey as varchar) limit 100",
    "dashboard_totals": f"with {_RISK} select count(*) as events, count(facility_id) as with_facility, count(*) filter (where anomaly_status = 'ANOMALOUS') as anomalous, count(*) filter (where investigation_priority in ('HIGH', 'CRITICAL')) as alerts, count(*) filter (where persistence_label = 'PERSISTENT') as persistent, min(event_start) as first_start, max(event_end) as last_end from r join e using (event_id)",
    "dashboard_distributions": f"with {_RISK}, v as (select r.*, e.persistence_label, e.anomaly_status, e.facility_association_method, e.facility_type, f6.cand from r join e using (event_id) join f6 using (event_id)) " + " union all ".join(f"select '{n}' as dimension, coalesce({c}, 'UNKNOWN') as value, count(*) as n from v group by 2" for n, c in (("investigation_priority", "investigation_priority"), ("persistence_label", "persistence_label"), ("anomaly_status", "anomaly_status"), ("facility_association_method", "facility_association_method"), ("candidate_interpretation", "cand"), ("facility_type", "facility_type"))),
    "facility_summaries": f"with {_RISK} select facility_id, count(*) as event_count, count(*) filter (where investigation_priority in ('HIGH', 'CRITICAL')) as alert_count, count(*) filter (where anomaly_status = 'ANOMALOUS') as anomalous_count, max(event_start) as latest_event_start from r join e using (event_id) where facility_id is not null group by facility_id",
    "distance_to_origin": f"with e as ({a.EVENTS_SQL}) select event_id, 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(20.0 - centroid_latitude) / 2), 2) + cos(radians(centroid_latitude)) * cos(radians(20.0)) * pow(sin(radians(80.0 - centroid_longitude) / 2), 2)))) as km from e",
    "nrt_fold": _NRT,
}
