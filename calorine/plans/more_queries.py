"""Queries of geometry, evidence, serving, loads and reports over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from calorine.adapters import tables as a
from calorine.functions import geo
from calorine.functions.parsing import acquired_nrt, clean_text, split_osm_id, to_boolean, to_double, to_long
from calorine.plans import load, queries as q, reports, serve, sta, validation
from calorine.sources import area
from calorine.streaming import refresh


# ---------------------------------------------------------------- geometry in SQL
def _albers(lon: str, lat: str) -> tuple[str, str]:
    s = f"sin(radians({lat}))"
    e, e2 = repr(geo._E), repr(geo._E2)
    z = f"((1 - {e2}) * ({s} / (1 - {e2} * {s} * {s}) - ln((1 - {e} * {s}) / (1 + {e} * {s})) / (2 * {e})))"
    rho, theta = f"({geo._A!r} * sqrt({geo._C!r} - {geo._N!r} * {z}) / {geo._N!r})", f"({geo._N!r} * (radians({lon}) - {geo._LAM0!r}))"
    return f"{rho} * sin({theta})", f"{geo._RHO0!r} - {rho} * cos({theta})"


_EX, _EY = _albers("lon", "lat")
_AX, _AY = _albers("x1", "y1")
_BX, _BY = _albers("x2", "y2")
_KIND = "case n % 7 when 0 then 'REFINERY' when 1 then 'LNG_TERMINAL' when 2 then 'MINE' when 3 then 'POWER_PLANT' when 4 then 'INDUSTRIAL_AREA' when 5 then 'OTHER_INDUSTRIAL' else 'UNKNOWN' end"
#: Places of events (ex, ey) and edges of facilities in metres; pairs that may come within 5 km.
_PAIRS = f"""{q._FEATURES},
ev as (select event_id, event_start, event_end, lat, lon, {_EX} as ex, {_EY} as ey from (select *, centroid_latitude as lat, centroid_longitude as lon from f)),
box as (select 'osm_way_' || cast(s_suppkey as varchar) as facility_id, s_name as facility_name, s_nationkey as n, cast(8 + (s_suppkey % 50) * 0.5 + (s_suppkey % 4) * 0.05 as double) as lat, cast(70 + floor(s_suppkey / 50.0) * 0.5 as double) as lon from supplier),
fac as (select facility_id, facility_name, {_KIND} as facility_type, true as areal, lon, lat, unnest([[lon - 0.01, lat - 0.01, lon + 0.01, lat - 0.01], [lon + 0.01, lat - 0.01, lon + 0.01, lat + 0.01], [lon + 0.01, lat + 0.01, lon - 0.01, lat + 0.01], [lon - 0.01, lat + 0.01, lon - 0.01, lat - 0.01]]) as g from box
  union all select 'osm_node_' || cast(c_custkey as varchar), c_name, {_KIND.replace('n % 7', 'c_nationkey % 7')}, false, cast(70 + floor((c_custkey % 150) / 50.0) * 0.5 + (c_custkey % 7) * 0.01 as double) as lon, cast(8 + (c_custkey % 50) * 0.5 + (c_custkey % 11) * 0.02 as double) as lat, [lon, lat, lon, lat] from customer),
edge as (select *, {_AX} as ax, {_AY} as ay, {_BX} as bx, {_BY} as by_ from (select *, g[1] as x1, g[2] as y1, g[3] as x2, g[4] as y2 from fac)),
near as (select event_id, facility_id, facility_name, facility_type, areal, ex, ey, ax, ay, bx, by_, (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) as len from ev join edge on abs(ev.lat - edge.lat) < 0.1 and abs(ev.lon - edge.lon) < 0.1),
seg as (select *, case when len = 0 then 0 else greatest(0, least(1, ((ex - ax) * (bx - ax) + (ey - ay) * (by_ - ay)) / len)) end as t from near),
pair as (select event_id, facility_id, facility_name, facility_type, areal, min(sqrt(pow(ex - ax - t * (bx - ax), 2) + pow(ey - ay - t * (by_ - ay), 2))) as gap, count(*) filter (where (ay > ey) <> (by_ > ey) and ex < (bx - ax) * (ey - ay) / (case when by_ = ay then 1 else by_ - ay end) + ax) as crossings from seg group by event_id, facility_id, facility_name, facility_type, areal),
dist as (select *, areal and crossings % 2 = 1 as inside, case when areal and crossings % 2 = 1 then 0.0 else gap end as d from pair)"""
_CANDIDATES = f"""{_PAIRS},
cand as (select *, d / 1000 as km, case when inside or (not areal and d = 0) then 0 else 2 end as tier from dist where d <= 5000),
rank as (select *, row_number() over (partition by event_id order by tier, km, case when areal then 0 else 1 end, facility_type, facility_id) as r from cand),
pick as (select event_id, cast(count(*) as integer) as facility_candidate_count, string_agg(facility_id, ',' order by facility_id) as candidate_facility_ids, max(case when r = 1 then facility_id end) as fid, max(case when r = 1 then facility_name end) as fname, max(case when r = 1 then facility_type end) as ftype, max(case when r = 1 then tier end) as t1, max(case when r = 2 then tier end) as t2, max(case when r = 1 then km end) as d1, max(case when r = 2 then km end) as d2 from rank group by event_id),
made as (select *, coalesce(t1 = t2 and abs(d2 - d1) <= 0.5, false) as unclear from pick)"""


def association_points(s: SparkSession, d: str) -> DataFrame:
    out = q.association_selection(s, d)
    return out.select("event_id", "facility_id", "facility_name", "facility_type", "facility_association_method", "facility_attribution_confidence", "facility_distance_km", "facility_candidate_count", "candidate_facility_ids")


_SELECTION = f"""{_CANDIDATES},
sel as (select f.event_id, case when not unclear then fid end as facility_id, case when not unclear then fname end as facility_name, case when not unclear then ftype end as facility_type,
 case when m.event_id is null then 'NO_FACILITY_ASSOCIATION' when unclear then 'AMBIGUOUS' when t1 = 0 then 'WITHIN_FACILITY' else 'NEAR_FACILITY' end as facility_association_method, case when m.event_id is null then 'NONE' when unclear then 'LOW' when t1 < 2 then 'HIGH' when facility_candidate_count = 1 then 'MEDIUM' else 'LOW' end as facility_attribution_confidence,
 case when not unclear then round_even(d1, 6) end as facility_distance_km, coalesce(facility_candidate_count, 0) as facility_candidate_count, candidate_facility_ids from f left join made m on m.event_id = f.event_id)"""


def sta_points(s: SparkSession, d: str) -> DataFrame:
    out = q.sta_evidence(s, d)
    return out.select("event_id", "sta_association_status", "sta_evidence_quality", "sta_id", F.bround("sta_nearest_distance_km", 6).alias("distance_km"), "sta_match_count", "sta_temporal_relation")


_STA = f"""with {_PAIRS},
cand as (select *, 'sta_mask_' || facility_id as sid, d / 1000 as km from dist where areal and d <= 1000),
rank as (select *, row_number() over (partition by event_id order by case when inside then 0 else 1 end, km, sid) as r from cand),
pick as (select event_id, cast(count(*) as integer) as n, max(case when r = 1 then sid end) as sid, bool_or(inside and r = 1) as i1, bool_or(inside and r = 2) as i2, max(case when r = 1 then km end) as d1, max(case when r = 2 then km end) as d2 from rank where r <= 20 group by event_id),
made as (select *, coalesce(i1 = i2 and abs(d2 - d1) <= 0.1, false) as unclear from pick)
select f.event_id, case when m.event_id is null then 'NO_STA_ASSOCIATION' when unclear then 'AMBIGUOUS' else 'STA_ASSOCIATED' end as sta_association_status, case when m.event_id is null then 'NONE' when unclear then 'LOW' when i1 then 'HIGH' when d1 <= 0.5 then 'MEDIUM' else 'LOW' end as sta_evidence_quality,
 case when not unclear then sid end as sta_id, round_even(d1, 6) as distance_km, coalesce(n, 0) as sta_match_count, case when not unclear then 'NOT_APPLICABLE' end as sta_temporal_relation from f left join made m on m.event_id = f.event_id"""


def temporal_relations(s: SparkSession, d: str) -> DataFrame:
    seen = F.expr("case when detection_count % 7 = 0 then null else event_start + make_interval(0, 0, 0, 0, (detection_count % 5) * 20 - 30) end")
    e = a.events(s, d).withColumns({"seen": seen, "later": F.expr("event_start + make_interval(0, 0, 0, 0, 10)")})
    return e.select("event_id", sta.temporal_relation(F.lit("DETECTION"), F.col("seen"), F.col("event_start"), F.col("later"), 24.0).alias("relation"))


_RELATIONS = f"""with e as (select event_id, event_start as a, event_start + interval 10 hour as b, case when detection_count % 7 = 0 then null else event_start + ((detection_count % 5) * 20 - 30) * interval 1 hour end as o from ({a.EVENTS_SQL}))
select event_id, case when o is null then 'UNKNOWN' when o between a and b then 'SAME_PERIOD' when least(abs(epoch_us(o) - epoch_us(a)), abs(epoch_us(o) - epoch_us(b))) <= 86400000000 then 'NEAR_EVENT_TIME' else 'OUTSIDE_EVENT_PERIOD' end as relation from e"""


def satellite_context(s: SparkSession, d: str) -> DataFrame:
    from calorine.plans.environment import satellite

    pixels = s.range(40_000).select((F.col("id") / 200).cast("int").alias("row"), (F.col("id") % 200).cast("int").alias("col"), (F.col("id") % 9 * 0.5).alias("value"))
    return satellite(a.events(s, d), pixels, 69.5, 36.0, 0.15, 0.15, nodata=0.0).select("event_id", "satellite_context_available", "satellite_source", "satellite_value", "satellite_value_name")


_SATELLITE = f"""with e as ({a.EVENTS_SQL}), c as (select event_id, cast(floor((36.0e0 - centroid_latitude) / 0.15e0) as integer) as r, cast(floor((centroid_longitude - 69.5e0) / 0.15e0) as integer) as c from e),
v as (select event_id, case when r between 0 and 199 and c between 0 and 199 and (r * 200 + c) % 9 <> 0 then (r * 200 + c) % 9 * 0.5e0 end as value from c)
select event_id, value is not null as satellite_context_available, case when value is not null then 'local_satellite_context' end as satellite_source, value as satellite_value, case when value is not null then 'band_1' end as satellite_value_name from v"""


# ---------------------------------------------------------------- validation
def validation_strength(s: SparkSession, d: str) -> DataFrame:
    return validation.strength_precision(q._judged(s, d))


def validation_averages(s: SparkSession, d: str) -> DataFrame:
    return validation.class_averages(q._judged(s, d).where("predicted is not null"))


_CLASSES = f"""with {q._JUDGED}, p as (select truth, predicted from j where predicted is not null), l as (select truth as label from p union select predicted from p),
c as (select label, (select count(*) from p where truth = label) as support, (select count(*) from p where predicted = label) as claimed, (select count(*) from p where truth = label and predicted = label) as tp from l),
m as (select label, support, tp / nullif(cast(claimed as double), 0) as precision, tp / nullif(cast(support as double), 0) as recall, 2 * tp / nullif(cast(claimed + support as double), 0) as f1 from c)"""


# ---------------------------------------------------------------- serving
def event_alerts(s: SparkSession, d: str) -> DataFrame:
    return serve.alerts(q._scored(s, d), 1, 100, sort_by="event_start", order="asc").select("event_id", "risk_score", "event_start")


def event_detail(s: SparkSession, d: str) -> DataFrame:
    c = a.table(s, d, "lineitem").selectExpr("concat('EVT_', lpad(cast(l_orderkey as string), 7, '0')) as event_id", "cast(l_linenumber as int) as candidate_rank", "l_quantity as distance_km", "concat('osm_way_', cast(l_suppkey as string)) as facility_id", "'NEAR' as spatial_relation")
    first = serve.get_event(a.events(s, d), c, "EVT_0000003")
    return first.select("event_id", F.array_join(F.transform("candidates", lambda x: F.concat_ws("@", x["candidate_rank"].cast("string"), x["facility_id"])), ",").alias("candidates"))


def event_evidence(s: SparkSession, d: str) -> DataFrame:
    out = serve.evidence(q._scored(s, d), "EVT_0000003")
    return out.select("event_id", "temporal.available", F.col("temporal.score").cast("double").alias("temporal_score"), F.col("infrastructure.score").cast("double").alias("infrastructure_score"), F.col("sta.available").alias("sta_available"))


def facility_history(s: SparkSession, d: str) -> DataFrame:
    scored = a.events(s, d).withColumn("risk_score", F.col("anomaly_score") * 10)
    return serve.facility_history(scored, "osm_way_7", 2, 20).select("event_id", "risk_score")


def bounded_facilities(s: SparkSession, d: str) -> DataFrame:
    f = a.table(s, d, "customer").selectExpr("cast(c_custkey as string) as facility_id", "c_name as facility_name", "c_mktsegment as facility_type", "cast(8 + c_custkey % 30 as double) as latitude", "cast(70 + c_custkey % 20 as double) as longitude")
    return serve.list_facilities(f, 1, 200, facility_type="BUILDING", bbox="72,10,80,30")


# ---------------------------------------------------------------- parsing and loads
_TIMES = "case o_orderkey % 8 when 0 then null when 1 then '5' when 2 then '655' when 3 then '2475' when 4 then ' 1230 ' when 5 then '12345' when 6 then 'noon' else '0000' end"


def nrt_times(s: SparkSession, d: str) -> DataFrame:
    o = a.table(s, d, "orders").selectExpr("o_orderkey", "case when o_orderkey % 9 = 0 then '01-02-2024' else cast(cast(o_orderdate as date) as string) end as d", f"{_TIMES} as t")
    return o.select("o_orderkey", acquired_nrt("d", "t").alias("acq_datetime"))


_TEXTS = ["' Yes '", "'0'", "'T'", "'nan'", "' 12.50 '", "'-3'", "'1e3'", "'NULL'", "''", "'way/15'", "'Node:7'", "null"]


def parsed_texts(s: SparkSession, d: str) -> DataFrame:
    rows = a.table(s, d, "part").selectExpr("p_partkey", "case p_partkey % 12 " + " ".join(f"when {i} then {t}" for i, t in enumerate(_TEXTS)) + " end as t")
    kind, number = split_osm_id("t")
    return rows.select("p_partkey", clean_text("t").alias("text"), to_boolean("t").alias("flag"), to_double("t").alias("number"), to_long("t").alias("whole"), kind.alias("osm_type"), number.alias("osm_id"))


_RAW_EVENTS = "case when o_orderkey % 40 = 0 then ' ' else concat('EVT_', cast(o_orderkey % 12000 as {s})) end as event_id, case when o_orderkey % 33 = 0 then '91' when o_orderkey % 37 = 0 then 'x' else cast(o_orderkey % 60 as {s}) end as centroid_latitude, cast(o_orderkey % 170 as {s}) as centroid_longitude, case when o_orderkey % 29 = 0 then '101.5' when o_orderkey % 31 = 0 then null else '55' end as risk_score"


def load_events(s: SparkSession, d: str) -> DataFrame:
    a.table(s, d, "orders").createOrReplaceTempView("calorine_raw_orders")
    raw = s.sql(f"select o_orderkey as k, {_RAW_EVENTS.format(s='string')} from calorine_raw_orders")
    checked = load.checked_events(raw, "k")
    return checked.groupBy(F.regexp_replace(F.coalesce("error", F.lit("ok")), "EVT_.*", "").alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first"))


_LOAD_EVENTS = f"""with r as (select o_orderkey as k, {_RAW_EVENTS.format(s='varchar')} from orders),
t as (select k, nullif(trim(event_id), '') as event_id, try_cast(centroid_latitude as double) as lat, try_cast(centroid_longitude as double) as lon, try_cast(risk_score as double) as risk from r),
e as (select *, case when event_id is null then 'missing event_id' when not coalesce(lat between -90 and 90 and lon between -180 and 180, false) then 'invalid centroid coordinates for ' when not coalesce(risk between 0 and 100, true) then 'risk_score out of range for ' end as error from t),
u as (select *, case when error is null and row_number() over (partition by event_id, error is null order by k) > 1 then 'duplicate key ' else coalesce(error, 'ok') end as outcome from e)
select outcome, count(*) as n, min(k) as first from u group by outcome"""


def load_candidates(s: SparkSession, d: str) -> DataFrame:
    raw = a.table(s, d, "lineitem").selectExpr("concat('EVT_', cast(l_orderkey as string)) as event_id", "concat('F_', cast(l_suppkey as string)) as facility_id", "cast(l_linenumber - 1 as string) as candidate_rank", "cast(l_quantity as string) as distance_km")
    known = a.table(s, d, "orders").where("o_orderkey % 3 <> 0").selectExpr("concat('EVT_', cast(o_orderkey as string)) as event_id")
    places = a.table(s, d, "supplier").where("s_suppkey % 4 <> 0").selectExpr("concat('F_', cast(s_suppkey as string)) as facility_id")
    return load.counters(load.checked_candidates(raw, known, places))


_LOAD_CANDIDATES = """with c as (select l_orderkey as e, l_suppkey as f, l_linenumber - 1 as r, exists(select 1 from orders where o_orderkey = l_orderkey and o_orderkey % 3 <> 0) and exists(select 1 from supplier where s_suppkey = l_suppkey and s_suppkey % 4 <> 0) and l_linenumber > 1 as good from lineitem),
d as (select *, good and row_number() over (partition by e, f, good order by r) > 1 as again from c)
select count(*) as received, count(*) filter (where good and not again) as inserted, count(*) filter (where not good or again) as rejected, count(*) filter (where again) as duplicates from d"""


def orphaned_observations(s: SparkSession, d: str) -> DataFrame:
    o = a.table(s, d, "orders").selectExpr("lpad(cast(o_orderkey as string), 9, '0') as observation_hash", "case when o_orderkey % 17 = 0 then null else cast(o_orderdate as timestamp) end as acq_datetime", "cast(o_custkey as string) as event_id")
    known = a.table(s, d, "customer").where("c_custkey % 2 = 0").selectExpr("cast(c_custkey as string) as event_id")
    return refresh.unassigned(refresh.clear_orphans(o, known), 500).select("observation_hash", "acq_datetime")


def affected_facilities(s: SparkSession, d: str) -> DataFrame:
    e = a.events(s, d)
    before, after = e.where("detection_count = 3"), e.where("detection_count = 5")
    c = after.select("event_id", F.explode(F.split("candidate_facility_ids", ",")).alias("facility_id"))
    return refresh.affected_facilities(before, after, c)


_CONFIRMED = "facility_id is not null and facility_association_method in ('WITHIN_FACILITY', 'INTERSECTS_FACILITY', 'NEAR_FACILITY')"
_AFFECTED = f"""with e as ({a.EVENTS_SQL}) select facility_id from e where detection_count in (3, 5) and {_CONFIRMED} union select f from (select unnest(string_split(candidate_facility_ids, ',')) as f from e where detection_count = 5 and facility_association_method = 'AMBIGUOUS') where f is not null"""


def degrees_for_km(s: SparkSession, d: str) -> DataFrame:
    lat, lon = load.degrees_for_km(F.col("facility_distance_km"), F.col("centroid_latitude") * 2.8)
    return a.events(s, d).select("event_id", lat.alias("lat_degrees"), lon.alias("lon_degrees"))


# ---------------------------------------------------------------- reports
def data_extent(s: SparkSession, d: str) -> DataFrame:
    return reports.extent(a.detections(s, d))


def observation_summary(s: SparkSession, d: str) -> DataFrame:
    return area.summary(a.raw(s, d))


def missing_values(s: SparkSession, d: str) -> DataFrame:
    return reports.missing_values(a.events(s, d), ["facility_id", "peak_frp", "persistence_label", "anomaly_score", "event_start"])


def duration_quantiles(s: SparkSession, d: str) -> DataFrame:
    return reports.quantiles(a.events(s, d), "observed_duration_hours")


def longest_events(s: SparkSession, d: str) -> DataFrame:
    return reports.longest(a.events(s, d)).select("event_id", "observed_duration_hours")


def sanity_checks(s: SparkSession, d: str) -> DataFrame:
    return reports.sanity(q._scored(s, d))


def key_invariants(s: SparkSession, d: str) -> DataFrame:
    e = a.events(s, d)
    after = e.where("detection_count <> 9")
    return reports.same_keys(e.where("detection_count <> 4"), after.union(after.where("detection_count = 2")))


def key_sets(s: SparkSession, d: str) -> DataFrame:
    one, two = (a.events(s, d).where(c).select("facility_id", "detection_count") for c in ("anomaly_status = 'NORMAL'", "anomaly_status = 'ANOMALOUS'"))
    both = reports.in_both(one, two).agg(F.count(F.lit(1)).alias("n")).select(F.lit("both").alias("side"), "n")
    return both.union(reports.only_first(one, two).agg(F.count(F.lit(1))).select(F.lit("first"), "count(1)"))


def evidence_merge(s: SparkSession, d: str) -> DataFrame:
    e = a.events(s, d)
    frames = [e.select("event_id", "persistence_label"), e.where("detection_count > 3").select("event_id", "anomaly_status", "persistence_label"), e.where("detection_count < 9").select("event_id", "sta_association_status")]
    return load.merged(frames)


_SANITY = f"""with {q._RISK}, v as (select r.*, e.facility_association_method as m, e.persistence_label as p, coalesce(e.sta_evidence_available, false) as st from r join e using (event_id)),
x as (select avg(case when m = 'WITHIN_FACILITY' then (investigation_priority = 'CRITICAL')::int::double end) as s1, avg(case when m = 'NO_FACILITY_ASSOCIATION' then (investigation_priority = 'LOW')::int::double end) as s2, avg(case when p = 'PERSISTENT' then (investigation_priority = 'CRITICAL')::int::double end) as s3, avg(case when not st then (investigation_priority = 'LOW')::int::double end) as s4, count(distinct risk_score) as n from v)
select 'within_facility_all_critical' as check_name, coalesce(s1 > 0.95, false) as triggered, s1 as share from x union all select 'no_facility_all_low', coalesce(s2 >= 1, false), s2 from x union all select 'persistent_all_critical', coalesce(s3 > 0.95, false), s3 from x union all select 'missing_sta_all_low', coalesce(s4 > 0.98, false), s4 from x union all select 'risk_score_near_constant', n <= 3, null from x"""

QUERIES = {f.__name__: f for f in (association_points, sta_points, temporal_relations, satellite_context, validation_strength, validation_averages, event_alerts, event_detail, event_evidence, facility_history, bounded_facilities, nrt_times, parsed_texts, load_events, load_candidates, orphaned_observations, affected_facilities, degrees_for_km, data_extent, observation_summary, missing_values, duration_quantiles, longest_events, sanity_checks, key_invariants, key_sets, evidence_merge)}
ORACLES = {
    "association_points": f"with {_SELECTION} select * from sel",
    "association_histogram": f"with {_SELECTION} select case when n = 0 then '0' when n = 1 then '1' when n <= 5 then '2-5' when n <= 10 then '6-10' when n <= 50 then '11-50' when n <= 200 then '51-200' else '201+' end as candidates, count(*) as events from (select facility_candidate_count as n from sel) group by 1",
    "sta_points": _STA,
    "temporal_relations": _RELATIONS,
    "satellite_context": _SATELLITE,
    "validation_classes": f"{_CLASSES} select * from m",
    "validation_averages": f"{_CLASSES} select avg(coalesce(precision, 0)) as macro_precision, avg(coalesce(recall, 0)) as macro_recall, avg(coalesce(f1, 0)) as macro_f1, sum(coalesce(f1, 0) * support) / sum(support) as weighted_f1, cast(sum(support) as bigint) as sample_count from m where support > 0",
    "validation_strength": f"with {q._JUDGED}, p as (select *, case when x <= 0 then 'NONE' when x <= 3 then 'WEAK' when x <= 7 then 'MODERATE' else 'STRONG' end as strength from j where predicted is not null) select strength, count(*) filter (where predicted = 'INDUSTRIAL') as predicted_industrial_count, count(*) filter (where predicted = 'INDUSTRIAL' and truth = 'INDUSTRIAL') / nullif(cast(count(*) filter (where predicted = 'INDUSTRIAL') as double), 0) as precision, count(*) as sample_count from p group by strength",
    "validation_matches": f"""with e as ({a.EVENTS_SQL}), c as (select 'VAL_' || cast(c_custkey as varchar) as validation_id, cast(8 + (c_custkey % 600) * 0.04 + 0.01 as double) as la, cast(70 + (c_custkey % 500) * 0.04 as double) as lo from customer),
p as (select validation_id, event_id, 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(centroid_latitude - la) / 2), 2) + cos(radians(la)) * cos(radians(centroid_latitude)) * pow(sin(radians(centroid_longitude - lo) / 2), 2)))) as km from c join e on abs(centroid_latitude - la) < 0.1 and abs(centroid_longitude - lo) < 0.1),
r as (select *, row_number() over w as k, lead(km) over w as next from p where km <= 5 window w as (partition by validation_id order by km, event_id))
select c.validation_id, case when r.event_id is null then 'NO_MATCH' when abs(next - km) <= 0.5 then 'MULTIPLE_POSSIBLE_MATCHES' else 'MATCHED' end as match_status, r.event_id, km as match_distance_km from c left join r on r.validation_id = c.validation_id and r.k = 1""",
    "event_alerts": f"with {q._RISK} select event_id, risk_score, event_start from r join e using (event_id) where investigation_priority in ('HIGH', 'CRITICAL') order by event_start nulls last, event_id limit 100",
    "event_detail": "select 'EVT_0000003' as event_id, string_agg(cast(l_linenumber as varchar) || '@osm_way_' || cast(l_suppkey as varchar), ',' order by l_linenumber, l_quantity, 'osm_way_' || cast(l_suppkey as varchar)) as candidates from lineitem where l_orderkey = 3 having exists(select 1 from orders where o_orderkey = 3)",
    "event_evidence": f"with {q._FUSION} select event_id, true as available, cast(t as double) as temporal_score, cast(case when m <> 'AMBIGUOUS' then i else i end as double) as infrastructure_score, sg is not null as sta_available from f6 where event_id = 'EVT_0000003'",
    "facility_history": f"with e as (select *, anomaly_score * 10 as risk_score from ({a.EVENTS_SQL})) select event_id, risk_score from e where facility_id = 'osm_way_7' order by risk_score desc nulls last, event_start desc nulls last, event_id limit 20 offset 20",
    "bounded_facilities": "select cast(c_custkey as varchar) as facility_id, c_name as facility_name, c_mktsegment as facility_type, cast(8 + c_custkey % 30 as double) as latitude, cast(70 + c_custkey % 20 as double) as longitude from customer where c_mktsegment = 'BUILDING' and c_custkey % 20 between 2 and 10 and c_custkey % 30 between 2 and 22 order by c_name nulls last, cast(c_custkey as varchar) limit 200",
    "nrt_times": "select o_orderkey, case when o_orderkey % 9 <> 0 and o_orderkey % 8 <> 3 then cast(cast(o_orderdate as date) as timestamp) + case o_orderkey % 8 when 1 then 5 when 2 then 415 when 4 then 750 else 0 end * interval 1 minute end as acq_datetime from orders",
    "parsed_texts": "select p_partkey, case p_partkey % 12 when 0 then 'Yes' when 1 then '0' when 2 then 'T' when 4 then '12.50' when 5 then '-3' when 6 then '1e3' when 9 then 'way/15' when 10 then 'Node:7' end as text, case p_partkey % 12 when 0 then true when 2 then true when 1 then false end as flag, case p_partkey % 12 when 1 then 0e0 when 4 then 12.5e0 when 5 then -3e0 when 6 then 1000e0 end as number, cast(case p_partkey % 12 when 1 then 0 when 4 then 12 when 5 then -3 when 6 then 1000 end as bigint) as whole, case p_partkey % 12 when 9 then 'way' when 10 then 'node' end as osm_type, case p_partkey % 12 when 9 then '15' when 10 then '7' end as osm_id from part",
    "load_events": _LOAD_EVENTS,
    "load_candidates": _LOAD_CANDIDATES,
    "orphaned_observations": "select lpad(cast(o_orderkey as varchar), 9, '0') as observation_hash, case when o_orderkey % 17 = 0 then null else cast(o_orderdate as timestamp) end as acq_datetime from orders where not exists (select 1 from customer where c_custkey = o_custkey and c_custkey % 2 = 0) order by 2 nulls last, 1 limit 500",
    "affected_facilities": _AFFECTED,
    "degrees_for_km": f"select event_id, facility_distance_km / 111.0 as lat_degrees, facility_distance_km / (111.0 * greatest(cos(radians(centroid_latitude * 2.8)), 0.2)) as lon_degrees from ({a.EVENTS_SQL})",
    "data_extent": f"select min(latitude) as lat_min, max(latitude) as lat_max, min(longitude) as lon_min, max(longitude) as lon_max, min(acq_datetime) as start_utc, max(acq_datetime) as end_utc from ({a.DETECTIONS_SQL})",
    "observation_summary": f"select count(*) as observation_count, min(la) as latitude_min, max(la) as latitude_max, min(lo) as longitude_min, max(lo) as longitude_max, min(acq_date) as first_date, max(acq_date) as last_date from (select *, try_cast(latitude as double) as la, case when longitude <> 'nan' then try_cast(longitude as double) end as lo from ({a.RAW_SQL}))",
    "missing_values": f"with e as ({a.EVENTS_SQL}) " + " union all ".join(f"select '{c}' as column_name, count(*) - count({c}) as missing from e" for c in ("facility_id", "peak_frp", "persistence_label", "anomaly_score", "event_start")),
    "duration_quantiles": f"select count(x) as n, min(x) as min, quantile_cont(x, 0.25) as p25, quantile_cont(x, 0.5) as median, quantile_cont(x, 0.75) as p75, quantile_cont(x, 0.95) as p95, max(x) as max, avg(x) as mean from (select observed_duration_hours as x from ({a.EVENTS_SQL}))",
    "longest_events": f"select event_id, observed_duration_hours from ({a.EVENTS_SQL}) order by observed_duration_hours desc nulls last, event_id limit 5",
    "sanity_checks": _SANITY,
    "key_invariants": f"with e as ({a.EVENTS_SQL}) select count(*) filter (where detection_count = 9) as lost, count(*) filter (where detection_count = 4) as gained, count(*) filter (where detection_count = 2) as doubled from e",
    "key_sets": f"with e as ({a.EVENTS_SQL}), x as (select facility_id, detection_count from e where anomaly_status = 'NORMAL'), y as (select facility_id, detection_count from e where anomaly_status = 'ANOMALOUS') select 'both' as side, count(*) as n from (select * from x intersect select * from y) union all select 'first', count(*) from (select * from x except all select * from y)",
    "evidence_merge": f"select event_id, persistence_label, case when detection_count > 3 then anomaly_status end as anomaly_status, case when detection_count < 9 then sta_association_status end as sta_association_status from ({a.EVENTS_SQL})",
}
