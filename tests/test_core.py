from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from calorine.functions.geo import albers, area, distance, edges, haversine, inside, parse_wkt
from calorine.functions.parsing import clock, normal_confidence, require_columns, to_boolean, to_double
from calorine.operators.graph import connected_components
from calorine.operators.stdbscan import ClusterConfig, cluster
from calorine.plans import association, events, facilities, fusion, validation
from calorine.plans.environment import union_share
from calorine.streaming import nrt

BASE = datetime(2023, 1, 1, 6)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_parsing(spark):
    assert value(spark, to_double(F.lit(" 2.5 "))) == 2.5
    assert value(spark, to_double(F.lit("nan"))) is None and value(spark, to_double(F.lit("abc"))) is None
    assert value(spark, normal_confidence(F.lit(" N "))) == "n" and value(spark, normal_confidence(F.lit("7"))) == "7"
    assert value(spark, to_boolean(F.lit("Yes"))) is True and value(spark, to_boolean(F.lit("maybe"))) is None
    assert [value(spark, c) for c in clock(F.lit("655"))] == [6, 55] and value(spark, clock(F.lit("1275"))[0]) is None
    with pytest.raises(ValueError):
        require_columns(spark.range(1), ["x"])


def test_geometry(spark):
    square = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"
    es = edges(parse_wkt(F.lit(square)))
    assert value(spark, area(es)) == 16
    assert value(spark, inside(F.lit(1.0), F.lit(1.0), es, F.lit(True))) and not value(spark, inside(F.lit(5.0), F.lit(1.0), es, F.lit(True)))
    assert value(spark, distance(F.lit(7.0), F.lit(8.0), es, F.lit(True))) == 5
    assert value(spark, distance(F.lit(1.0), F.lit(1.0), es, F.lit(True))) == 0
    x, y = albers(F.lit(82.0), F.lit(22.0))
    assert abs(value(spark, x)) < 1e-6 and abs(value(spark, y)) < 1e-6
    assert abs(value(spark, haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) - 111.195) < 0.01


def test_union_share_counts_overlap_once():
    import numpy as np

    box = np.array([[-9, -9, 9, -9], [9, -9, 9, 9], [9, 9, -9, 9], [-9, 9, -9, -9]], float)
    assert union_share(0, 0, 1, [box, box], 64) == pytest.approx(1.0, abs=0.01)


def test_components(spark):
    n = 40
    path = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r[0]: r[1] for r in connected_components(path).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and got[101] == got[100] == 100
    assert connected_components(path.where("u < 0")).count() == 0


def points(spark, rows):
    data = [(i, float(a), float(b), BASE + timedelta(hours=h), 2.0, True, 330.0, 290.0, "n", "D") for i, (a, b, h) in enumerate(rows)]
    return spark.createDataFrame(data, "det_id long, latitude double, longitude double, acq_datetime timestamp, frp double, frp_valid boolean, bright_ti4 double, bright_ti5 double, confidence string, daynight string")


def labels(spark, rows, **config):
    found = cluster(points(spark, rows), ClusterConfig(**config)).orderBy("det_id").collect()
    return [r["cluster"] for r in found]


def test_clustering(spark):
    assert labels(spark, [(28.6, 77.2, 0), (28.601, 77.201, 0.2), (28.602, 77.202, 0.4)]) == [0, 0, 0]
    assert labels(spark, [(28.6, 77.2, 0), (28.6, 77.2, 0.2), (28.6, 77.2, 1000), (28.6, 77.2, 1000.2)]) == [0, 0, 2, 2]
    assert labels(spark, [(28.6, 77.2, 0), (28.6, 77.2, 1), (5, 60, 0)]) == [0, 0, None]
    assert labels(spark, [(20, 80, 20 * i) for i in range(6)]) == [0] * 6
    assert labels(spark, [(20, 80, 0), (20, 80, 1)], min_samples=3) == [None, None]


def test_event_features_and_persistence(spark):
    labelled = points(spark, [(20, 80, 12 * i) for i in range(4)]).withColumn("event_id", F.lit("E")).withColumn("frp_valid", F.col("det_id") != 2).withColumn("frp", F.get(F.array(F.lit(2.5), F.lit(5.0), F.lit(None), F.lit(10.0)), F.col("det_id").cast("int")))
    r = events.persistence(events.features(labelled)).first()
    assert (r["detection_count"], r["observed_duration_hours"], r["frp_valid_count"], r["peak_frp"], r["median_frp"], r["total_frp"], r["max_gap_hours"]) == (4, 36, 3, 10, 5, 17.5, 12)
    assert r["persistence_label"] == "SHORT_LIVED"


def test_facility_types(spark):
    cases = [({"industrial": "refinery"}, "REFINERY"), ({"power": "plant"}, "POWER_PLANT"), ({"power": "substation"}, "OTHER_INDUSTRIAL"), ({"landuse": "quarry"}, "MINE"), ({"landuse": "industrial"}, "INDUSTRIAL_AREA"), ({"man_made": "tank"}, "UNKNOWN")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, tags map<string,string>")
    got = [r[0] for r in df.orderBy("i").select(facilities.classify(F.col("tags"), F.lit("x"))[0]).collect()]
    assert got == [k for _, k in cases]


def test_association(spark):
    ev = spark.createDataFrame([("A", 20.0, 80.0), ("B", 20.0, 80.04), ("C", 25.0, 85.0)], "event_id string, centroid_latitude double, centroid_longitude double").withColumns({"centroid_wkt": F.lit(None).cast("string"), "footprint_wkt": F.lit(None).cast("string")})
    fac = spark.createDataFrame([("f1", "one", "REFINERY", "Polygon", "POLYGON ((79.99 19.99, 80.01 19.99, 80.01 20.01, 79.99 20.01, 79.99 19.99))"), ("f2", "two", "MINE", "Point", "POINT (80.04 20.001)")], "facility_id string, facility_name string, facility_type string, geometry_type string, w string").withColumn("rings", parse_wkt(F.col("w"))).drop("w")
    out, pairs = association.associate(ev, fac)
    got = {r["event_id"]: (r["facility_association_method"], r["facility_id"], r["facility_candidate_count"]) for r in out.collect()}
    assert got == {"A": ("WITHIN_FACILITY", "f1", 2), "B": ("NEAR_FACILITY", "f2", 2), "C": ("NO_FACILITY_ASSOCIATION", None, 0)}
    assert pairs.count() == 4


def test_fusion_without_facility(spark):
    df = spark.createDataFrame([("E", "PERSISTENT", "NORMAL", "NO_FACILITY_ASSOCIATION")], "event_id string, persistence_label string, anomaly_status string, facility_association_method string")
    r = fusion.fuse(df).first()
    assert (r["candidate_interpretation"], r["temporal_score"], r["infrastructure_score"], r["sta_score"]) == ("INSUFFICIENT_EVIDENCE", 2, 0, 0)
    assert "STA_UNAVAILABLE" in r["limiting_evidence_codes"]


def test_binary_metrics(spark):
    rows = [("INDUSTRIAL", "INDUSTRIAL")] * 2 + [("NATURAL", "INDUSTRIAL")] + [("NATURAL", "NON_INDUSTRIAL")] * 3 + [("INDUSTRIAL", "NON_INDUSTRIAL"), ("NATURAL", None)]
    r = validation.binary_metrics(spark.createDataFrame(rows, "truth string, predicted string")).first()
    assert r["precision"] == r["recall"] == pytest.approx(2 / 3) and r["abstained"] == 1


def observation(h, lat=20.0, lon=80.0, hours=0.0, frp=1.0):
    return {"observation_hash": h, "latitude": lat, "longitude": lon, "acq_datetime": BASE + timedelta(hours=hours), "frp": frp, "daynight": "D", "event_id": None}


def test_fold():
    new = lambda o: "E" + o["observation_hash"]
    states, acts = nrt.fold([], [observation("a"), observation("b", 20.0045, hours=1, frp=4.0), observation("c", 20.5), observation("d", hours=60), observation("e", hours=60.5, frp=None)], new)
    assert [(h, w) for h, _, w in acts] == [("a", "created"), ("c", "created"), ("b", "matched"), ("d", "created"), ("e", "matched")]
    first = next(s for s in states if s["event_id"] == "Ea")
    assert (first["detection_count"], first["peak_frp"], first["mean_frp"], first["is_active"]) == (2, 4.0, 2.5, False)
    assert next(s for s in states if s["event_id"] == "Ed")["mean_frp"] == 1.0


def test_stream(spark, tmp_path):
    head = "latitude,longitude,bright_ti4,scan,track,acq_date,acq_time,satellite,instrument,confidence,version,bright_ti5,frp,daynight,type"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text(f"{head}\n20,80,330,1,1,2023-01-01,0600,N,V,n,2,290,2.5,D,0\n20.001,80,330,1,1,2023-01-01,0700,N,V,n,2,290,3.5,D,0\n")
    nrt.run_stream(spark, str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "obs"), str(tmp_path / "cp")).awaitTermination()
    r = spark.read.parquet(str(tmp_path / "state/batch=0")).collect()
    assert len(r) == 1 and r[0]["detection_count"] == 2 and r[0]["event_id"] == "EVT_0000001"


def observations(spark, rows):
    data = [(f"h{i:04d}", float(a), float(b), BASE + timedelta(hours=h), 2.0, "D", None) for i, (a, b, h) in enumerate(rows)]
    return spark.createDataFrame(data, "observation_hash string, latitude double, longitude double, acq_datetime timestamp, frp double, daynight string, event_id string")


def folded(rows, earlier=()):
    """The plain rule over all observations at once, from states."""
    states, actions = nrt.fold([dict(e) for e in earlier], [dict(zip(("observation_hash", "latitude", "longitude", "acq_datetime", "frp", "daynight", "event_id"), r)) for r in rows], lambda o: "new" + o["observation_hash"])
    return states, actions


def test_batches_fold_as_one_by_one(spark):
    import random

    r = random.Random(8)
    sites = [(10, 70), (10.01, 70.01), (10.02, 70.0), (10.5, 70), (-20, 150)]
    state = spark.createDataFrame([], nrt.STATE)
    plain: list = []
    for batch in range(3):
        span = (0, 60) if batch < 2 else (-50, 20)  # the last batch is late
        rows = [(*(c + r.uniform(-0.006, 0.006) for c in r.choice(sites)), r.uniform(*span) + 30 * batch) for _ in range(40)]
        o = observations(spark, rows)
        own = [tuple(x) for x in o.collect()]
        own = [(f"b{batch}{x[0]}", *x[1:]) for x in own]
        o = spark.createDataFrame(own, o.schema)
        state, actions = nrt.advance(state, o, 1 + 1000 * batch)
        state = spark.createDataFrame(state.collect(), nrt.STATE)
        plain, did = folded(own, plain)
        key = lambda e: (e["event_start"], round(e["centroid_latitude"], 9), round(e["centroid_longitude"], 9), e["last_detection_at"], e["detection_count"], e["is_active"])
        assert sorted(map(key, (x.asDict() for x in state.collect()))) == sorted(map(key, plain))
        assert sorted((x["observation_hash"], x["action"]) for x in actions.collect()) == sorted((h, w) for h, _, w in did)


def test_pairs_meet_across_the_date_line_and_by_a_pole(spark):
    import math
    import random

    from calorine.operators.stdbscan import neighbour_pairs

    r = random.Random(3)
    rows = [(r.uniform(-0.02, 0.02) + b, (180 + r.uniform(-0.03, 0.03) * k + 180) % 360 - 180, r.uniform(0, 60)) for b, k in ((0, 1), (60, 2), (-88, 20)) for _ in range(60)]
    rows += [(89.995, x, 0) for x in (-170.0, 10.0, 100.0)] + [(0.0, 179.999, 0), (0.0, -179.999, 0), (0.0, 180.0, 0)]
    got = {tuple(x) for x in neighbour_pairs(points(spark, rows)).collect()}

    def far(p, q):
        a, b = math.radians(p[0]), math.radians(q[0])
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))

    want = {(i, j) for i, p in enumerate(rows) for j, q in enumerate(rows) if i != j and far(p, q) <= 1.5 and abs(p[2] - q[2]) <= 36}
    assert got == want and len(want) > 100


def test_clusters_against_brute_force(spark):
    import math
    import random

    r = random.Random(5)
    rows = [(b + r.choice((0, 0.003, 0.03)) + r.uniform(-0.008, 0.008), (180 + r.uniform(-0.02, 0.02) * k + 180) % 360 - 180, r.choice((0, 50, 90)) + r.uniform(0, 40)) for b, k in ((0, 1), (60, 2), (-88, 20)) for _ in range(60)]

    def near(p, q):
        a, b = math.radians(p[0]), math.radians(q[0])
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h))) <= 1.5 and abs(p[2] - q[2]) <= 36

    around = {i: [j for j, q in enumerate(rows) if i == j or near(p, q)] for i, p in enumerate(rows)}
    for least in (2, 5):
        label = {}
        for i in around:
            if len(around[i]) >= least and i not in label:
                todo = [i]
                while todo:
                    j = todo.pop()
                    if j not in label and len(around[j]) >= least:
                        label[j] = i
                        todo += around[j]
        for i in set(around) - set(label):
            label |= {i: min((label[j] for j in around[i] if len(around[j]) >= least), default=None)}
        got = cluster(points(spark, rows), ClusterConfig(min_samples=least)).collect()
        assert {x["det_id"]: (x["spatiotemporal_neighbor_count"], x["cluster"]) for x in got} == {i: (len(around[i]), label[i]) for i in around}
        assert len(set(label.values())) > 5


def test_neighbours_are_never_broadcast(spark, tmp_path):
    """The size of a table after an explode is estimated as that before it, which let 27 rows of each point go to the driver."""
    from calorine.operators.stdbscan import neighbour_pairs

    points(spark, [(20, 80, i) for i in range(50)]).write.parquet(f"{tmp_path}/p")
    pairs = neighbour_pairs(spark.read.parquet(f"{tmp_path}/p"))
    assert pairs.count() == 2 * sum(min(36, 49 - i) for i in range(50))
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_times_hashes_and_orders(spark):
    from calorine.functions.parsing import acquired_nrt, clean_text, MISSING_HASHED
    from calorine.plans import clean, serve

    at = lambda t: value(spark, acquired_nrt(F.lit("2024-05-06"), F.lit(t)))
    assert [at(t) for t in ("655", "12345", "x", None)] == [datetime(2024, 5, 6, 6, 55)] + [datetime(2024, 5, 6)] * 3 and at("2475") is None and at("1260") is None
    assert value(spark, clean_text(F.lit("null"), MISSING_HASHED)) == "null" and value(spark, clean_text(F.lit("NaT"), MISSING_HASHED)) is None
    rows = spark.createDataFrame([("a", 1.0, 1), ("b", 1.0, 2), ("c", 5.0, 0), ("d", None, 9)], "event_id string, risk_score double, event_start int")
    order = lambda **k: [r[0] for r in rows.orderBy(*serve.sort_columns(**k)).collect()]
    assert order(sort_by="risk_score", order="asc") == ["b", "a", "c", "d"] and order(order="asc") == order(sort_by="risk_score", order="asc") and order() == ["c", "b", "a", "d"]
    base = {c: "1" for c in clean.RAW_COLUMNS} | {"acq_date": "25-12-2023", "acq_time": "655", "confidence": "n", "daynight": "D"}
    raw = spark.createDataFrame([base | {"frp": "none"}, base | {"frp": "2", "acq_date": "03-01-2024"}])
    assert clean.clean(raw, None).count() == 2 and clean.clean(raw).count() == 0
    counts = clean.quality_counts(raw, "dd-MM-yyyy").first()
    assert counts["frp_missing"] == 0 and counts["frp_invalid"] == 1


def test_sorted_numbers_against_plain_statistics():
    import random
    import statistics

    from calorine.plans.anomaly import Sorted

    r = random.Random(6)
    for n in (1, 2, 3, 7, 50, 5000):
        s, plain = Sorted(), []
        for _ in range(n):
            x = round(r.gauss(0, 3), 1)
            s.add(x)
            plain.append(x)
        plain.sort()
        med = statistics.median(plain)
        assert [s[i] for i in range(0, n, max(1, n // 50))] == plain[:: max(1, n // 50)] and abs(s.at(0.5) - med) < 1e-12
        assert abs(s.median_gap(med) - statistics.median(abs(x - med) for x in plain)) < 1e-9
        at = (n - 1) * 0.25
        assert abs(s.at(0.25) - (plain[int(at)] + (plain[min(int(at) + 1, n - 1)] - plain[int(at)]) * (at - int(at)))) < 1e-12


def test_validation_of_matched_references(spark):
    columns = "validation_id string, event_id string, match_status string, independent boolean, truth string, candidate_interpretation string, facility_association_method string, infrastructure_score int, temporal_score int, historical_score int, anomaly_support_score int, evidence_strength string"
    rows = spark.createDataFrame([
        ("v1", "e1", "MATCHED", True, "INDUSTRIAL", "INDUSTRIAL_ACTIVITY_CANDIDATE", "WITHIN_FACILITY", 3, 0, 0, 0, "STRONG"),
        ("v2", "e2", "MATCHED", True, "INDUSTRIAL", "POSSIBLE_INDUSTRIAL_ACTIVITY", "NEAR_FACILITY", 2, 2, 1, 0, "MODERATE"),
        ("v3", "e3", "MATCHED", True, "NATURAL", "INDUSTRIAL_ACTIVITY_CANDIDATE", "AMBIGUOUS", 0, 2, 0, 0, None),
        ("v4", "e4", "MATCHED", True, "UNKNOWN", None, None, None, None, None, None, None),
        ("v5", "e5", "MULTIPLE_POSSIBLE_MATCHES", True, "NATURAL", None, None, None, None, None, None, None),
        ("v6", "e6", "MATCHED", False, "INDUSTRIAL", "ENVIRONMENTAL_VEGETATION_CONTEXT", "NEAR_FACILITY", 1, 0, 0, 0, "WEAK"),
        ("v7", "e7", "MATCHED", True, "INDUSTRIAL", "ENVIRONMENTAL_VEGETATION_CONTEXT", "NEAR_FACILITY", 1, 0, 0, 0, "WEAK"),
    ], columns)
    got = {r["category"]: (r["n"], r["examples"]) for r in validation.errors(rows).collect()}
    assert set(got) == set(validation.ERRORS) and got["MISSED_INDUSTRIAL"] == (1, ["v7:e7"]) and got["FALSE_INDUSTRIAL"] == (1, ["v3:e3"])
    assert got["ABSTENTION_ON_INDUSTRIAL"] == (1, ["v2:e2"]) and got["AMBIGUOUS_OR_UNKNOWN_LABEL"] == (1, ["v4:e4"]) and got["MULTIPLE_POSSIBLE_MATCHES"] == (1, ["v5"])
    ablated = {r["variant"]: r for r in validation.ablation(rows.where("truth <> 'UNKNOWN'")).collect()}
    assert ablated["infrastructure_only"]["tp"] == 1 and ablated["infrastructure_only"]["abstained"] == 3 and ablated[validation.FULL]["fp"] == 1 and ablated[validation.FULL]["fn"] == 1
    strong = {r["strength"]: tuple(r)[1:] for r in validation.strength_precision(rows).collect()}
    assert strong["STRONG"] == (1, 1.0, 1) and strong["UNKNOWN"] == (1, 0.0, 1) and strong["WEAK"] == (0, None, 2)
    assert validation.report(rows.limit(0))["metric_status"] == "NOT_EVALUATED" and validation.report(rows)["metric_status"] == "EVALUATED"


def test_matches_meet_once_for_each_place(spark, tmp_path):
    def rows_of_joins(plan):
        name, found = plan.getClass().getSimpleName(), []
        if name == "AdaptiveSparkPlanExec":
            return rows_of_joins(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return rows_of_joins(plan.plan())
        if "Join" in name:
            found.append(plan.metrics().get("numOutputRows").get().value())
        children = plan.children()
        return found + [x for i in range(children.size()) for x in rows_of_joins(children.apply(i))]

    at = lambda i: BASE + timedelta(hours=i)
    refs = spark.createDataFrame([(f"r{i:03}", 20.0 + i % 2, 80.0, None if i % 4 < 2 else at(i % 3)) for i in range(200)] + [("far", -20.0, 80.0, None), ("nowhere", None, None, None)], "validation_id string, reference_latitude double, reference_longitude double, reference_date timestamp")
    evts = spark.createDataFrame([(f"e{i:03}", 20.01, 80.0, at(0), at(1)) for i in range(200)] + [("f1", 21.02, 80.0, at(0), at(1)), ("f0", 21.03, 80.0, at(90), at(91))], "event_id string, centroid_latitude double, centroid_longitude double, event_start timestamp, event_end timestamp")
    for name, df in (("r", refs), ("e", evts)):
        df.write.parquet(f"{tmp_path}/{name}")
    out = validation.match(spark.read.parquet(f"{tmp_path}/r"), spark.read.parquet(f"{tmp_path}/e"))
    got = {r["validation_id"]: r for r in out.collect()}
    assert len(got) == 202 and got["far"]["match_status"] == got["nowhere"]["match_status"] == "NO_MATCH"
    for i in range(200):
        r = got[f"r{i:03}"]
        assert (r["event_id"], r["match_status"]) == (("f1", "MATCHED") if i % 2 else ("e000", "MULTIPLE_POSSIBLE_MATCHES"))
        assert r["match_gap_hours"] == (None if i % 4 < 2 else max(0, i % 3 - 1))
    counted = validation.match(spark.read.parquet(f"{tmp_path}/r"), spark.read.parquet(f"{tmp_path}/e"))
    counted._jdf.collectToPython()
    assert max(rows_of_joins(counted._jdf.queryExecution().executedPlan())) <= 202


def test_fold_keeps_no_pairs_of_a_dense_site(spark, monkeypatch):
    """300 observations of one place and hour are one component without links between all of them (before: 44,850)."""
    from calorine.operators import stdbscan

    links = []
    for module in (stdbscan, nrt):
        if hasattr(module, "connected_components"):
            monkeypatch.setattr(module, "connected_components", lambda e, f=module.connected_components: links.append(e.count()) or f(e))
    rows = [(f"h{i:03}", 20.0 + i % 5 * 1e-4, 80.0, BASE + timedelta(seconds=i), 1.0, "D", None) for i in range(300)] + [("twice", -20.0, 80.0, BASE, None, "N", None)] * 2 + [("lost", None, 80.0, BASE, 1.0, "N", None)]
    states, actions = nrt.advance(spark.createDataFrame([], nrt.STATE), spark.createDataFrame(rows, "observation_hash string, latitude double, longitude double, acq_datetime timestamp, frp double, daynight string, event_id string"))
    assert sum(links) < 300
    assert sorted((r["event_id"], r["detection_count"], r["peak_frp"]) for r in states.collect()) == [("EVT_0000001", 300, 1.0), ("EVT_0000002", 2, None)]
    assert len(actions.collect()) == 303 and {r["action"] for r in actions.where("observation_hash = 'lost'").collect()} == {"skipped_invalid"}


def test_boxes_meet_without_a_broadcast(spark):
    box = lambda s, rows: spark.createDataFrame(rows, f"{s} string, {s}_w double, {s}_s double, {s}_e double, {s}_n double")
    left = box("l", [("a", 0.0, 0.0, 10.0, 10.0), ("b", 5000.0, 5000.0, 25000.0, 25000.0), ("c", -90000.0, 0.0, -90000.0, 0.0)])
    right = box("r", [("x", 12.0, 0.0, 13.0, 1.0), ("y", 9000.0, 9000.0, 21000.0, 21000.0), ("z", 99.0, 0.0, 99.0, 0.0)])
    pairs = association.met(left, right, 5.0, 10_000.0)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["l"], r["r"]) for r in pairs.collect()) == [("a", "x"), ("b", "y")]


def test_coverage_is_one_scan_of_events(spark):
    """Shares of discs under unions of boxes, without a pandas group for each event."""
    from calorine.functions.geo import box_rings
    from calorine.plans import environment

    d = lambda i: F.col("id") * 0.0 + i
    layer = spark.range(1).select(F.lit("Polygon").alias("geometry_type"), box_rings(d(79.9), d(19.9), d(80.0), d(20.1)).alias("rings"))
    layer = layer.union(layer)  # overlaps count once
    rows = [("half", 20.0, 80.0), ("all", 20.0, 79.95), ("none", 20.0, 80.5)]
    events = spark.createDataFrame([(*r, None, None) for r in rows], "event_id string, centroid_latitude double, centroid_longitude double, centroid_wkt string, footprint_wkt string")
    out = environment.vector_presence(events, layer, "water")
    assert "InPandas" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["event_id"]: r["water_coverage_fraction"] for r in out.collect()}
    assert abs(got["half"] - 0.5) < 0.02 and abs(got["all"] - 1) < 0.02 and got["none"] == 0


def test_association_plans_stay_small(spark):
    """Filters on boxes don't repeat whole geometries, and no constant is upper-cased by the driver."""
    from calorine.functions.geo import point_rings

    fac = spark.range(3).select(F.concat(F.lit("f"), "id").alias("facility_id"), F.lit("n").alias("facility_name"), F.lit("MINE").alias("facility_type"), F.lit("Point").alias("geometry_type"), point_rings(F.col("id") * 0.01 + 80.0, F.lit(20.0)).alias("rings"))
    none = F.lit(None).cast("string")
    ev = spark.range(2).select(F.concat(F.lit("e"), "id").alias("event_id"), F.lit(20.0).alias("centroid_latitude"), (F.col("id") * 9 + 80.0).alias("centroid_longitude"), none.alias("centroid_wkt"), none.alias("footprint_wkt"))
    pairs = association.candidates(ev, fac)
    plan = pairs._jdf.queryExecution()
    assert max(len(x) for x in plan.optimizedPlan().toString().splitlines() if "Filter" in x) < 2_000
    assert "upper(" not in plan.analyzed().toString()
    assert sorted((r["event_id"], r["facility_id"], r["candidate_rank"]) for r in pairs.collect()) == [("e0", f"f{i}", i + 1) for i in range(3)]
    from calorine.functions.geo import areal_type

    kinds = spark.createDataFrame([("Polygon",), ("MULTIPOLYGON",), ("Point",), ("polygons",), ("polygon\n",), (None,)], "k string")
    assert [r[0] for r in kinds.select(areal_type(F.col("k"))).collect()] == [True, True, False, False, False, None]


def test_long_lists_of_candidates_are_not_broadcast(spark):
    ev = spark.createDataFrame([("A", 20.0, 80.0, None, None)], "event_id string, centroid_latitude double, centroid_longitude double, centroid_wkt string, footprint_wkt string")
    fac = spark.createDataFrame([("f", "one", "MINE", "Point", "POINT (80.0 20.001)")], "facility_id string, facility_name string, facility_type string, geometry_type string, w string").withColumn("rings", parse_wkt(F.col("w"))).drop("w")
    out, _ = association.associate(ev, fac)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in plan.splitlines() if "LeftOuter" in x and "rightHint=(strategy=merge)" in x]  # small ones would be broadcast, and so would long ones by their compressed size
    assert [(r["facility_id"], r["candidate_facility_ids"]) for r in out.collect()] == [("f", "f")]


def test_whole_turns_of_longitude_are_apart(spark):
    """Places past 180 count as they stand (before: 70 and 430 made one event with its mean at 250, and the fold dropped 430)."""
    rows = [(20.0, x, h) for x, h in ((70.0, 0), (70.001, 1), (430.0, 0), (430.001, 1), (179.999, 0), (180.001, 1), (-179.9, 0), (179.996, 2), (-179.996, 2))]
    got = {r["det_id"]: r["cluster"] for r in cluster(points(spark, rows)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: None, 7: 4, 8: 4}
    seen = [(f"h{i}", 20.0, x, BASE + timedelta(hours=h), 1.0, "D", None) for i, (x, h) in enumerate(((70.0, 0), (430.0, 0), (430.001, 1), (70.001, 2)))]
    states, actions = nrt.advance(spark.createDataFrame([], nrt.STATE), spark.createDataFrame(seen, "observation_hash string, latitude double, longitude double, acq_datetime timestamp, frp double, daynight string, event_id string"))
    assert sorted((r["detection_count"], round(r["centroid_longitude"], 4)) for r in states.collect()) == [(2, 70.0005), (2, 430.0005)]
    assert {r["action"] for r in actions.collect()} == {"created", "matched"}
    raw = spark.createDataFrame([("a", "20", "430"), ("b", "95.5", "80"), ("c", "20", "80")], "observation_hash string, latitude string, longitude string").withColumns({"acq_date": F.lit("2024-01-01"), "acq_time": F.lit("0100"), "frp": F.lit("1"), "daynight": F.lit("D")})
    assert {r["observation_hash"]: r["latitude"] for r in nrt.observations_of(raw).collect()} == {"a": None, "b": None, "c": 20.0}


def test_sums_of_features_run_in_order_of_time(spark):
    """To the last bit, as one sum over an event's rows (before: by days, in any order)."""
    import random

    r = random.Random(7)
    rows = [(e * 100 + i, 20.0, 80.0 + r.random() / 1000, BASE + timedelta(hours=17 * i), r.random() * 300, True, 300 + r.random(), 290.0, "n", "D", f"e{e:03}") for e in range(200) for i in range(12)]
    shuffled = r.sample(rows, len(rows))
    got = events.features(spark.createDataFrame(shuffled, "det_id long, latitude double, longitude double, acq_datetime timestamp, frp double, frp_valid boolean, bright_ti4 double, bright_ti5 double, confidence string, daynight string, event_id string")).collect()
    assert len(got) == 200
    for x in got:
        own = [y for y in rows if y[10] == x["event_id"]]
        for name, k in (("total_frp", 4), ("mean_bright_ti4", 6), ("centroid_longitude", 2)):
            total = 0.0
            for y in own:
                total += y[k]
            assert x[name] == (total if name == "total_frp" else total / 12)
        assert x["distinct_detection_days"] == len({y[3].date() for y in own})


def test_shapes_are_one_aggregation_without_pandas_groups(spark):
    rows = [("a", 20.0, 80.0), ("a", 20.0, 80.0), ("b", 20.0, 80.0), ("b", 20.1, 80.0), ("c", 20.0, 80.0), ("c", 20.0, 80.2), ("c", 20.2, 80.0), ("c", 20.05, 80.05)]
    df = spark.createDataFrame(rows, "event_id string, latitude double, longitude double")
    made = events.footprints(df)
    assert {r["event_id"]: r["footprint_wkt"] for r in made.collect()} == {"a": "POINT (80.0 20.0)", "b": "LINESTRING (80.0 20.0, 80.0 20.1)", "c": "POLYGON ((80.0 20.0, 80.2 20.0, 80.0 20.2, 80.0 20.0))"}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Join" not in plan


def test_heavy_side_of_boxes_is_not_multiplied(spark):
    """Rows of left go to the cells that they cover, not to all in reach (before: four rows for a place by a corner)."""
    box = lambda s, n: spark.range(n).select(F.col("id").alias(s), *[(F.col("id") * 0.0 + 100.0).alias(f"{s}_{c}") for c in "wsen"])
    plan = association.met(box("l", 50), box("r", 2), 5000.0, 10_000.0)
    assert plan.count() == 100
    left = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "l_w" in left and not [x for x in left.splitlines() if "explode" in x and "l_w" in x and "5000.0" in x]
