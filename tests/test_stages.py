import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from calorine import cli
from calorine.functions.geo import box_rings, point_rings
from calorine.plans import chain, load, reports
from calorine.sources import area, discover, references
from calorine.streaming import refresh

BASE = datetime(2023, 1, 1, 6)


def raw_lines(n=30):
    head = "latitude,longitude,bright_ti4,scan,track,acq_date,acq_time,satellite,instrument,confidence,version,bright_ti5,frp,daynight,type"
    rows = []
    for i in range(n):
        t = BASE + timedelta(hours=9 * (i // 3))
        lat, lon = [(21.5, 82.1), (13.0, 80.2), (25.0 + i, 75.0)][i % 3]
        rows.append(f"{lat + 0.001 * (i % 2)},{lon},330.5,0.5,0.4,{t:%d-%m-%Y},{t:%H%M},N20,VIIRS,{'nlh'[i % 3]},2,290.1,{2.5 + i},{'DN'[i % 2]},0")
    return "\n".join([head, *rows, rows[0]])


def places(spark):
    box = box_rings(F.lit(82.09), F.lit(21.49), F.lit(82.11), F.lit(21.51))
    one = spark.range(1).select(F.lit("osm_way_1").alias("facility_id"), F.lit("Works").alias("facility_name"), F.lit("REFINERY").alias("facility_type"), F.lit("Polygon").alias("geometry_type"), box.alias("rings"))
    return one.union(spark.range(1).select(F.lit("osm_node_2"), F.lit("Pit"), F.lit("MINE"), F.lit("Point"), point_rings(F.lit(80.23), F.lit(13.0))))


def test_all_stages_from_raw_rows(spark, tmp_path):
    (tmp_path / "viirs_a.csv").write_text(raw_lines())
    (tmp_path / "notes.txt").write_text("x")
    assert [p.rsplit("/", 1)[-1] for p in discover.detections(spark, str(tmp_path))] == ["viirs_a.csv"]
    with pytest.raises(FileNotFoundError):
        discover.detections(spark, str(tmp_path / "none"))
    places(spark).write.parquet(str(tmp_path / "places"))
    out, report = str(tmp_path / "out"), str(tmp_path / "report")
    assert cli.main(["all", "--input", str(tmp_path), "--facilities", str(tmp_path / "places"), "--output", out, "--report", report], spark) == 0
    events = {r["facility_association_method"]: r for r in spark.read.parquet(out).collect()}
    assert set(events) == {"WITHIN_FACILITY", "NEAR_FACILITY"}
    works = events["WITHIN_FACILITY"]
    assert works["facility_id"] == "osm_way_1" and works["detection_count"] == 10 and works["persistence_label"] == "PERSISTENT" and works["candidate_interpretation"] == "INDUSTRIAL_ACTIVITY_CANDIDATE"
    assert works["sta_evidence_available"] is False and works["vegetation_available"] is False and works["vegetation_present"] is None
    made = json.loads(spark.read.text(report).first()[0])
    assert {x["check_name"] for x in made["checks"]} >= {"risk_score_near_constant"}
    assert cli.main(["sta", "--input", out, "--layer", f"sta={tmp_path}/no.geojson"], spark) == 2


def test_a_batch_refreshes_what_it_touched(spark):
    def detections(rows):
        data = [(i, e, lat, 82.1, BASE + timedelta(hours=h), 3.0 + i, True, 330.0, 290.0, "n", "D") for i, (e, lat, h) in enumerate(rows)]
        return spark.createDataFrame(data, "det_id long, event_id string, latitude double, longitude double, acq_datetime timestamp, frp double, frp_valid boolean, bright_ti4 double, bright_ti5 double, confidence string, daynight string")

    actions = lambda *ids: spark.createDataFrame([(f"h{i}", e, "matched") for i, e in enumerate(ids)] + [("hx", None, "skipped_invalid")], "observation_hash string, event_id string, action string")
    first = refresh.refresh(None, detections([("E1", 21.5, h) for h in range(4)] + [("E2", 30.0, 1), ("E2", 30.0, 2)]), actions("E1", "E2"), places(spark))
    stored = spark.createDataFrame(first["events"].collect(), first["events"].schema)
    again = refresh.refresh(stored, detections([("E1", 21.5, h) for h in range(4)]), actions("E1"), places(spark))
    assert refresh.changed_rows(stored, again["events"], ["risk_score", "detection_count", "facility_id"]).count() == 0  # the same batch again
    more = refresh.refresh(stored, detections([("E1", 21.5, h) for h in range(7)]), actions("E1"), places(spark))
    got = {r["event_id"]: r for r in more["events"].collect()}
    assert got["E1"]["detection_count"] == 7 and got["E2"]["detection_count"] == 2
    assert [(r["facility_id"], r["event_count"]) for r in more["fingerprints"].collect()] == [("osm_way_1", 1)]
    assert refresh.temporal_features([BASE, BASE + timedelta(hours=30)]) == {"detection_count": 2, "observed_duration_hours": 30.0, "distinct_detection_days": 2, "span_days": 2, "mean_gap_hours": 30.0, "max_gap_hours": 30.0}


def test_fetch_parameters_and_bodies(spark):
    assert area.area_url("https://x.example/", "KEY", "VIIRS_NOAA20_NRT", "68.0,6.0,98.0,37.5", 2) == "https://x.example/api/area/csv/KEY/VIIRS_NOAA20_NRT/68,6,98,37.5/2"
    assert "KEY" not in area.redact("https://x.example/api/area/csv/KEY/a", "KEY") and "zzz" not in area.redact("/api/area/csv/zzz/a")
    assert area.parse_bbox("world") == (-180.0, -90.0, 180.0, 90.0)
    for bad in ("", "1,2,3", "9,0,8,1", "0,0,200,1", "a,b,c,d"):
        with pytest.raises(ValueError):
            area.parse_bbox(bad)
    for call in (lambda: area.check_days(6), lambda: area.check_product("a/b"), lambda: area.body_rows(spark, " "), lambda: area.body_rows(spark, "<html>"), lambda: area.body_rows(spark, "Invalid key")):
        with pytest.raises(ValueError):
            call()
    rows = area.body_rows(spark, raw_lines(3))
    assert rows.count() == 4 and area.summary(rows).first()["latitude_max"] == 27.0 and area.body_rows(spark, "latitude,longitude").count() == 0


def test_reference_labels_of_any_names(spark, tmp_path):
    (tmp_path / "reference.csv").write_text("id,label,source,lat,lon,date,independent\nr1,Gas flare,Official list,10,70,2024-01-02,\n,forest fire,FIRMS,11,71,,yes\n,,manual,x,72,2024-01-03,no\n")
    (tmp_path / "label.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"label": "industrial", "source": "curated"}, "geometry": {"type": "Point", "coordinates": [70.5, 9.5]}}]}))
    assert len(discover.labels(spark, str(tmp_path / "nothing.csv"), str(tmp_path))) == 2
    got = {r["validation_id"]: r for r in references.load(spark, str(tmp_path / "reference.csv")).collect()}
    assert set(got) == {"r1"} | {k for k in got if k.startswith("val_")} and len(got) == 3
    assert got["r1"]["reference_label_normalized"] == "INDUSTRIAL" and got["r1"]["validation_source_independent"] is True and got["r1"]["reference_latitude"] == 10.0
    assert sorted((r["reference_label_normalized"], r["validation_source_independent"]) for k, r in got.items() if k != "r1") == [("NATURAL", True), ("UNKNOWN", False)]
    geo = references.load(spark, str(tmp_path / "label.geojson")).first()
    assert (geo["reference_latitude"], geo["reference_longitude"], geo["reference_label_normalized"]) == (9.5, 70.5, "INDUSTRIAL")


def test_checked_load(spark, tmp_path):
    f = spark.createDataFrame([("F1", "10", "70"), ("F1", "11", "70"), (None, "1", "1"), ("F2", "99", "1")], "facility_id string, latitude string, longitude string")
    e = spark.createDataFrame([("E1", "10", "70", "50"), ("E2", "10", "70", "150"), ("E3", "nan", "70", None)], "event_id string, centroid_latitude string, centroid_longitude string, risk_score string")
    c = spark.createDataFrame([("E1", "F1", "1", "2.0"), ("E2", "F1", "1", "2.0"), ("E1", "F9", "1", "2"), ("E1", "F1", "2", "1")], "event_id string, facility_id string, candidate_rank string, distance_km string")
    out = load.replace_all(f, e, c, str(tmp_path / "load"))
    assert {k: (v["received"], v["inserted"], v["rejected"], v["duplicates"]) for k, v in out.items()} == {"facilities": (4, 1, 3, 1), "events": (3, 1, 2, 0), "candidates": (4, 1, 3, 1)}
    assert load.replace_all(f, e, c, str(tmp_path / "load"))["events"]["inserted"] == 1  # in place of what was there
    assert reports.missing_source("sta", ["a"])["matched_events"] is None
