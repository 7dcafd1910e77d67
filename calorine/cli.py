"""One command line for all stages: python -m calorine.cli STAGE --input ... --output ...

Stages read what the stage before them wrote (Parquet) and write a table and, with --report, a JSON report.
Exit code 2: a source that the stage needs is not there.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from calorine.plans import anomaly, association, chain, clean, environment, events, facilities, fingerprint, fusion, load, reports, risk, sta, validation
from calorine.sources import discover, readers, references

STAGES = ("clean", "events", "persistence", "facilities", "association", "fingerprints", "anomaly", "sta", "environment", "fusion", "risk", "validation", "load", "all")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="calorine", description=__doc__)
    p.add_argument("stage", choices=STAGES)
    p.add_argument("--input", nargs="+", default=[], help="files, or a folder to search")
    p.add_argument("--facilities")
    p.add_argument("--layer", action="append", default=[], metavar="NAME=PATH", help="vegetation, builtup, water or agriculture; sta for static anomalies")
    p.add_argument("--references")
    p.add_argument("--candidates")
    p.add_argument("--pattern", help="of dates; found from the data without it")
    p.add_argument("--output")
    p.add_argument("--report")
    return p


def _layer(spark: SparkSession, path: str) -> DataFrame:
    return readers.osm_extract(spark, path)


def _raw(spark: SparkSession, inputs: list[str]) -> DataFrame:
    folder = len(inputs) == 1 and not inputs[0].endswith(".csv")
    return readers.detections_csv(spark, discover.detections(spark, inputs[0]) if folder else inputs)


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The stage's table; ValueError or FileNotFoundError where something it needs is missing."""
    layers = dict(x.split("=", 1) for x in args.layer)
    vectors = {k: _layer(spark, v) if discover.exists(spark, v) else None for k, v in layers.items() if k != "sta"}
    masks = None
    if "sta" in layers:
        if not discover.exists(spark, layers["sta"]):
            raise FileNotFoundError(layers["sta"])
        masks = sta.normalize(_layer(spark, layers["sta"]), "MASK").where("is_valid")
    table = (lambda: spark.read.parquet(args.input[0])) if args.input else None
    places = (lambda: spark.read.parquet(discover.first(spark, args.facilities)))
    if args.stage in ("clean", "all") or args.stage == "events" and args.input[0].endswith(".csv"):
        raw = _raw(spark, args.input)
        if args.stage == "clean":
            return clean.clean(raw, args.pattern)
        return chain.run(raw, places(), vectors, masks, args.pattern)["events"] if args.stage == "all" else chain.form(raw, args.pattern)[0]
    if args.stage == "facilities":
        return facilities.ingest(readers.osm_extract(spark, discover.map_extract(spark, args.input[0]) or args.input[0]))[0].drop("tags")
    if args.stage == "events":
        rows = table()
        return events.form(rows if "det_id" in rows.columns else rows.withColumn("det_id", F.xxhash64(*rows.columns)))[0]
    if args.stage == "load":
        load.replace_all(places(), table(), spark.read.parquet(args.candidates), args.output)
        return spark.read.parquet(f"{args.output}/events")
    rows = table()
    stages = {
        "persistence": lambda: chain.describe(rows),
        "association": lambda: association.associate(rows, places())[0],
        "fingerprints": lambda: fingerprint.fingerprints(rows, places().select("facility_id", "facility_name", "facility_type")),
        "anomaly": lambda: anomaly.score(rows),
        "sta": lambda: sta.evidence(rows, masks) if masks is not None else chain.without_sta(rows),
        "environment": lambda: environment.context(rows, vectors),
        "fusion": lambda: fusion.fuse(rows),
        "risk": lambda: risk.prioritize(rows),
        "validation": lambda: validation.match(references.load(spark, discover.first(spark, args.references)), rows),
    }
    return stages[args.stage]()


REPORTS = {"persistence": reports.persistence_report, "association": reports.association_report, "fingerprints": reports.fingerprint_report, "risk": reports.risk_report, "all": reports.risk_report}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"calorine-{args.stage}").getOrCreate()
    try:
        out = run(spark, args)
    except FileNotFoundError as e:
        print(f"{args.stage}: not found: {e}", file=sys.stderr)
        return 2
    if args.output and args.stage != "load":
        readers.write_table(out, args.output)
        out = spark.read.parquet(args.output)
    if args.report and args.stage in REPORTS:
        made = REPORTS[args.stage](out)
        spark.createDataFrame([(json.dumps(made, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(args.report)
    if not args.output:
        out.show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
