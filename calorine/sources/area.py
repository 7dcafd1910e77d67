"""What a near-real-time fetch needs besides the network: checked parameters, the address without its secret, checked bodies."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

WORLD = (-180.0, -90.0, 180.0, 90.0)
MAX_DAYS = 5


def parse_bbox(text: str) -> tuple[float, float, float, float]:
    """west, south, east, north in degrees, or 'world'."""
    if (text or "").strip().lower() == "world":
        return WORLD
    try:
        west, south, east, north = (float(x) for x in (text or "").split(","))
    except ValueError:
        raise ValueError(f"bbox {text!r} is not west,south,east,north or 'world'") from None
    inside = all(-180 <= x <= 180 for x in (west, east)) and all(-90 <= y <= 90 for y in (south, north))
    if not inside or west > east or south > north:
        raise ValueError(f"bbox {text!r} is out of range or out of order")
    return west, south, east, north


def check_days(days: int) -> int:
    if days not in range(1, MAX_DAYS + 1):
        raise ValueError(f"day range {days} is not from 1 to {MAX_DAYS}")
    return days


def check_product(product: str) -> str:
    name = (product or "").strip()
    if not name or "/" in name or " " in name:
        raise ValueError(f"product {product!r} is not one token")
    return name


def area_url(base: str, key: str, product: str, bbox: str, days: int = 1, date: str | None = None) -> str:
    """The address of an area's detections; numbers are written without needless digits."""
    if not (key or "").strip():
        raise ValueError("a map key is needed")
    if date is not None and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", date):
        raise ValueError(f"date {date!r} is not YYYY-MM-DD")
    west_to_north = ",".join(f"{x:g}" for x in parse_bbox(bbox))
    parts = [base.rstrip("/"), "api/area/csv", key.strip(), check_product(product), west_to_north, str(check_days(days)), *([date] if date else [])]
    return "/".join(parts)


def redact(text: str, key: str = "") -> str:
    """text without the key, and without whatever stands where one would."""
    if (key or "").strip():
        text = text.replace(key.strip(), "***")
    return re.sub(r"(?i)(/api/area/csv/)[^/]+", r"\1***", text)


def body_rows(spark: SparkSession, body: str | None, key: str = "") -> DataFrame:
    """The rows of a fetched body, all text. An empty body, a page, or a table without a latitude is an error; a header alone is an empty table."""
    text = (body or "").strip()
    head = text.split("\n", 1)[0].lower()
    if not text:
        raise ValueError("the body is empty")
    if text.startswith("<") or "latitude" not in [c.strip(' "\r') for c in head.split(",")]:
        raise ValueError(f"the body is no table of detections: {redact(text[:200], key)!r}")
    rows = list(csv.reader(io.StringIO(text)))
    names = [c.strip() for c in rows[0]]
    data = [[x or None for x in r[: len(names)]] + [None] * (len(names) - len(r)) for r in rows[1:] if r]
    return spark.createDataFrame(data, ", ".join(f"`{n}` string" for n in names))


def summary(rows: DataFrame) -> DataFrame:
    """One row: observations, ranges of place and date (NULL where nothing parses)."""
    lat, lon = (F.trim(c).try_cast("double") for c in ("latitude", "longitude"))
    real = lambda c: F.when(~F.isnan(c), c)
    return rows.agg(F.count(F.lit(1)).alias("observation_count"), F.min(real(lat)).alias("latitude_min"), F.max(real(lat)).alias("latitude_max"), F.min(real(lon)).alias("longitude_min"), F.max(real(lon)).alias("longitude_max"), F.min("acq_date").alias("first_date"), F.max("acq_date").alias("last_date"))
