"""Tolerant parsing of text columns; missing stays NULL, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Texts that count as missing in free text, in numbers, and in the fields of an observation's hash.
MISSING = ("", "nan", "none", "null", "nat", "<na>")
MISSING_NUMBER = ("", "nan")
MISSING_HASHED = ("", "nan", "none", "nat", "<na>")


def require_columns(df: DataFrame, columns: list[str] | tuple[str, ...]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: Column | str, missing: tuple[str, ...] = MISSING) -> Column:
    t = F.trim(col(c).cast("string"))
    return F.when(~F.lower(t).isin(*missing), t)


def is_missing(c: Column | str, missing: tuple[str, ...] = MISSING) -> Column:
    return clean_text(c, missing).isNull()


def to_double(c: Column | str) -> Column:
    d = F.trim(col(c).cast("string")).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def to_long(c: Column | str) -> Column:
    return to_double(c).try_cast("long")


def to_boolean(c: Column | str) -> Column:
    t = F.lower(F.trim(col(c).cast("string")))
    return F.when(t.isin("true", "1", "yes", "t", "1.0"), True).when(t.isin("false", "0", "no", "f", "0.0"), False)


def to_utc(c: Column | str) -> Column:
    t = F.trim(col(c).cast("string"))
    return F.coalesce(F.try_to_timestamp(t), *[F.try_to_timestamp(t, F.lit(p)) for p in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd", "dd-MM-yyyy", "yyyy/MM/dd")])


def to_map(c: Column | str) -> Column:
    return F.from_json(clean_text(c), "map<string,string>")


def valid_lon_lat(lon: Column | str, lat: Column | str) -> Column:
    return F.coalesce(col(lon).between(-180, 180) & col(lat).between(-90, 90), F.lit(False))


def letters_only(c: Column) -> Column:
    return c.rlike(r"^\p{L}+$")


def normal_confidence(c: Column | str) -> Column:
    t = F.trim(col(c))
    return F.when(letters_only(t), F.lower(t)).otherwise(t)


def normal_daynight(c: Column | str) -> Column:
    t = F.trim(col(c))
    return F.when(letters_only(t), F.upper(t)).otherwise(t)


def clock(c: Column | str) -> tuple[Column, Column]:
    """(hour, minute) of an HHMM number without padding; NULL when invalid."""
    n = F.bround(to_double(c)).try_cast("int")
    ok = n.between(0, 2359) & (F.pmod(n, F.lit(100)) <= 59)
    return F.when(ok, F.floor(n / 100).cast("int")), F.when(ok, F.pmod(n, F.lit(100)))


def acquired(date: Column | str, time: Column | str, pattern: str = "yyyy-MM-dd") -> Column:
    hour, minute = clock(time)
    day = F.try_to_timestamp(F.trim(col(date)), F.lit(pattern))
    return F.timestamp_micros(F.unix_micros(day) + (hour * 3600 + minute * 60).cast("long") * 1_000_000)


def acquired_nrt(date: Column | str, time: Column | str) -> Column:
    """Near-real-time form: one to four digits are a time, NULL when there is no such time; anything else counts as midnight."""
    text = F.trim(F.coalesce(col(time), F.lit("0")))
    hhmm = F.when(text.rlike(r"^\d{1,4}$"), F.lpad(text, 4, "0")).otherwise(F.lit("0000"))
    return F.try_to_timestamp(F.concat(F.trim(col(date)), F.lit(" "), hhmm), F.lit("yyyy-MM-dd HHmm"))


def first_present(*cs: Column | str) -> Column:
    return F.coalesce(*[clean_text(c) for c in cs])


def hours(a: Column, b: Column) -> Column:
    """Hours from a to b."""
    return (F.unix_micros(col(b).cast("timestamp")) - F.unix_micros(col(a).cast("timestamp"))) / F.lit(3.6e9)


def canonical_json(m: Column) -> Column:
    """A map as JSON with sorted keys and ', ' / ': ' separators."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"^\{\"v\":(.*)\}$", 1)
    pairs = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(quoted(e["key"]), F.lit(": "), F.coalesce(quoted(e["value"]), F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def serialize_attributes(m: Column) -> Column:
    """Sorted k=v pairs joined by ';', blanks left out."""
    kept = F.filter(F.array_sort(F.map_entries(m)), lambda e: ~is_missing(e["value"]))
    return F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), F.trim(e["value"]))), ";")


# ---------------------------------------------------------------- identities
#: The fields of an observation's identity, in their order.
OBSERVATION_FIELDS = ("latitude", "longitude", "bright_ti4", "scan", "track", "acq_date", "acq_time", "satellite", "instrument", "confidence", "version", "bright_ti5", "frp", "daynight", "type")


def observation_hash(fields: tuple[str, ...] = OBSERVATION_FIELDS) -> Column:
    lines = [F.concat(F.lit(f"{f}="), F.coalesce(clean_text(f, MISSING_HASHED), F.lit(""))) for f in fields]
    return F.sha2(F.concat_ws("\n", F.lit("hash_version=v1"), *lines), 256)


def osm_facility_id(osm_type: Column | str, osm_id: Column | str) -> Column:
    t, i = F.lower(clean_text(osm_type)), clean_text(osm_id)
    return F.when(t.isin("node", "way", "relation") & i.isNotNull(), F.concat(F.lit("osm_"), t, F.lit("_"), i))


def fallback_facility_id(lat: Column, lon: Column, name: Column, tags: Column) -> Column:
    payload = F.concat_ws("|", F.format_string("%.6f", lat), F.format_string("%.6f", lon), F.coalesce(name, F.lit("")), canonical_json(tags))
    return F.concat(F.lit("fallback_"), F.substring(F.sha2(payload, 256), 1, 16))


def sta_id(layer: Column, native: Column, payload: Column) -> Column:
    clean = F.regexp_replace(clean_text(native), r"[^\p{L}\p{N}_-]", "_")
    return F.coalesce(F.concat(F.lit("sta_"), F.lower(layer), F.lit("_"), clean), F.concat(F.lit("sta_"), F.lower(layer), F.lit("_hash_"), F.substring(F.sha2(payload, 256), 1, 16)))


def split_osm_id(c: Column | str) -> tuple[Column, Column]:
    """(type, id) of texts such as way/123."""
    pattern = r"(?i)^(node|way|relation)[/:](\d+)$"
    t = F.trim(col(c))
    return F.nullif(F.lower(F.regexp_extract(t, pattern, 1)), F.lit("")), F.nullif(F.regexp_extract(t, pattern, 2), F.lit(""))
