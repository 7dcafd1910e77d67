"""Finding inputs: by pattern in a folder, by suffix and hint in a name, or the first of several paths that exists."""

from __future__ import annotations

from fnmatch import fnmatch

from pyspark.sql import SparkSession

DETECTION_PATTERNS = ("*fire*.csv", "*viirs*.csv", "*firms*.csv")
MAP_SUFFIXES, MAP_HINTS = (".geojson", ".json", ".csv", ".parquet"), ("osm", "facilit", "industrial")
LABEL_SUFFIXES, LABEL_HINTS = (".csv", ".parquet", ".geojson"), ("valid", "reference", "label", "truth")


def files(spark: SparkSession, folder: str) -> list[str]:
    """Paths in a folder of any file system that the session reads, sorted by name; none where there is no such folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted((s.getPath().toString() for s in fs.listStatus(at)), key=lambda p: p.rsplit("/", 1)[-1]) if fs.exists(at) else []


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def detections(spark: SparkSession, folder: str, patterns: tuple[str, ...] = DETECTION_PATTERNS) -> list[str]:
    """Detection files of a folder, each once; FileNotFoundError where there is none."""
    found = [p for p in files(spark, folder) if any(fnmatch(p.rsplit("/", 1)[-1].lower(), x) for x in patterns)]
    if not found:
        raise FileNotFoundError(f"no file in {folder} matches {', '.join(patterns)}")
    return found


def by_hint(spark: SparkSession, folder: str, suffixes: tuple[str, ...], hints: tuple[str, ...]) -> list[str]:
    """Files with one of the suffixes whose name holds one of the hints."""
    names = [(p, p.rsplit("/", 1)[-1].lower()) for p in files(spark, folder)]
    return [p for p, n in names if n.endswith(suffixes) and any(h in n for h in hints)]


def map_extract(spark: SparkSession, folder: str) -> str | None:
    """The first map extract of a folder, in order of suffix and name."""
    found = by_hint(spark, folder, MAP_SUFFIXES, MAP_HINTS)
    return min(found, key=lambda p: (next(i for i, s in enumerate(MAP_SUFFIXES) if p.lower().endswith(s)), p), default=None)


def labels(spark: SparkSession, primary: str | None, folder: str | None) -> list[str]:
    """The reference labels at hand: the primary path where it exists, then what a folder holds."""
    own = [primary] if primary and exists(spark, primary) else []
    return own + [p for p in (by_hint(spark, folder, LABEL_SUFFIXES, LABEL_HINTS) if folder else []) if p not in own]


def first(spark: SparkSession, *paths: str | None) -> str:
    """The first path that exists, such as a stage's output or else that of the stage before it."""
    for p in paths:
        if p and exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(p for p in paths if p) or "no path given")


def any_source(spark: SparkSession, paths: list[str | None]) -> bool:
    return any(p and exists(spark, p) for p in paths)
