"""Sessions and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, name: str = "calorine", **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    } | conf
    session = builder.config(map=settings).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on one machine without it, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="calorine-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


_held: dict[str, SparkSession] = {}
#: Where scratch is a file: folder, leave out checksum files: without native libraries each file there costs four processes (chmod) otherwise.
_PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def saved(df: DataFrame, name: str, compression: str = "zstd", **options: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage and survives lost executors.

    The files go when `discard` is called on the frame, or else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression=compression, **_PLAIN_FILES, **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    _held[path] = spark
    return out


def discard(*frames: DataFrame) -> None:
    """Remove the files of frames that `saved` made and that nothing reads any more."""
    for df in frames:
        path = vars(df).get("scratch_path")  # not getattr, which finds a column of this name
        spark = _held.pop(path, None)
        if spark is not None:
            _delete(spark, path)


def let_go(spark: SparkSession) -> None:
    """Have the driver collect its garbage: only then are the files of shuffles that no plan reads any more removed.

    The last event of a query holds its plan, and whoever takes events holds the last one until another comes; so an empty query goes first.
    """
    spark.range(0).collect()
    with contextlib.suppress(Exception):  # events that are late only keep files for longer
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(5_000)
    spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for path, spark in _held.items():
        with contextlib.suppress(Exception):  # a stopped session's gateway; nothing is left to tell
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)


def partitions(df: DataFrame, bytes_each: int = 128 << 20) -> int:
    """Partitions for a shuffle of about what df's files hold: the session's number, or more where those would be large."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    total = sum(x for x in sizes if x < 1 << 58)  # a leaf of unknown size says 2**63
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-total // bytes_each))
