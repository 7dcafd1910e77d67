"""Near-duplicate vectors: cross-polytope hashes after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import FloatType

from calorine.functions.session import partitions, saved
from calorine.llm.words import mix
from calorine.operators.graph import connected_components

THRESHOLD = 0.95
SEED = 20_011
#: Vectors of a bucket that one task compares at once; larger buckets are dealt out as pairs of chunks.
CHUNK_ROWS = 2048
#: Linked pairs of a block whose buckets are compared at once.
PAIRS = 1 << 18


def shape(n: int, dim: int) -> tuple[int, int]:
    """Hashes a bucket key joins, so that buckets stay small as n grows, and tables, so that recall stays."""
    d = 1 << max(1, math.ceil(math.log2(max(dim, 2))))
    joined = max(1, round(math.log(max(n, 2) / 8) / math.log(2 * d)))
    return joined, math.ceil(4 * 1.55**joined)


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of random signs and a fast Hadamard transform, over rows padded to a power of two."""
    for s in signs:
        x = x * s
        h = 1
        while h < x.shape[1]:
            y = x.reshape(len(x), -1, 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), -1)
            h *= 2
    return x


def vertices(x: np.ndarray, joined: int, tables: int, seed: int = SEED) -> np.ndarray:
    """Hashes of unit rows by row, table and place in the key: the nearest vertex of the cross-polytope and the next.

    A vertex is a coordinate, by magnitude, with its sign.
    """
    d = 1 << max(1, math.ceil(math.log2(max(x.shape[1], 2))))
    padded = np.zeros((len(x), d))
    padded[:, : x.shape[1]] = x
    rng = np.random.default_rng(seed + x.shape[1])
    out = np.zeros((len(x), tables, joined, 2), np.uint16)
    rows = np.arange(len(x))[:, None]
    for t in range(tables):
        for k in range(joined):
            y = rotate(padded, rng.choice([-1.0, 1.0], (3, d)))
            top = np.argpartition(np.abs(y), -2, axis=1)[:, -2:]
            top = np.take_along_axis(top, np.argsort(-np.abs(y[rows, top]), axis=1, kind="stable"), 1)
            out[:, t, k] = 2 * top + (y[rows, top] < 0)
    return out


def bucket_keys(found: np.ndarray, dim: int) -> np.ndarray:
    """Bucket keys (int64) by row, table and probe: the own bucket, then for each hash the runner-up in its place."""
    n, tables, joined, _ = found.shape
    keys = np.empty((n, tables, joined + 1), np.uint64)
    for probe in range(joined + 1):
        key = np.broadcast_to(np.arange(tables, dtype=np.uint64) * np.uint64(1_000_003) + np.uint64(dim), (n, tables))
        for k in range(joined):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + found[:, :, k, int(probe == k + 1)].astype(np.uint64))
        keys[:, :, probe] = key
    return keys.view(np.int64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # keeps the norm of any finite vector finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(vectors: DataFrame, joined: int, tables: int, kind: str) -> DataFrame:
    """A row for each vector: id, weight, its numbers and its vertices as bytes, and its bucket keys."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                dims = pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False)
                for d in np.unique(dims).tolist():
                    own = part.filter(pa.array(dims == d))
                    x = own.column(2).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, d)
                    found = vertices(_unit(x), joined, tables)
                    keys = bucket_keys(found, d).reshape(len(x), -1)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([v.tobytes() for v in found], pa.binary()), lists], names=["id", "weight", "vector", "vertices", "keys"])

    return vectors.select("id", "weight", "vector").mapInArrow(scan, "id long, weight long, vector binary, vertices binary, keys array<long>")


def _first_met(keys: np.ndarray, i: np.ndarray, j: np.ndarray, bucket: int) -> np.ndarray:
    """Whether rows i and j share no bucket below this one; a key names its table, so tables are compared one by one."""
    fresh = np.ones(len(i), bool)
    low = keys < bucket
    for t in range(keys.shape[1]):
        for p in range(keys.shape[2]):
            a = np.where(low[i, t, p], keys[i, t, p], bucket)
            for q in range(keys.shape[2]):
                fresh &= (a != keys[j, t, q]) | (a == bucket)
    return fresh


def _block(ids, weights, x, found, chunk, lo, hi, bucket, threshold, shape_of):
    """Links inside one block: (id, weight of its partners, least id of its block component) of linked rows.

    A pair counts in the least bucket that both share, so it is counted once over all
    tables; components need no such care.
    """
    x = _unit(x)
    linked = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    if lo != hi:
        linked &= chunk[:, None] != chunk[None, :]
    rows = np.flatnonzero(linked.any(1))
    if not len(rows):
        return None
    linked = linked[np.ix_(rows, rows)]
    ids, weights = ids[rows], weights[rows]
    keys = bucket_keys(found[rows].reshape(len(rows), *shape_of, 2), x.shape[1])
    one, two = np.nonzero(np.triu(linked))
    links = np.zeros(len(rows), np.int64)
    for s in range(0, len(one), PAIRS):
        i, j = one[s : s + PAIRS], two[s : s + PAIRS]
        fresh = _first_met(keys, i, j, bucket)
        np.add.at(links, i[fresh], weights[j[fresh]])
        np.add.at(links, j[fresh], weights[i[fresh]])
    label = ids.copy()
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(1))
        if (low == label).all():
            break
        label = low
    return ids, links, label


def near(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, links, low): per block, what is linked; ids are classes of equal vectors with their weight (rows).

    A vector goes along to each of its buckets in one shuffle, as plain bytes; the
    rows that say which buckets are larger than a block number one in CHUNK_ROWS
    entries at most, and Spark broadcasts them only if their file is small enough.
    """
    n = vectors.count()
    dim = vectors.agg(F.max(F.size("vector"))).first()[0] or 2
    joined, tables = shape(n, dim)
    kind = "<f4" if isinstance(vectors.schema["vector"].dataType.elementType, FloatType) else "<f8"
    rows = saved(_hashed(vectors, joined, tables, kind), "vector-hashes", "none")
    sizes = rows.select(F.explode("keys").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    large = saved(sizes.where(F.col("size") > CHUNK_ROWS).select("bucket", F.ceil(F.col("size") / CHUNK_ROWS).cast("int").alias("parts")), "vector-large")
    placed = rows.select("id", "weight", "vector", "vertices", F.explode("keys").alias("bucket")).join(large, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    placed = placed.withColumn("other", other).withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other")).drop("other", "parts")

    def numbers(column: pa.Array, dtype: str, s: int, e: int) -> np.ndarray:
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int32)[column.offset + s : column.offset + e + 1]
        return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(dtype).reshape(e - s, -1)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(table: pa.Table, upto: int, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            part = table.slice(0, upto).combine_chunks()
            if not upto:
                return
            bucket, lo, hi, chunk, ids, weights = (part.column(k).to_numpy() for k in range(6))
            vector, vertex = (part.column(k).chunk(0) for k in (6, 7))
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), upto], strict=True):
                if e - s > 1:
                    found = _block(ids[s:e], weights[s:e], numbers(vector, kind, s, e), numbers(vertex, "<u2", s, e), chunk[s:e], lo[s], hi[s], bucket[s], threshold, (tables, joined))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], names=["id", "links", "low"])

        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, new]) if held else new
            if not held.num_rows:
                continue
            place = np.stack([held.column(k).to_numpy().astype(np.int64) for k in range(3)])
            starts = np.flatnonzero(np.concatenate([[True], (place[:, 1:] != place[:, :-1]).any(0)]))
            cut = int(starts[-1])  # the last block may go on
            yield from whole(held, cut, starts[:-1])
            held = held.slice(cut)
        if held and held.num_rows:
            yield from whole(held, held.num_rows, np.zeros(1, np.int64))

    parts = partitions(rows, 32 << 20)
    dealt = placed.select("bucket", "lo", "hi", "chunk", "id", "weight", "vector", "vertices").repartition(parts, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return saved(dealt.mapInArrow(blocks, "id long, links long, low long"), "vector-links")


def dedup(table: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link by cosine >= threshold, in double precision, whatever their labels.
    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing; vectors of different lengths are not compared. Equal vectors are
    one class that is hashed once. Rows with equal vec_ids count as several vectors
    and share a component; rows without a vec_id take no part (component null). An
    empty table gives an empty result. Other columns are ignored.
    """
    single = isinstance(getattr(table.schema["embedding"].dataType, "elementType", None), FloatType)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("vector"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", finite) & F.exists("vector", lambda v: v != 0), F.lit(False))
    good = rows.where(usable)
    classes = saved(good.groupBy("vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight")), "vector-classes")
    found = near(classes, threshold)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    members = good.join(classes, "vector").select("vec_id", "id", "weight")
    copies = members.where("vec_id <> id").select(F.col("vec_id").alias("u"), F.col("id").alias("v")).join(classes.select(F.col("id").alias("u")).distinct(), "u", "left_semi")
    parts = connected_components(found.where("id <> low").select(F.col("id").alias("u"), F.col("low").alias("v")).union(copies))
    own = members.join(links, "id", "left").join(parts.withColumnsRenamed({"node": "id"}), "id", "left")
    linked = own.select("vec_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    rest = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = f"""
with recursive v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
    where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from r join l on r.b = l.a)
select e.vec_id, (select count(*) from l where l.a = e.vec_id) as n_links, min(r.b) as component_id, e.vec_id = min(r.b) as kept
from embeddings e join r on r.a = e.vec_id group by e.vec_id
"""
