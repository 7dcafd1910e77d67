"""Benchmark decontamination: documents scanned against a hash set of benchmark windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from calorine.functions.session import saved
from calorine.llm.words import ALNUM, Words, bounded, chunks, rolling

#: Windows (with their items) that are sent to all tasks, at most: about 300 bytes each in a Python worker. More are joined by hash.
WINDOWS_PER_SCAN = 200_000
#: Bits of the filter by which a scan passes over windows that the benchmark surely lacks: of fixed size.
FILTER_BITS = 1 << 25
REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class WindowSet:
    """Windows of the benchmark by width: sorted hashes, the words behind each, and the items that hold it."""

    def __init__(self, rows: Iterable[tuple[int, int, bytes, str]]):
        held: dict[int, dict[int, dict[bytes, set[str]]]] = {}
        for k, h, words, item in rows:
            held.setdefault(k, {}).setdefault(h & (1 << 64) - 1, {}).setdefault(bytes(words), set()).add(item)
        self.by_width = {k: (np.array(sorted(d), np.uint64), d) for k, d in sorted(held.items())}

    def hits(self, w: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words of a chunk are hit, and the items by row."""
        mark = np.zeros(len(w.start) + 1, np.int64)
        items: dict[int, set[str]] = {}
        for k, (sorted_hashes, known) in self.by_width.items():
            h, whole = w.windows(k)
            if not len(h):
                continue
            at = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
            for i in np.flatnonzero(whole & (sorted_hashes[at] == h)).tolist():
                found = known[int(h[i])].get(w.text(i, i + k))  # the words themselves decide
                if found:
                    mark[i] += 1
                    mark[i + k] -= 1
                    items.setdefault(int(np.searchsorted(w.first, i, "right")) - 1, set()).update(found)
        return np.cumsum(mark[:-1]) > 0, items


def _judge(w: Words, windows: WindowSet):
    hit, items = windows.hits(w)
    n_words = np.diff(w.first)
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[w.first[1:]] - total[w.first[:-1]]
    return hit, n_words, n_hit, items, (n_hit > 0) & (20 * n_hit >= n_words)


def benchmark_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(k, hash, words, item): distinct windows of the items, of `width` words or the whole of a shorter item."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(0).to_pylist()
            for a, b, w in chunks(batch.column(1), ALNUM):
                out: list[tuple[int, int, bytes, str]] = []
                for i in range(b - a):
                    s, e = int(w.first[i]), int(w.first[i + 1])
                    k = min(e - s, width)
                    if k:
                        h = rolling(w.hash[s:e], k).view(np.int64).tolist()
                        out += [(k, x, w.text(s + j, s + j + k), items[a + i]) for j, x in enumerate(h)]
                kinds = [pa.int32(), pa.int64(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["k", "hash", "words", "item"])

    item = F.coalesce(F.col("item_id").cast("string"), F.lit("null"))
    return bounded(benchmark).select(item.alias("item"), "text").mapInArrow(scan, "k int, hash long, words binary, item string").distinct()


class _Benchmark:
    """The windows of a benchmark: in the tasks of one scan where they are few, else as a table to join."""

    def __init__(self, benchmark: DataFrame, width: int, per_scan: int):
        spark = benchmark.sparkSession
        self.table = saved(benchmark_windows(benchmark, width), "benchmark-windows")
        first = self.table.limit(per_scan + 1).collect()
        self.small = len(first) <= per_scan
        if self.small:
            self.held = spark.sparkContext.broadcast(WindowSet(tuple(r) for r in first))
            return
        at = F.pmod("hash", F.lit(FILTER_BITS)) + 1
        bits = bytearray(FILTER_BITS // 8)
        for b, part in self.table.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at"))).collect():
            bits[(b - 1) * 4096 : b * 4096] = part
        widths = [r[0] for r in self.table.select("k").distinct().collect()]  # as many as `width` at most
        self.held = spark.sparkContext.broadcast((sorted(widths), bytes(bits)))


KEY = "__text_key"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of the text: rows of one doc_id and key have one verdict, whatever other rows share the doc_id."""
    return docs.withColumn(KEY, F.unhex(F.md5(F.col("text").cast("binary"))))


def _found(docs: DataFrame, bench: _Benchmark) -> tuple[DataFrame, DataFrame]:
    """By the joins: all rows as (doc_id, key, n_words), and the hit windows (doc_id, key, pos, k, hash, words) of each distinct one."""
    held = bench.held

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widths, bits = held.value
        bits = np.frombuffer(bits, np.uint8)
        kind = pa.list_(pa.struct([("k", pa.int32()), ("hash", pa.int64()), ("pos", pa.int32()), ("words", pa.binary())]))
        for batch in batches:
            for a, b, w in chunks(batch.column(2), ALNUM):
                spots: list[list[dict]] = [[] for _ in range(b - a)]
                for k in widths:
                    h, whole = w.windows(k)
                    at = (h.view(np.int64) % FILTER_BITS).astype(np.int64)
                    for i in np.flatnonzero(whole & (bits[at // 8] >> (at % 8).astype(np.uint8) & 1 == 1)).tolist():
                        row = int(np.searchsorted(w.first, i, "right")) - 1
                        spots[row].append({"k": k, "hash": int(h[i : i + 1].view(np.int64)[0]), "pos": i - int(w.first[row]), "words": w.text(i, i + k)})
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(np.diff(w.first), pa.int64()), pa.array(spots, kind)], names=["doc_id", KEY, "n_words", "spots"])

    slim = _keyed(bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", KEY, "text")
    rows = saved(slim.mapInArrow(scan, f"doc_id long, {KEY} binary, n_words long, spots array<struct<k:int,hash:long,pos:int,words:binary>>"), "decontamination-scan")
    once = rows.where(F.size("spots") > 0).groupBy("doc_id", KEY).agg(F.first("spots").alias("spots"))  # equal texts have equal spots
    spots = once.select("doc_id", KEY, F.explode("spots").alias("s")).select("doc_id", KEY, "s.*")
    windows = bench.table.select("k", "hash", "words").distinct()
    return rows.select("doc_id", KEY, "n_words"), saved(spots.join(windows, ["k", "hash", "words"]), "decontamination-hits")


def _same(x: DataFrame, y: DataFrame) -> Column:
    return x["doc_id"].cast("long").eqNullSafe(y["__hit_id"]) & x[KEY].eqNullSafe(y["__hit_key"])


def _hit_words(hits: DataFrame) -> DataFrame:
    """(hit_id, hit_key, hit): the numbers of the hit words of each text."""
    words = F.flatten(F.collect_set(F.sequence("pos", F.col("pos") + F.col("k") - 1)))
    return hits.groupBy(F.col("doc_id").alias("__hit_id"), F.col(KEY).alias("__hit_key")).agg(F.array_distinct(words).alias("__hit"))


def report(docs: DataFrame, benchmark: DataFrame, width: int = 13, per_scan: int = WINDOWS_PER_SCAN) -> DataFrame:
    """One row per document: words, words inside benchmark windows, items that occur, and the verdict.

    A word is a run of letters, digits and non-ASCII characters after lower-casing
    A-Z. A document is contaminated when it has hits and at least a twentieth of
    its words are hit. Up to `per_scan` windows are sent to all tasks as a hash set,
    and one scan decides without a shuffle. More are joined by hash with the windows
    of the documents that pass a filter of fixed size; the results are the same.
    Each row is judged by its own text: rows that share a doc_id or have none stay
    apart, repeated rows give repeated results. Null or empty text has no words and
    is clean; null items have no windows. Empty tables give empty or all-clean
    results. Other columns are ignored.
    """
    bench = _Benchmark(benchmark, width, per_scan)
    if not bench.small:
        return _joined_report(docs, bench)
    slim, held = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), bench.held

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, w in chunks(batch.column(1), ALNUM):
                _, n_words, n_hit, items, bad = _judge(w, held.value)
                names = [sorted(items.get(i, ())) for i in range(b - a)]
                sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
                yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array(sha, pa.string()), pa.array(bad)], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return slim.mapInArrow(scan, REPORT)


def _joined_report(docs: DataFrame, bench: _Benchmark) -> DataFrame:
    rows, hits = _found(docs, bench)
    held = hits.select("doc_id", KEY, "k", "hash", "words").distinct().join(bench.table, ["k", "hash", "words"]).select("doc_id", KEY, "item").distinct()
    items = held.groupBy(F.col("doc_id").alias("item_id"), F.col(KEY).alias("item_key")).agg(F.array_sort(F.collect_list("item")).alias("items"))
    words = _hit_words(hits).select("__hit_id", "__hit_key", F.size("__hit").cast("long").alias("n"))
    per = words.join(items, words["__hit_id"].eqNullSafe(items["item_id"]) & words["__hit_key"].eqNullSafe(items["item_key"]))
    out = rows.join(per.drop("item_id", "item_key"), _same(rows, per), "left")
    n_hit, items = F.coalesce("n", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def _without(column: pa.Array, a: int, b: int, w: Words, hit: np.ndarray) -> pa.Array:
    """Texts a to b of a column without their hit words."""
    keep = np.ones(len(w.raw), bool)
    for i in np.flatnonzero(hit).tolist():
        keep[w.start[i] : w.end[i]] = False
    texts = column[a:b].to_pylist()
    for i in np.unique(np.searchsorted(w.first, np.flatnonzero(hit), "right") - 1).tolist():
        s, e = w.offsets[i], w.offsets[i + 1]
        texts[i] = w.raw[s:e][keep[s:e]].tobytes().decode()
    return pa.array(texts, column.type)


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", width: int = 13, per_scan: int = WINDOWS_PER_SCAN) -> DataFrame:
    """docs with contaminated documents left out (mode "documents"), or with all hit words cut from the texts (mode "spans").

    Columns, their order and clean rows stay as they are; null and empty texts, and
    all rows of an empty benchmark, are clean. Each row is judged by its own text
    (see `report`), and words are cut once, from the original text, for any size of
    the benchmark; an empty table gives an empty one.
    """
    bench = _Benchmark(benchmark, width, per_scan)
    names, where = docs.columns, bounded(docs).columns.index("text")
    if not bench.small and mode == "documents":
        rows, hits = _found(docs, bench)
        words = _hit_words(hits)
        bad = rows.distinct().join(words, _same(rows, words)).where(20 * F.size("__hit") >= F.col("n_words")).select("__hit_id", "__hit_key")
        keyed = _keyed(docs)
        return keyed.join(bad, _same(keyed, bad), "left_anti").select(*names)
    if not bench.small:
        words = _hit_words(_found(docs, bench)[1])
        keyed = _keyed(docs)
        cut = keyed.join(words, _same(keyed, words), "left").select(*[keyed[c] for c in names], F.col("__hit"))

        def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spots = batch.column(len(names)).to_pylist()
                for a, b, w in chunks(batch.column(where), ALNUM):
                    hit = np.zeros(len(w.start), bool)
                    hit[[int(w.first[i]) + p for i in range(b - a) for p in spots[a + i] or ()]] = True
                    part = batch.slice(a, b - a).select(names)
                    yield part.set_column(where, part.schema.field(where), _without(batch.column(where), a, b, w, hit)) if hit.any() else part

        return cut.mapInArrow(cutting, docs.schema)
    held = bench.held

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in chunks(batch.column(where), ALNUM):
                hit, _, _, _, bad = _judge(w, held.value)
                part = batch.slice(a, b - a)
                if mode == "documents":
                    yield part.filter(pa.array(~bad))
                else:
                    yield part.set_column(where, part.schema.field(where), _without(batch.column(where), a, b, w, hit)) if hit.any() else part

    return docs.mapInArrow(scan, docs.schema)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
