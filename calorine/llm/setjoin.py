"""Exact Jaccard join of word n-gram sets by set-relation skipping.

The join is exact for any order of the shingles that all sets share. Shingles are
ordered by a count sketch over all documents (fixed size), then by hash, and a set
is indexed under the prefix that any partner must touch. Two kinds of skipping
keep work near-linear where many sets are alike:

* Answers are derived, not recomputed: sets that agree exactly are one class, and
  sets that agree in a band of minima are verified against one leader first. A
  set so tied to a class inherits the answers of the class, so pairs inside it are
  never formed again. For pairs across classes the leaders are intersected once;
  the shingles by which two sets differ from their leaders bound the change of
  that intersection, which decides most pairs without their sets.
* Index lists are skipped by position: the entries of a list stand in blocks of
  one size, sorted by position, and of two blocks only the leading entries whose
  positions leave room for the overlap are paired. Blocks out of each other's
  size range, or all of one class, are passed over whole.

What bounds leave open is verified on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from calorine.functions.session import discard, partitions, saved
from calorine.llm.words import NON_SPACE, bounded, chunks, mix, rolling
from calorine.operators.graph import connected_components

WIDTH, NUM, DEN = 4, 85, 100
#: Counters of the count sketch (4 bytes each), slices it is summed in, bits of the id filter: all fixed.
SKETCH, SLICES, FILTER_BITS = 1 << 20, 16, 1 << 23
BANDS, ROWS = 6, 3
#: Pairs of blocks, or of entries, that are looked at at once.
STEP = 1 << 18


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, one without words none."""
    for a, b, w in chunks(column, NON_SPACE):
        h, _ = w.windows(width)
        first = w.first.tolist()
        for i in range(b - a):
            s, e = first[i], first[i + 1]
            x = np.sort(h[s : e - width + 1]) if e - s >= width else rolling(w.hash[s:e], e - s)[:1] if e > s else h[:0]
            if len(x) > 1:
                fresh = np.ones(len(x), bool)
                np.not_equal(x[1:], x[:-1], out=fresh[1:])
                x = x[fresh]
            yield x


def _signed(x) -> int:
    x = int(x)
    return x - (1 << 64) if x >= 1 << 63 else x


def _bands(x: np.ndarray) -> list[int]:
    """Hashes of groups of minima, one minimum for each equal range of the hash space (and the size class of tiny sets)."""
    n = BANDS * ROWS
    edges = (np.arange(n, dtype=np.uint64) * np.uint64((1 << 64) // n)).astype(np.uint64)
    at = np.searchsorted(x, edges)
    ends = np.append(at[1:], len(x))
    least = np.where(at < ends, x[np.minimum(at, len(x) - 1)], np.uint64(0)).reshape(BANDS, ROWS)
    code = mix(least[:, 0] * np.uint64(3) + least[:, 1] * np.uint64(5) + least[:, 2] * np.uint64(7) + np.arange(BANDS, dtype=np.uint64))
    return [_signed(c) for c in code[least.any(1)]]


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> int:
    """Shingles of a set of n, in the common order, of which every partner holds one of its own prefix."""
    return n - -(-n * num // den) + 1


def least_overlap(n: np.ndarray, m: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """Least intersection of linked sets of n and m: den * i >= num * (n + m - i)."""
    return -(-num * (n + m) // (num + den))


# ---------------------------------------------------------------- scans
def _first_scan(docs: DataFrame, width: int) -> DataFrame:
    """A row for each document (n, fingerprint, bands), and slices of each task's count sketch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.int32)
        for batch in batches:
            n, f, g, bands = [], [], [], []
            for x in shingle_sets(batch.column(1), width):
                n.append(len(x))
                f.append(_signed(x.sum(dtype=np.uint64)))
                g.append(_signed((x * (x >> np.uint64(31))).sum(dtype=np.uint64)))
                bands.append(_bands(x) if len(x) else [])
                np.add.at(counts, (x & np.uint64(SKETCH - 1)).astype(np.int64), 1)
            none = pa.nulls(len(n), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(f, pa.int64()), pa.array(g, pa.int64()), pa.array(bands, pa.list_(pa.int64())), none, pa.nulls(len(n), pa.binary())], names=names)
        if counts.any():
            blobs = [pa.compress(s.tobytes(), "zstd", asbytes=True) for s in counts.reshape(SLICES, -1)]
            none = pa.nulls(SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(SLICES, pa.list_(pa.int64())), pa.array(range(SLICES), pa.int32()), pa.array(blobs, pa.binary())], names=names)

    names = ["doc_id", "n", "f", "g", "bands", "slice", "blob"]
    return docs.mapInArrow(scan, "doc_id long, n long, f long, g long, bands array<long>, slice int, blob binary")


def _saturated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The sum of two counters, which stay at the greatest int32 rather than wrap."""
    return np.minimum(x.astype(np.int64) + y, np.iinfo(np.int32).max).astype(np.int32)


def _sketch(rows: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches: SKETCH counters, whatever the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(pa.decompress(blob.as_buffer(), SKETCH // SLICES * 4, codec="zstd"), np.int32)
                held[s] = _saturated(held[s], x) if s in held else x.copy()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True) for x in held.values()], pa.binary())], names=["slice", "blob"])

    slices = rows.where("slice is not null").select("slice", "blob").repartition(SLICES, "slice").mapInArrow(add, "slice int, blob binary").collect()
    out = np.zeros((SLICES, SKETCH // SLICES), np.int32)
    for s, blob in slices:
        out[s] = _saturated(out[s], np.frombuffer(pa.decompress(bytes(blob), SKETCH // SLICES * 4, codec="zstd"), np.int32))
    return out.reshape(-1)


def _filter_of(ids: DataFrame) -> bytearray:
    """A bit for each id's hash: of fixed size, so that a scan can pass most other documents over."""
    at = _bit()
    rows = ids.select(at.alias("at")).groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bits")).collect()
    out = bytearray(FILTER_BITS // 8)
    for b, bits in rows:
        out[(b - 1) * 4096 : b * 4096] = bits
    return out


def _bit() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, items) of the documents in ids: their sets as sorted 8-byte numbers."""
    wanted = docs.sparkSession.sparkContext.broadcast(bytes(_filter_of(ids)))
    placed = docs.select("doc_id", "text", _bit().alias("bit"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            bit = batch.column(2).to_numpy(zero_copy_only=False)
            part = batch.filter(pa.array(bits[bit // 8] >> (bit % 8).astype(np.uint8) & 1 == 1))
            if part.num_rows:
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in shingle_sets(part.column(1), width)], pa.binary())], names=["doc_id", "items"])

    return placed.mapInArrow(scan, "doc_id long, items binary")


def _overlaps(docs: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(a, b, p, q, i) for pairs (a, b): the sizes of both whole sets and of their intersection."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b"))).distinct()
    sets = _sets(docs, ids, width).join(ids, "doc_id", "left_semi").distinct()
    sets = saved(sets, "join-sets")
    both = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                found = []
                for x, y in zip(part.column(2), part.column(3), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    z = np.sort(np.concatenate([x, y]), kind="stable")
                    found.append((len(x), len(y), int((z[1:] == z[:-1]).sum())))
                p, q, i = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(v, pa.int64()) for v in (p, q, i))], names=["a", "b", "p", "q", "i"])

    out = saved(both.select("a", "b", "x", "y").mapInArrow(count, "a long, b long, p long, q long, i long"), "join-overlaps")
    discard(sets)
    return out


def _linked(overlaps: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (u, v) of the overlaps that link."""
    return overlaps.where(f"i > 0 and {den} * i >= {num} * (p + q - i)").select(F.col("a").alias("u"), F.col("b").alias("v"))


def _derived(pairs: DataFrame, ties: DataFrame, sizes: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Links among pairs (a, b) that leaders' answers give, and the pairs that they leave open.

    ties holds the overlaps of sets with leaders, sizes (doc_id, n) the documents of one set only. With x and w the
    leaders of a and b, the intersection of a and b is at least that of x and w less what a lacks of x and b of w, and at
    most that intersection and what a has beyond x and b beyond w. Leaders meet once for all pairs that they lead.
    """
    pairs = pairs.join(ties.select("a", "b"), ["a", "b"], "left_anti")  # answered already
    single = sizes.select(F.col("doc_id").alias("b"), F.col("n").alias("q"))
    led = ties.join(single, ["b", "q"], "left_semi").join(sizes.select(F.col("doc_id").alias("a"), F.col("n").alias("p")), ["a", "p"], "left_semi")
    nearest = led.groupBy("b").agg(F.min(F.struct((F.col("p") + F.col("q") - 2 * F.col("i")).alias("differ"), "a", "p", "q", "i")).alias("t"))
    leads = sizes.join(nearest.withColumnRenamed("b", "doc_id"), "doc_id", "left").select(
        "doc_id", "n", F.coalesce("t.a", "doc_id").alias("x"), F.coalesce("t.p", "n").alias("xn"),
        F.coalesce(F.expr("t.p - t.i"), F.lit(0)).alias("lacks"), F.coalesce(F.expr("t.q - t.i"), F.lit(0)).alias("beyond"),
    )
    side = lambda s: leads.select(F.col("doc_id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in leads.columns[1:]))
    sided = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    sided = saved(sided.withColumns({"x": F.expr("if(x_a is null or x_b is null, null, least(x_a, x_b))"), "w": F.expr("if(x_a is null or x_b is null, null, greatest(x_a, x_b))")}), "join-sided")
    asked = sided.where("x <> w").groupBy("x", "w").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("x").alias("a"), F.col("w").alias("b"))
    asked = saved(asked.join(ties.select("a", "b"), ["a", "b"], "left_anti"), "join-asked")
    known = ties.select("a", "b", "i")
    if not asked.isEmpty():
        known = known.union(_overlaps(docs, asked, width).select("a", "b", "i"))
    known = known.groupBy(F.col("a").alias("x"), F.col("b").alias("w")).agg(F.max("i").alias("i"), F.min("i").alias("least"))
    told = sided.join(known, ["x", "w"], "left").withColumn("i", F.expr("if(x = w, xn_a, if(i = least, i, null))"))
    low, high = F.expr("i - lacks_a - lacks_b"), F.expr("least(i + beyond_a + beyond_b, n_a, n_b)")
    links = lambda i: F.lit(den) * i >= F.lit(num) * (F.col("n_a") + F.col("n_b") - i)
    told = told.select("a", "b", F.when(links(low), F.lit(True)).when(~links(high), F.lit(False)).alias("linked"))
    told = saved(told, "join-told")
    discard(sided, asked)
    return told.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v")), told.where("linked is null").select("a", "b")


def _prefixes(docs: DataFrame, sketch: np.ndarray, width: int, num: int, den: int) -> DataFrame:
    """(doc_id, f, n, items): the set's prefix in the common order, rarest first; shingles known to be alone are left out."""
    held = docs.sparkSession.sparkContext.broadcast(sketch)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held.value
        for batch in batches:
            f, n, items, places = [], [], [], []
            for x in shingle_sets(batch.column(1), width):
                n.append(len(x))
                f.append(_signed(x.sum(dtype=np.uint64)))
                k = prefix_length(len(x), num, den) if len(x) else 0
                c = counts[(x & np.uint64(SKETCH - 1)).astype(np.int64)]
                if k < len(x):
                    cut = np.partition(c, k - 1)[k - 1]
                    near = np.flatnonzero(c <= cut)  # x is sorted by hash, so a stable sort by count completes the order
                else:
                    near = np.arange(len(x))
                order = near[np.argsort(c[near], kind="stable")][:k]
                shared = c[order] > 1
                items.append(x[order][shared].tobytes())
                places.append(np.flatnonzero(shared).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f, pa.int64()), pa.array(n, pa.int64()), pa.array(items, pa.binary()), pa.array(places, pa.binary())], names=["doc_id", "f", "n", "items", "places"])

    return docs.mapInArrow(scan, "doc_id long, f long, n long, items binary, places binary")


def _entries(prefixes: DataFrame) -> DataFrame:
    """Index entries: item, label, doc_id, n, pos."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                raw = b"".join(x.as_py() for x in part.column(3))
                places = b"".join(x.as_py() for x in part.column(4))
                items = np.frombuffer(raw, np.int64)
                if not len(items):
                    continue
                size = np.array([len(x.as_buffer()) // 8 for x in part.column(3)])
                each = lambda i: np.repeat(part.column(i).to_numpy(zero_copy_only=False), size)
                yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(each(1)), pa.array(each(0)), pa.array(each(2).astype(np.int32)), pa.array(np.frombuffer(places, "<i4"))], names=["item", "label", "doc_id", "n", "pos"])

    return prefixes.select("doc_id", "label", "n", "items", "places").mapInArrow(spread, "item long, label long, doc_id long, n int, pos int")


def _pieces(counts: np.ndarray, most: int = STEP) -> Iterator[tuple[int, int]]:
    """Runs of counts whose sum is at most `most`; a greater count stands alone."""
    ends = np.cumsum(counts)
    s = 0
    while s < len(counts):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + most, "right")))
        yield s, e
        s = e


def _ranges(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from first, so many as counts, of all ranges in a row; and the range of each."""
    k = np.repeat(np.arange(len(counts)), counts)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(counts) - counts, counts) + first[k]


def list_pairs(item: np.ndarray, n: np.ndarray, pos: np.ndarray, label: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries (as numbers i, j) of one list and of different classes that leave room for the overlap.

    Entries are sorted by item (which names the list), size and position. Equal sizes of a list are a block.
    """
    n = n.astype(np.int64)
    fresh = np.concatenate([[True], item[1:] != item[:-1]])
    heads = np.flatnonzero(fresh | np.concatenate([[True], n[1:] != n[:-1]]))
    length = np.diff(np.append(heads, len(n)))
    size, listed = n[heads], (np.cumsum(fresh) - 1)[heads] << 32
    low, high = np.minimum.reduceat(label, heads), np.maximum.reduceat(label, heads)
    at = (np.repeat(np.arange(len(heads)), length) << 32) + pos
    block = np.arange(len(heads))
    partners = np.searchsorted(listed + size, listed + size * den // num, "right") - block  # blocks from this one on, in its size range
    for s, e in _pieces(partners):
        g, h = _ranges(block[s:e], partners[s:e])
        g = g + s
        mixed = np.maximum(high[g], high[h]) != np.minimum(low[g], low[h])
        g, h = g[mixed], h[mixed]
        least = least_overlap(size[g], size[h], num, den)
        x = np.searchsorted(at, (g << 32) + size[g] - least, "right") - heads[g]  # leading entries with room
        y = np.searchsorted(at, (h << 32) + size[h] - least, "right") - heads[h]
        both = (x > 0) & (y > 0)
        g, h, x, y = g[both], h[both], x[both], y[both]
        for s2, e2 in _pieces(x):
            k, i = _ranges(heads[g[s2:e2]], x[s2:e2])
            k = k + s2
            own = g[k] == h[k]
            first = np.where(own, i + 1, heads[h[k]])
            count = heads[h[k]] + y[k] - first
            for s3, e3 in _pieces(count):
                r, j = _ranges(first[s3:e3], count[s3:e3])
                of = i[s3:e3][r]
                differ = label[of] != label[j]
                yield of[differ], j[differ]


def _candidates(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b) of different classes that the index leaves to be verified."""

    def process(x: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], x[0][1:] != x[0][:-1]]))
        mixed = np.minimum.reduceat(x[1], starts) != np.maximum.reduceat(x[1], starts)
        wanted = np.repeat(mixed, np.diff(np.append(starts, len(x[0]))))
        if not wanted.any():
            return
        item, label, doc, n, pos = (c[wanted] for c in x)
        for i, j in list_pairs(item, n, pos, label, num, den):
            a, b = np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])
            pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(new[0]):
                continue
            held.append(new)
            if new[0][0] == new[0][-1] == held[0][0][0] or sum(len(h[0]) for h in held) < STEP:
                continue  # one list goes on, or too little to be worth a pass
            whole = [np.concatenate(p) for p in zip(*held, strict=True)]
            cut = int(np.searchsorted(whole[0], whole[0][-1]))  # the last list may go on
            yield from process([c[:cut] for c in whole])
            held = [[c[cut:].copy() for c in whole]]
        if held:
            yield from process([np.concatenate(p) for p in zip(*held, strict=True)])

    parts = partitions(entries, 32 << 20)
    return entries.repartition(parts, "item").sortWithinPartitions("item", "n", "pos").mapInArrow(lists, "a long, b long").distinct()


# ---------------------------------------------------------------- the join
def join(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Sets are the distinct word `width`-grams of the lower-cased text (shorter texts
    are one gram; null, empty or wordless ones have none and link with nothing).
    Two documents link when den * intersection >= num * union; component_id is the
    least doc_id reachable by links. Rows with equal doc_ids are one node, each row
    keeping its own n_shingles; rows without a doc_id get no component and take no
    part. An empty table gives an empty result. Other columns are ignored.
    """
    slim = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = saved(_first_scan(slim, width), "join-scan")
    sketch = _sketch(rows)
    sized = rows.where("slice is null").select("doc_id", "n", "f", "g", "bands")
    known = sized.where("n > 0 and doc_id is not null")
    # Answers of equal sets: one class each, led by its least doc_id.
    classes = known.groupBy("n", "f", "g").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    classes = saved(classes, "join-classes")
    members = known.select("doc_id", "n", "f", "g").join(classes.select("n", "f", "g", "rep"), ["n", "f", "g"]).select("doc_id", "rep")
    # Answers of highly similar sets: each is verified against the leader of its band.
    bands = classes.select("rep", F.explode("bands").alias("band"))
    leaders = bands.groupBy("band").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("k")).where("k > 1")
    near = saved(bands.join(leaders, "band").where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "join-near")
    ties = _overlaps(slim, near, width)
    similar = _linked(ties, num, den)
    # A doc_id with several rows is one node.
    twice = members.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).join(classes.select(F.col("rep").alias("u")).distinct(), "u", "left_semi")
    tied = saved(connected_components(similar.union(twice)), "join-tied")
    labels = classes.join(tied.withColumnsRenamed({"node": "rep"}), "rep", "left").select(F.col("rep").alias("doc_id"), "f", F.coalesce("component", "rep").alias("label"))
    # All other pairs, across classes, by the index.
    prefixes = _prefixes(slim.where("doc_id is not null"), sketch, width, num, den).where("n > 0").join(labels, ["doc_id", "f"])
    pairs = saved(_candidates(_entries(prefixes), num, den), "join-pairs")
    single = classes.groupBy(F.col("rep").alias("doc_id")).agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("k")).where("k = 1").drop("k").join(twice.select(F.col("u").alias("doc_id")), "doc_id", "left_anti")
    told, left = _derived(pairs, ties, single, slim, width, num, den)
    more = _linked(_overlaps(slim, left, width), num, den)
    links = more.union(told).union(tied.where("node <> component").select("node", "component"))
    final = connected_components(links).withColumnsRenamed({"node": "rep"})
    least = members.join(final, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id")).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = sized.select("doc_id", F.col("n").alias("n_shingles")).join(least, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with only the least doc_id of each component (and rows without a doc_id); columns stay as they are.

    Of rows that share this doc_id all stay, for they are one document.
    """
    found = join(docs, width, num, den).where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(found, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
