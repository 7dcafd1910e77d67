"""Quality classifier: document evidence shrunk toward path, host and global rates by hierarchical empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from calorine.functions.session import saved
from calorine.llm.words import CHUNK, NON_SPACE, Words, bounded, texts_of

#: Labelled rows that the document classifier is fitted on, at most (those of least hash).
TRAIN_ROWS = 20_000
#: Sites whose rates are sent to all tasks as a literal table; more are joined by key.
BROADCAST_SITES = 10_000
THRESHOLD = 0.5
#: Buckets of hashed words: shares of a text's words, by square root.
BUCKETS = 64
FEATURES = ["upper", "digit", "space", "other", "pipe", "hash", "dollar", "percent", "amp", "star", "bang", "comma_stop", "quote", "word_length", "line_length", "distinct", "log_words", *[f"word_{i}" for i in range(BUCKETS)]]
_CLASS = np.full(256, 3, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 13
_CLASS[0x80:] = 13
_CLASS[65:91] = 0
_CLASS[48:58] = 1
_CLASS[[32, 9, 10, 11, 12, 13]] = 2
for _i, _chars in enumerate(("|", "#", "$", "%", "&", "*", "!", ",.", "\"'`")):
    _CLASS[[ord(c) for c in _chars]] = 4 + _i


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text: shares of character classes, word and line lengths, variety, size, hashed words. Empty: zeros."""
    data, offsets = texts_of(column)
    out, a, n = [np.zeros((0, len(FEATURES)))], 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
        raw, offs = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        size = np.diff(offs)
        row = np.repeat(np.arange(b - a), size)
        counts = np.bincount(row * 14 + _CLASS[raw], minlength=(b - a) * 14).reshape(-1, 14)[:, :13]
        lines = np.bincount(row[raw == 10], minlength=b - a) + 1
        w = Words(raw, offs, NON_SPACE)
        words = np.diff(w.first)
        wrow = np.repeat(np.arange(b - a), words)
        order = np.lexsort((w.hash, wrow))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (wrow[order][1:] != wrow[order][:-1])
        distinct = np.bincount(wrow[order][fresh], minlength=b - a)
        one = np.maximum(words, 1)
        hashed = np.bincount(wrow * BUCKETS + (w.hash >> np.uint64(58)).astype(np.int64), minlength=(b - a) * BUCKETS).reshape(-1, BUCKETS)
        x = np.column_stack([counts / np.maximum(size, 1)[:, None], np.minimum(size / one, 30) / 10, np.log1p(size / lines) / 5, distinct / np.sqrt(one) / 10, np.log1p(words) / 10, np.sqrt(hashed / one[:, None])])
        x[size == 0] = 0
        out.append(x)
        a = b
    return np.concatenate(out)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Logistic regression by Newton steps on standardised features: (mean, scale, weights with the constant last, log odds of y)."""
    if not len(x) or y.min() == y.max():  # nothing to tell apart: no evidence
        rate = (y.sum() + 1) / (len(y) + 2)
        return np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.append(np.zeros(len(FEATURES)), np.log(rate / (1 - rate))), float(np.log(rate / (1 - rate)))
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.append(np.full(len(FEATURES), ridge * len(x)), 1e-9)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    rate = (y.sum() + 0.5) / (len(y) + 1)
    return mean, scale, w, float(np.log(rate / (1 - rate)))


def evidence(x: np.ndarray, model) -> np.ndarray:
    """Log likelihood ratio of each row: the classifier's log odds less those of its training rows."""
    mean, scale, w, base = model
    return np.clip(((x - mean) / scale) @ w[:-1] + w[-1], -30, 30) - base


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS):
    """The document classifier, from at most `rows` labelled ids: those of the least hash. Of clashing labels of an id the lower counts."""
    bounded(docs)
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").cast("double").alias("label"))
    least = known.orderBy(F.xxhash64("label_id"), "label_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(least), F.col("doc_id") == F.col("label_id"))  # at most `rows` rows

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(features(batch.column(1))), pa.list_(pa.float64())), batch.column(2)], names=["label_id", "x", "label"])

    # Repeated documents of a labelled id are cut to the same bound, in an order of their own.
    found = texts.select("label_id", "text", "label").mapInArrow(rows_of, "label_id long, x array<double>, label double").orderBy(F.xxhash64("label_id"), "label_id", "x").limit(2 * rows).toPandas()
    x = np.array(found["x"].tolist()).reshape(-1, len(FEATURES))
    return fit(x, found["label"].to_numpy(float))


def url_host(url: Column) -> Column:
    """The host of a URL, in small letters; null where there is none. For tables with URLs, as the host of `score`."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def url_path(url: Column) -> Column:
    """The first part of a URL's path, as the path of `score`."""
    return F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "^/([^/]*)", 1)


def slim_scores(docs: DataFrame, model, host: Column, path: Column) -> DataFrame:
    """(doc_id, host, path, llr), without the texts."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            llr = evidence(features(batch.column(3)), model)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(llr, pa.float64())], names=["doc_id", "host", "path", "llr"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), "text").mapInArrow(score, "doc_id long, host string, path string, llr double")


def _strength(groups: DataFrame, mean: Column) -> float:
    """Prior strength (pseudo-documents) by moments: what the means of groups vary beyond the variation within them.

    groups: s (sum of probabilities), q (sum of their squares), n, over a parent's mean; one row is collected.
    """
    dev = F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)
    within = F.sum(F.col("q") - F.pow("s", F.lit(2)) / F.col("n"))
    r = groups.agg(F.count(F.lit(1)), F.sum("n"), F.sum(dev), within, F.sum(F.pow(F.col("n").cast("double"), F.lit(2))), F.sum("s")).first()
    k, n, between, inside, squares, s = (float(v or 0) for v in r)
    if k < 2 or n <= k:
        return 100.0
    noise = inside / (n - k)
    spread = (between - (k - 1) * noise) / (n - squares / n)
    rate = min(max(s / n, 1e-6), 1 - 1e-6)
    return float(np.clip(rate * (1 - rate) / max(spread, 1e-9) - 1, 1.0, 1e6))


def own_rate(model) -> Column:
    """A document's probability by its evidence and the labels' rate alone."""
    return 1 / (1 + F.exp(-(F.col("llr") + F.lit(float(model[3])))))


def site_sums(scores: DataFrame, model) -> tuple[DataFrame, float, tuple[float, float]]:
    """(host, path, site_n, site_s, host_n, host_s) of all sites; the global rate; the strengths of the host and path priors.

    Sums of document probabilities are grouped by host and path with map-side
    combine; the strengths come from all groups.
    """
    p = own_rate(model)
    paths = saved(scores.withColumn("p", p).groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")), "site-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    n, s = hosts.agg(F.sum("n"), F.sum("s")).first()
    rate = float(min(max((s or 0.0) / n, 1e-6), 1 - 1e-6)) if n else 0.5
    k_host = _strength(hosts, F.lit(rate))
    parents = hosts.select(F.col("host").alias("parent"), F.col("n").alias("host_n"), F.col("s").alias("host_s"), ((F.col("s") + k_host * rate) / (F.col("n") + k_host)).alias("host_rate"))
    # Groups, not documents, meet their hosts here.
    with_host = paths.join(parents, F.col("host").eqNullSafe(F.col("parent"))).drop("parent")
    k_path = _strength(with_host, F.col("host_rate"))
    return with_host.select("host", "path", F.col("n").alias("site_n"), F.col("s").alias("site_s"), "host_n", "host_s"), rate, (k_host, k_path)


def _judged(rows: DataFrame, scores: DataFrame, model, host: Column, path: Column) -> DataFrame:
    """rows(llr) with site_rate and p_quality.

    A host's rate is shrunk toward the global one, a path's toward its host's, so
    sparse sites lean on their parent. A document's own probability is left out of
    both sums before they judge it. Sites are broadcast below a checked number,
    else joined by key, which AQE splits where a site is hot.
    """
    sites, rate, (k_host, k_path) = site_sums(scores, model)
    sites = sites.withColumnsRenamed({"host": "site_host", "path": "site_path"})
    first = sites.limit(BROADCAST_SITES + 1).collect()
    if len(first) <= BROADCAST_SITES:
        sites = F.broadcast(rows.sparkSession.createDataFrame([tuple(r) for r in first], sites.schema))
    joined = rows.join(sites, host.eqNullSafe(F.col("site_host")) & path.eqNullSafe(F.col("site_path")), "left")
    p = own_rate(model)
    of_host = (F.col("host_s") - p + k_host * rate) / (F.col("host_n") - 1 + k_host)
    of_site = (F.col("site_s") - p + k_path * of_host) / (F.col("site_n") - 1 + k_path)
    judged = joined.withColumn("site_rate", F.least(F.greatest(of_site, F.lit(1e-6)), F.lit(1 - 1e-6))).drop(*sites.columns)
    return judged.withColumn("p_quality", 1 / (1 + F.exp(-(F.col("llr") + F.log(F.col("site_rate") / (1 - F.col("site_rate")))))))


def score(docs: DataFrame, labels: DataFrame, host: str | Column = "source", path: str | Column = "lang", threshold: float = THRESHOLD, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, host, path, llr, site_rate, p_quality, keep.

    host and path are columns of docs, such as `url_host` and `url_path` of a URL. A null
    host or path is a site like any other. Null and empty texts have all-zero
    features and are judged by them; repeated rows are scored alike. Without labels
    of both kinds there is no document evidence and sites keep the labels' rate. An
    empty table gives an empty result. Other columns are ignored.
    """
    model = train(docs, labels, rows)
    host, path = (F.col(c) if isinstance(c, str) else c for c in (host, path))
    scores = saved(slim_scores(docs, model, host, path), "quality-scores")
    return _judged(scores, scores, model, F.col("host"), F.col("path")).withColumn("keep", F.col("p_quality") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD, rows: int = TRAIN_ROWS) -> DataFrame:
    """docs without the documents that `score` rejects; columns and other rows stay as they are.

    Nulls, empty texts, repeated rows, missing labels and empty tables are as in `score`;
    columns of any other name go along. The texts are scanned once more with the fitted
    rates at hand, so that no text is shuffled (beyond BROADCAST_SITES sites, texts are joined with their site's sums by key).
    """
    model = train(docs, labels, rows)
    scores = saved(slim_scores(docs, model, F.col(host), F.col(path)), "quality-scores")
    named = docs.withColumnsRenamed({c: f"__docs_{c}" for c in docs.columns})
    where = docs.columns.index("text")
    schema = T.StructType([*named.schema.fields, T.StructField("llr", T.DoubleType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            llr = pa.array(evidence(features(batch.column(where)), model), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, llr], names=[*batch.schema.names, "llr"])

    judged = _judged(named.mapInArrow(add, schema), scores, model, F.col(f"__docs_{host}").cast("string"), F.col(f"__docs_{path}").cast("string"))
    return judged.where(F.col("p_quality") >= threshold).select(*[F.col(f"__docs_{c}").alias(c) for c in docs.columns])


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
