"""Words, word hashes and windows of many texts at once, on the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text worked on at once; several temporary arrays hold 8 bytes for each of them, in each Python worker.
CHUNK = 1 << 19
#: Rows in an Arrow batch of texts, at most: batches of 10,000 long texts take too much of an executor's memory.
BATCH_ROWS = 2_000
#: Bytes in an Arrow batch, about; one longer text stands alone.
BATCH_BYTES = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORDBASE = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Fixed values of the two word definitions, as bytes after lower-casing A-Z.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session that hands at most BATCH_ROWS rows, and bytes where it sets no bound itself, at once to Python (settings stay, for plans are lazy)."""
    conf = df.sparkSession.conf
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(key, "10000"))
    if not 0 < now <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf.set(key, conf.get(key, str(BATCH_BYTES)))
    return df


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i up to n."""
    table = _powers.get(int(base))
    if table is None or len(table[0]) <= n:
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        table = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (base, inverse))
        if n <= 2 * CHUNK:
            _powers[int(base)] = table
    return table


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` values."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = _power_table(_WORDBASE, n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:n], dtype=np.uint64)])
    return mix((total[width:] - total[:-width]) * down[: n - width + 1] + np.uint64(width))


class Words:
    """Words of the texts of a chunk: byte spans, hashes, and where each text's words begin."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        data = LOWER[raw]
        self.data, self.raw, self.offsets = data, raw, offsets
        n = len(data)
        inside = table[data]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[offsets[:-1][offsets[:-1] < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = np.empty(len(self.start), np.uint64)
        a = 0
        while a < len(self.start):  # so many bytes at once, for a long text too; a hash does not depend on where its word stands
            first = self.start[a]
            b = max(a + 1, int(np.searchsorted(self.end, first + CHUNK, "right")))
            s, e = self.start[a:b] - first, self.end[a:b] - first
            up, down = _power_table(_BASE, int(e[-1]))
            total = np.zeros(e[-1] + 1, np.uint64)
            np.cumsum((data[first : first + e[-1]].astype(np.uint64) + np.uint64(1)) * up[: e[-1]], dtype=np.uint64, out=total[1:])
            self.hash[a:b] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
            a = b

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the window at each word, and whether it lies within one text."""
        h = rolling(self.hash, width)
        if not len(h):
            return h, np.zeros(0, bool)
        row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        return h, row[: len(h)] == row[width - 1 :]

    def text(self, a: int, b: int) -> bytes:
        """Words a to b, joined by a space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b], strict=True))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def chunks(column: pa.Array, table: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) of runs of rows of about `size` bytes; a longer text stands alone."""
    data, offsets = texts_of(column)
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], table)
        a = b
