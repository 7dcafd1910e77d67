"""Token ids in files: frequency-ranked ids, byte-aligned variable-length codes, separate control bytes."""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from calorine.functions.session import partitions, saved, scratch_root
from calorine.llm.words import CHUNK, bounded, mix, texts_of

#: Ids in one block of the files, about.
BLOCK_IDS = 1 << 20
END_ID = 2
_LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


# ---------------------------------------------------------------- coding
def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes (2 bits an id: bytes less one, lowest bits first) and data bytes (little-endian, no padding)."""
    r = np.asarray(ranks, np.uint32)
    size = 1 + (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    codes = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    codes[: len(r)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    wide = int(size.max(initial=1))
    wide += wide == 3
    kind = {1: "<u1", 2: "<u2", 4: "<u4"}[wide]
    data = r.astype(kind).view(np.uint8).reshape(-1, wide)[np.arange(wide, dtype=np.uint8) < size[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks again: lengths by table lookup of each control byte, then gathers at their running sums."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(size) - size
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.uint32)
    out = raw[at]
    for k in (1, 2, 3):
        long = np.flatnonzero(size > k)
        if not len(long):
            break
        out[long] |= raw[at[long] + k] << np.uint32(8 * k)
    return out


# ---------------------------------------------------------------- tokenizing
#: Classes of bytes for splitting: white space 0, letters 1, digits 2, other 3; 9 leaves a text to the library.
_SPLIT = np.full(256, 9, np.uint8)
_SPLIT[0x21:0x7F] = 3
_SPLIT[[0x20, 0x09, 0x0A, 0x0D]] = 0
_SPLIT[0x30:0x3A] = 2
_SPLIT[0x41:0x5B] = _SPLIT[0x61:0x7B] = 1
_SPLIT[0x80:0xC0] = _SPLIT[[0xC3, 0xC4, 0xC5]] = 1  # with what may follow them, Latin letters; see _odd
_SPLIT[0x27] = 9
#: Slots of each half of the cache (24 bytes each), ids it holds, and bytes of the pre-tokens that it is keyed by.
#: Corpora of many rare words meet most of them again, but far apart, so the cache is as large as a worker may afford.
CACHE_BITS, POOL_IDS, KEY_BYTES = 19, 1 << 23, 16
#: Pre-tokens that go through the library as one text.
JOINED = 500
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _odd(raw: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Bytes that the fast split does not know: other lead bytes, apostrophes, control bytes, the two signs among Latin letters."""
    odd = c == 9
    after = np.zeros(len(raw), bool)
    after[1:] = raw[:-1] == 0xC3
    return odd | (after & ((raw == 0x97) | (raw == 0xB7)))


def pretoken_starts(raw: np.ndarray, c: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pre-tokens of the byte-level pattern start, for texts of known classes and without contractions.

    A run of one class is a pre-token and takes one space before it along. Of white
    space before it, the last character stands alone unless it is that space; what
    comes before that, and white space that ends a text, is one pre-token.
    """
    n = len(raw)
    mark = np.zeros(n + 1, bool)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    turn = np.ones(n, bool)
    turn[1:] = c[1:] != c[:-1]
    turn |= edge[:n]
    at = np.flatnonzero(turn)
    ends = np.append(at[1:], n)
    blank = c[at] == 0
    words = at[~blank]
    glued = np.zeros(len(words), bool)
    inner = words > 0
    glued[inner] = (raw[words[inner] - 1] == 0x20) & ~edge[words[inner]]
    mark[words[~glued]] = True
    mark[words[glued] - 1] = True
    a, b = at[blank], ends[blank]
    closing = edge[b]
    mark[a[closing | (b - a > 1)]] = True
    mark[b[~closing] - 1] = True
    return np.flatnonzero(mark[:n])


def packed(raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first KEY_BYTES bytes of pre-tokens as two numbers each; none holds a zero byte, so equal numbers are equal bytes."""
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(KEY_BYTES, np.uint8)]), 8)
    low, high = (np.ascontiguousarray(view[starts + k]).view("<u8").reshape(-1) for k in (0, 8))
    return low & _MASKS[np.minimum(size, 8)], high & _MASKS[np.clip(size - 8, 0, 8)]


def pieces(data: np.ndarray, size: int) -> list[int]:
    """Where a long text may be parted: at a single space between two ASCII characters, where a pre-token always starts."""
    plain = (data > 0x20) & (data < 0x7F)
    may = np.flatnonzero((data[1:-1] == 0x20) & plain[:-2] & plain[2:]) + 1
    cuts = [0]
    while len(data) - cuts[-1] > size:
        at = int(np.searchsorted(may, cuts[-1] + size))
        if at == len(may):
            break
        cuts.append(int(may[at]))
    return [*cuts, len(data)]


class Encoder:
    """Ids of the tokenizers library, with a cache by pre-token where pre-tokens are known to be independent.

    A byte-level BPE without a normalizer encodes each pre-token alone. Texts of
    ASCII and Latin letters without apostrophes are split here, many at once, and
    only pre-tokens that the cache does not hold go through the library. The cache
    has a fixed size and is keyed by the bytes themselves. Any other text, texts that
    hold special tokens, and other kinds of tokenizers are passed to the library
    whole; texts of more than CHUNK bytes are encoded in pieces where that is safe.
    """

    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The worker's encoder, kept from task to task."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism here; threads would each keep memory
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        model = spec.get("model") or {}
        self.special = [x["content"].encode() for x in spec.get("added_tokens") or []]
        self.fast = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("truncation") and model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
        self.kind = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        line = self.library.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if self.fast and len(line) == 1 and not any(b"\n" in s for s in self.special) else None
        self.forget()

    def forget(self) -> None:
        n = 1 << CACHE_BITS
        self.low, self.high = np.zeros((2, n), np.uint64), np.zeros((2, n), np.uint64)
        self.at, self.size = np.zeros((2, n), np.int32), np.zeros((2, n), np.int32)
        self.long: dict[bytes, tuple[int, int]] = {}
        self.pool = np.zeros(POOL_IDS, self.kind)
        self.used = 0

    def whole(self, texts: list[str], at_once: int = 4096) -> list[np.ndarray]:
        out = []
        for i in range(0, len(texts), at_once):
            out += [np.array(e.ids, self.kind) for e in self.library.encode_batch_fast(texts[i : i + at_once], add_special_tokens=False)]
        return out

    def apart(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pre-tokens, and how many each has.

        All but white space go through the library many at once, each closed by a line feed: between
        them that is a pre-token of its own, and no other holds it.
        """
        size = np.zeros(len(words), np.int64)
        plain = np.array([self.line is not None and not w.isspace() for w in words], bool)
        which, others = np.flatnonzero(plain), np.flatnonzero(~plain)
        lines = [b"\n".join([*(words[i] for i in which[a : a + JOINED].tolist()), b""]).decode() for a in range(0, len(which), JOINED)]
        ids = np.concatenate([*self.whole(lines, 16), np.zeros(0, self.kind)])
        ends = np.flatnonzero(ids == self.line) if len(which) else which
        size[which] = np.diff(ends, prepend=-1) - 1
        rest = self.whole([words[i].decode() for i in others.tolist()])
        size[others] = [len(x) for x in rest]
        if not len(others):
            return ids[ids != self.line], size
        flat = np.zeros(int(size.sum()), self.kind)
        of = np.repeat(plain, size)
        flat[of] = ids[ids != self.line]
        flat[~of] = np.concatenate(rest)
        return flat, size

    def _slots(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(low + mix(high + np.uint64(1)))
        return (h >> np.uint64(64 - CACHE_BITS)).astype(np.int64), (h & np.uint64((1 << CACHE_BITS) - 1)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, size, known) of pre-tokens in the cache."""
        one, two = self._slots(low, high)
        first = (self.low[0][one] == low) & (self.high[0][one] == high)
        second = (self.low[1][two] == low) & (self.high[1][two] == high)
        return np.where(first, self.at[0][one], self.at[1][two]).astype(np.int64), np.where(first, self.size[0][one], self.size[1][two]).astype(np.int64), first | second

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Puts the ids of pre-tokens into the pool: (place, size)."""
        flat, size = self.apart(words)
        place = self.used + np.cumsum(size) - size
        if len(flat):
            self.pool[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
        return place, size

    def _ids(self, raw: np.ndarray, text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, size) in the pool of the ids of all pre-tokens."""
        length = ends - starts
        low, high = packed(raw, starts, length)
        long = length > KEY_BYTES
        place, size, known = self._find(low, high)
        known &= ~long
        spans = list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))
        fresh = dict.fromkeys(w for s, e in spans if (w := text[s:e]) not in self.long)
        miss = np.flatnonzero(~known & ~long)
        order = miss[np.lexsort((low[miss], high[miss]))]
        new = np.ones(len(order), bool)
        new[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
        need = int(length[order[new]].sum()) + sum(map(len, fresh))  # an id takes a byte at least
        if self.used and self.used + need > len(self.pool):
            self.forget()  # nothing that this chunk has found may move, so all is found anew
            return self._ids(raw, text, starts, ends)
        if need > len(self.pool):
            self.pool = np.zeros(need, self.kind)
        if len(order):
            first = order[new]
            at, n = self._learn([text[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
            which = np.cumsum(new) - 1
            place[order], size[order] = at[which], n[which]
            one, two = self._slots(low[first], high[first])
            free = self.low[0][one] == 0
            for k, slot, put in ((0, one, free), (1, two, ~free)):
                self.low[k][slot[put]], self.high[k][slot[put]] = low[first][put], high[first][put]
                self.at[k][slot[put]], self.size[k][slot[put]] = at[put], n[put]
        if fresh:
            self.long |= dict(zip(fresh, zip(*(x.tolist() for x in self._learn(list(fresh))), strict=True), strict=True))
        if spans:
            place[long], size[long] = np.array([self.long[text[s:e]] for s, e in spans], np.int64).T
        return place, size

    def chunk(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a chunk of bytes."""
        n = len(offsets) - 1
        if not self.fast:
            return self.whole([raw[offsets[i] : offsets[i + 1]].tobytes().decode() for i in range(n)])
        c = _SPLIT[raw]
        odd = np.zeros(n, bool)
        odd[np.searchsorted(offsets, np.flatnonzero(_odd(raw, c)), "right") - 1] = True
        text = raw.tobytes()
        for s in self.special:
            at = text.find(s)
            while at >= 0:
                odd[int(np.searchsorted(offsets, at, "right")) - 1] = True
                at = text.find(s, at + 1)
        starts = pretoken_starts(raw, c, offsets)
        ends = np.append(starts[1:], len(raw))
        of = np.searchsorted(starts, offsets)
        if odd.any():
            keep = ~np.repeat(odd, np.diff(of))
            kept = np.concatenate([[0], np.cumsum(keep)])
            starts, ends, of = starts[keep], ends[keep], kept[of]
        place, size = self._ids(raw, text, starts, ends)
        upto = np.concatenate([[0], np.cumsum(size)])
        flat = self.pool[np.repeat(place - upto[:-1], size) + np.arange(upto[-1])]
        cut = upto[of]
        out = [flat[cut[i] : cut[i + 1]] for i in range(n)]
        which = np.flatnonzero(odd).tolist()
        for i, ids in zip(which, self.whole([text[offsets[i] : offsets[i + 1]].decode() for i in which]), strict=True):
            out[i] = ids
        return out

    def __call__(self, column: pa.Array) -> Iterator[list[np.ndarray]]:
        """Ids of the texts of a column, chunk by chunk."""
        data, offsets = texts_of(column)
        a, n = 0, len(offsets) - 1
        while a < n:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
            raw = data[offsets[a] : offsets[b]]
            if self.fast and len(raw) > CHUNK and not any(raw.tobytes().find(s) >= 0 for s in self.special):
                cuts = pieces(raw, CHUNK)
                yield [np.concatenate([self.chunk(raw[s:e], np.array([0, e - s]))[0] for s, e in zip(cuts, cuts[1:], strict=False)])]
            else:
                yield self.chunk(raw, offsets[a : b + 1] - offsets[a])
            a = b


# ---------------------------------------------------------------- writing
def write(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> str:
    """Write the token files of docs(doc_id, text) in ascending doc_id order; returns their folder.

    Null text is empty; each document ends with `end_id`. Null doc_ids come first;
    rows with equal doc_ids follow one another in an order that their ids decide.
    One scan tokenizes and counts ids (stored compactly in the shared folder); ids
    are then ranked by frequency over all documents, the documents are dealt by
    range of doc_id, and each task writes its blocks. The folder holds `ranks`
    (id by rank) and `blocks` (part, block, doc_ids, known, n_tokens, n_before, n_block, control,
    data), where n_before counts the ids of earlier blocks of the part.
    """
    spark = docs.sparkSession
    slim = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of(tokenizer_path)
        tail = np.array([end_id], encode.kind)
        counts = np.zeros(max(encode.library.get_vocab_size(), end_id + 1), np.int64)
        names = ["doc_id", "n", "ids", "id", "count"]
        for batch in batches:
            a = 0
            for found in encode(batch.column(1)):
                runs = [np.append(x, tail) for x in found]
                counts += np.bincount(np.concatenate(runs), minlength=len(counts))
                packed = [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in runs]
                none = pa.nulls(len(runs), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a : a + len(runs)], pa.array([len(x) for x in runs], pa.int64()), pa.array(packed, pa.binary()), none, none], names=names)
                a += len(runs)
        seen = np.flatnonzero(counts)
        none = pa.nulls(len(seen), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(seen), pa.binary()), pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], names=names)

    rows = saved(slim.mapInArrow(tokenize, "doc_id long, n long, ids binary, id long, count long"), "token-ids", "none")
    # At most one row for each id of the vocabulary.
    ranked = [r[0] for r in rows.where("id is not null").groupBy("id").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "id").select("id").collect()]
    folder = f"{scratch_root(spark)}/tokens-{uuid.uuid4().hex}"
    spark.createDataFrame(pd.DataFrame({"rank": np.arange(len(ranked), dtype=np.int64), "id": np.array(ranked, np.int64)}), "rank long, id long").coalesce(1).write.parquet(f"{folder}/ranks")
    top = max([*ranked, 0])
    rank_of = np.zeros(top + 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked))
    wide = 2 if top < 1 << 16 else 4

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, before, ids, ns, parts, held = TaskContext.get().partitionId(), 0, 0, [], [], [], 0
        kind = np.dtype(f"<u{wide}")

        def out() -> pa.RecordBatch:
            control, data = encode_ranks(np.concatenate(parts))
            id_array = np.array([-1 if x is None else x for x in ids], "<i8")
            known = np.packbits([x is not None for x in ids]).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([id_array.tobytes()]), pa.array([known]), pa.array([np.array(ns, "<i8").tobytes()]), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([control]), pa.array([data])], names=["part", "block", "doc_ids", "known", "n_tokens", "n_before", "n_block", "control", "data"])

        for batch in batches:
            for doc, n, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = np.frombuffer(pa.decompress(packed.as_buffer(), n * codec_width, codec="zstd"), codec_kind)
                ids.append(doc)
                ns.append(n)
                parts.append(rank_of[raw])
                held += n
                if held >= block_ids:
                    yield out()
                    block, before, ids, ns, parts, held = block + 1, before + held, [], [], [], 0
        if ids:
            yield out()

    from tokenizers import Tokenizer

    codec_width = 2 if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else 4
    codec_kind = np.dtype(f"<u{codec_width}")
    dealt = rows.where("id is null").select("doc_id", "n", "ids").repartitionByRange(partitions(docs), "doc_id").sortWithinPartitions("doc_id", "n", "ids")
    dealt.mapInArrow(blocks, "part int, block int, doc_ids binary, known binary, n_tokens binary, n_before long, n_block long, control binary, data binary").write.option("compression", "zstd").parquet(f"{folder}/blocks")
    return folder


# ---------------------------------------------------------------- reading
def read(spark: SparkSession, folder: str, texts_of_ids=None) -> DataFrame:
    """One row per document of the token files: doc_id, start, n_tokens, ids_crc32.

    `start` counts the ids of all documents before it: the sums of earlier parts
    (one number a part), of earlier blocks of its own part (in the block) and of
    earlier documents of its block. Blocks are decoded where they are read.
    With `texts_of_ids`, a function of an id array, a column `text` is added.
    """
    table = np.array([r[0] for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").select("id").collect()] or [0], np.uint32)
    files = spark.read.parquet(f"{folder}/blocks")
    sizes = files.groupBy("part").agg(F.sum("n_block").alias("n")).orderBy("part").collect()
    before, total = {}, 0
    for r in sizes:
        before[r[0]] = total
        total += r[1]
    placed = files.select("part", "doc_ids", "known", "n_tokens", "n_before", "n_block", "control", "data")
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["text"] * bool(texts_of_ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = table[decode_ranks(r["control"], r["data"], r["n_block"])]
                ns = np.frombuffer(r["n_tokens"], "<i8")
                ends = np.cumsum(ns)
                docs = np.frombuffer(r["doc_ids"], "<i8")
                known = np.unpackbits(np.frombuffer(r["known"], np.uint8))[: len(docs)].astype(bool)
                runs = [ids[e - n : e] for e, n in zip(ends.tolist(), ns.tolist(), strict=True)]
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in runs]
                columns = [pa.array(docs, pa.int64(), mask=~known), pa.array(before[r["part"]] + r["n_before"] + ends - ns, pa.int64()), pa.array(ns, pa.int64()), pa.array(crc, pa.int64())]
                if texts_of_ids:
                    columns.append(pa.array([texts_of_ids(x) for x in runs], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", text string" * bool(texts_of_ids))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, write(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer()))
