"""Line dedup with a sharded minimal perfect hash.

The distinct line hashes of the corpus are dealt over shards. Each shard is a minimal perfect hash (levels
of bit arrays; a key's place is the rank of its bit) that indexes an array of fingerprints and an array
of document counts. Documents do not meet lines in a join: blocks of documents send the hashes that they
hold to the shards, which look them up in the arrays and answer with those to be dropped.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from parcelsight.llm.common import SPACE_BYTES, mix, stage

#: Documents of a block, line hashes of a shard (about), and shards at least.
BLOCK_ROWS, SHARD_KEYS, LEAST_SHARDS = 500, 200_000, 256
_SPACE = SPACE_BYTES.decode()
_NONE = b"\0" * 16  # stands for a line whose key is too short to count


def line_key(line: str) -> str:
    """Stripped of white space at both ends; upper-case ASCII letters are lowered."""
    key = line.strip(_SPACE)
    return key.lower() if key.isascii() else key.encode().lower().decode()


class PerfectHash:
    """A minimal perfect hash of distinct 128-bit keys with a fingerprint and a count for each."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """keys: n x 2 of uint64."""
        self.sizes, words, left = [], [], keys
        while len(left):
            size = (2 * len(left) + 63) // 64 * 64
            at = self._place(left, len(self.sizes), size)
            once = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(once, bitorder="little").view("<u8"))
            self.sizes.append(size)
            left = left[~once[at]]
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.fingerprints = np.zeros(len(keys), np.uint32)
        self.counts = np.zeros(len(keys), np.uint32)
        at = self.index(keys)
        self.fingerprints[at] = self._fingerprint(keys)
        self.counts[at] = np.minimum(counts, 0xFFFFFFFF)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64((2 * level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        return (mix(keys[:, 0] * seed + keys[:, 1]) % np.uint64(size)).astype(np.int64)

    @staticmethod
    def _fingerprint(keys: np.ndarray) -> np.ndarray:
        return (mix(keys[:, 1]) >> np.uint64(32)).astype(np.uint32)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1 for a key that no level holds."""
        out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = self._place(keys[left], level, size) + base
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (self.before[at >> 6] + below)[hit]
            left, base = left[~hit], base + size
        return out

    def count(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key; 0 where the fingerprint says that it is another key's."""
        at = self.index(keys)
        if not len(self.counts):
            return np.zeros(len(keys), np.int64)
        known = (at >= 0) & (self.fingerprints[at] == self._fingerprint(keys))
        return np.where(known, self.counts[at], 0).astype(np.int64)


def _keys(raw: bytes | list[bytes]) -> np.ndarray:
    return np.frombuffer(raw if isinstance(raw, bytes) else b"".join(raw), "<u8").reshape(-1, 2)


def _line_hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                hashes = []
                for text in part.column("text").to_pylist():
                    keys = map(line_key, (text or "").split("\n"))
                    hashes.append(b"".join(xxhash.xxh3_128_digest(k.encode()) if len(k) >= min_chars
                                           else _NONE for k in keys))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * part.num_rows, pa.int64()), part.column("doc_id"),
                     part.column("mark"), pa.array(hashes, pa.binary())],
                    names=["block", "doc_id", "mark", "hashes"])
                block += 1
    return run


def _distinct(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of some documents and in how many of them each is found."""
    sizes = [len(r) // 16 for r in raw]
    keys = _keys(raw)
    table = np.empty(len(keys), [("d", "<u4"), ("a", "<u8"), ("b", "<u8")])
    table["d"], table["a"], table["b"] = np.repeat(np.arange(len(raw)), sizes), keys[:, 0], keys[:, 1]
    table = np.unique(table[(table["a"] != 0) | (table["b"] != 0)])
    found, counts = np.unique(table[["a", "b"]], return_counts=True)
    return np.column_stack([found["a"], found["b"]]).astype(np.uint64), counts


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, counts = _distinct(batch.column("hashes").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[:, 0].astype(np.int64)), pa.array(keys[:, 1].astype(np.int64)),
             pa.array(counts.astype(np.int64))], names=["a", "b", "n"])


def _probe_rows(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            raw = batch.column("hashes").to_pylist()
            rows = []
            for block in np.unique(blocks):
                keys, _ = _distinct([raw[i] for i in np.flatnonzero(blocks == block)])
                shard = _shard_of(keys, shards)
                order = np.argsort(shard, kind="stable")
                keys, shard = keys[order], shard[order]
                cuts = np.flatnonzero(np.diff(shard, prepend=-1))
                rows += [(int(shard[a]), int(block), keys[a:b].astype("<u8").tobytes())
                         for a, b in zip(cuts, np.append(cuts, len(keys))[1:], strict=True)]
            yield pa.RecordBatch.from_pylist(
                [{"shard": s, "block": b, "hashes": h} for s, b, h in rows],
                schema=pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary())]))
    return run


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return np.mod(np.ascontiguousarray(keys[:, 0]).view(np.int64), shards)


def _build(shards: int):
    def run(group: pa.Table) -> pa.Table:
        keys = np.column_stack([group["a"].to_numpy(), group["b"].to_numpy()]).astype(np.int64).view(np.uint64)
        arrays = PerfectHash(keys, group["n"].to_numpy())
        return pa.table({"shard": [int(_shard_of(keys[:1], shards)[0])], "arrays": [pickle.dumps(arrays)]})
    return run


def _answer(min_docs: int):
    def run(probes: pa.Table, arrays: pa.Table) -> pa.Table:
        found: PerfectHash = pickle.loads(arrays["arrays"][0].as_py())
        blocks, hashes = [], []
        for block, raw in zip(probes["block"].to_pylist(), probes["hashes"].to_pylist(), strict=True):
            keys = _keys(raw)
            often = keys[found.count(keys) >= min_docs]
            if len(often):
                blocks.append(block)
                hashes.append(often.tobytes())
        return pa.table({"block": pa.array(blocks, pa.int64()), "often": pa.array(hashes, pa.binary())})
    return run


def _positions(lines: pa.Table, often: pa.Table) -> pa.Table:
    drop = {raw[i:i + 16] for raw in often["often"].to_pylist() for i in range(0, len(raw), 16)}
    rows = [(i, gone) for i, raw in enumerate(lines["hashes"].to_pylist())
            if any(gone := [raw[k:k + 16] in drop for k in range(0, len(raw), 16)])]
    kept = lines.select(["doc_id", "mark"]).take(pa.array([i for i, _ in rows], pa.int64()))
    return kept.append_column("gone", pa.array([g for _, g in rows], pa.list_(pa.bool_())))


def _mark() -> Column:
    return F.xxhash64("text")


def dropped_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(doc_id, mark, gone: for each line whether it is dropped) of the documents that lose any.

    mark is a hash of the text, so that rows which repeat an id with another text stay apart.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    lines = stage(docs.select("doc_id", "text", _mark().alias("mark"))
                  .mapInArrow(_line_hashes(min_chars),
                              f"block long, doc_id {kind}, mark long, hashes binary"), "line-hashes")
    total = lines.agg(F.sum(F.length("hashes") / 16)).first()[0] or 0
    shards = max(LEAST_SHARDS, int(total // SHARD_KEYS) + 1)
    counts = (lines.select("hashes").mapInArrow(_count_rows, "a long, b long, n long")
              .groupBy("a", "b").agg(F.sum("n").alias("n")))
    arrays = (counts.withColumn("shard", F.pmod("a", F.lit(shards)).cast("long"))
              .groupBy("shard").applyInArrow(_build(shards), "shard long, arrays binary"))
    probes = lines.select("block", "hashes").mapInArrow(
        _probe_rows(shards), "shard long, block long, hashes binary")
    often = (probes.groupBy("shard").cogroup(arrays.groupBy("shard"))
             .applyInArrow(_answer(min_docs), "block long, often binary"))
    return (lines.groupBy("block").cogroup(often.groupBy("block"))
            .applyInArrow(_positions, f"doc_id {kind}, mark long, gone array<boolean>")
            .dropDuplicates(["doc_id", "mark"]))


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Drop every line whose key is found in at least ``min_docs`` documents.

    A text is split at \\n; null and empty texts are one empty line. A line's key is the line stripped
    of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lowered; keys of fewer than ``min_chars`` code points stay.
    Each row is a document, also one that repeats another. Returns the columns of ``docs`` with the
    kept lines, joined by \\n, as text, then n_lines (before dropping) and n_dropped; columns of
    ``docs`` with these two names give way. An empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    drops = dropped_lines(docs, min_docs, min_chars).select(
        F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.col("gone").alias("__gone"))
    both = docs.select(*keep).join(
        drops, F.col("doc_id").eqNullSafe(F.col("__id")) & (_mark() == F.col("__mark")), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    gone = F.col("__gone")
    text = F.when(gone.isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.filter(lines, lambda _, i: ~F.get(gone, i)), "\n"))
    n_gone = F.size(F.filter(gone, lambda g: g))
    return both.select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in keep),
                       F.size(lines).cast("long").alias("n_lines"),
                       F.when(gone.isNull(), 0).otherwise(n_gone).cast("long").alias("n_dropped"))
