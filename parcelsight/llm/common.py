"""What the operators share: reading, staging and hashing words of Arrow text columns in bulk."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parcelsight.sources.sinks import release, stage, stage_at  # noqa: F401  in the shared checkpoint folder

#: The contracts' white space: \x20 and \x09 to \x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"
#: Text bytes that are worked on at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 19

_SPACES = np.zeros(256, bool)
_SPACES[list(SPACE_BYTES)] = True
#: For classifiers: all ASCII but letters and digits separates; bytes of other scripts are letters.
_MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def held_out(doc_id: Column | str) -> Column:
    """True for the fifth of the documents that no model learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    base, inverse = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 1)
            grown = []
            for b in (self.base, self.inverse):
                row = np.full(size, b, np.uint64)
                row[0] = 1
                grown.append(np.multiply.accumulate(row))
            self.up, self.down = grown
        return self.up[:n], self.down[:n]


_powers = _Powers()


def text_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets into them) for runs of rows of at most SLICE_BYTES.

    Nulls are empty texts. A row that is longer makes a run of its own.
    """
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, "right")) - 1)
        yield at, data[ends[at]:ends[to]], ends[at:to + 1] - ends[at]
        at = to


def word_hashes(data: np.ndarray, rows: np.ndarray, *, marks: bool = False,
                prefix: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lower-cased, row of each word), in text order.

    Words are runs without contract white space, or with ``marks`` runs of letters and digits.
    With ``prefix`` only so many first bytes of a word count.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~(_MARKS if marks else _SPACES)[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[rows] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    if prefix:
        ends = np.minimum(ends, starts + prefix)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD
    return mix(hashes), np.searchsorted(rows, starts, "right") - 1


def planes(values: np.ndarray) -> bytes:
    """Integers as byte planes, so that a general compressor sees the zeros of small values."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def give_back() -> None:
    """Return freed memory to the system, as Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


class Scratch:
    """Staged tables that are deleted once what was made of them is staged itself."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def stage(self, df: DataFrame, label: str) -> DataFrame:
        staged, path = stage_at(df, label)
        self.paths.append(path)
        return staged

    def release(self, but: int = 0) -> None:
        """Delete the tables, all but the last ``but``."""
        keep = len(self.paths) - but
        for path in self.paths[:keep]:
            release(self.spark, path)
        self.paths = self.paths[keep:]


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="parcelsight-code-")) / "parcelsight_code.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return spark
