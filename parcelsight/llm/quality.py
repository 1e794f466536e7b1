"""Quality by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled texts. What resembles
good text gets smaller with the first one. The difference of the two compressed sizes for each byte of the
text is turned into a probability by a piecewise linear logistic calibration on labelled rows that built no
dictionary. Nothing else enters the score. A text is compressed slice by slice, all of it: in one piece a long text
would soon be matched with itself and no longer with the dictionaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from parcelsight.llm.classify import apply_logistic, fit_logistic, sample_ids
from parcelsight.llm.common import held_out

#: Labelled rows of each class, at most (about): for the dictionaries and for the calibration.
DICTIONARY_ROWS, CALIBRATION_ROWS = 1500, 4000
DICTIONARY_BYTES, LEVEL = 110_000, 3
#: Bytes of a text that are compressed at once.
SLICE = 1024
#: Shares of the calibration rows below the differences at which the calibration may bend.
BENDS = (0.1, 0.25, 0.5, 0.75, 0.9)


@dataclass(frozen=True)
class Compressor:
    """Dictionaries of either class, the calibration and where it bends; without a calibration the score is constant."""

    good: bytes
    bad: bytes
    calibration: tuple | None
    bends: tuple[float, ...]
    base: float

    def gaps(self, texts: list[bytes]) -> np.ndarray:
        """Bytes that the good dictionary saves against the bad one, for each byte of a text; 0 for an empty text."""
        sizes = [np.zeros(len(texts)), np.zeros(len(texts))]
        for size, words in zip(sizes, (self.good, self.bad), strict=True):
            coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words))
            for i, t in enumerate(texts):
                size[i] = sum(len(coder.compress(t[at:at + SLICE])) for at in range(0, len(t), SLICE))
        return (sizes[1] - sizes[0]) / np.maximum([len(t) for t in texts], 1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.calibration is None:
            return np.full(len(texts), self.base)
        return apply_logistic(self.calibration, _bent(self.gaps(texts), self.bends))


def _bent(gaps: np.ndarray, bends: tuple[float, ...]) -> np.ndarray:
    """The columns of a piecewise linear function of the gap."""
    return np.column_stack([gaps, *(np.maximum(gaps - b, 0) for b in bends)])


def _dictionary(texts: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few texts to find a pattern in: they are the dictionary themselves
        out, room = [], DICTIONARY_BYTES
        for left, text in zip(range(len(texts), 0, -1), sorted(texts, key=len), strict=True):
            out.append(text[:room // left])  # an equal part of each that is longer than its share of what is left
            room -= len(out[-1])
        return b"".join(out)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", dictionary_rows: int = DICTIONARY_ROWS,
        calibration_rows: int = CALIBRATION_ROWS) -> Compressor:
    """Dictionaries and calibration from two separate bounded samples of rows that are not held out.

    Without rows of both classes the score is a constant.
    """
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0
    marked = labels.filter(half)
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    rows = sample_ids(docs, marked, label, dictionary_rows).filter(F.length("text") > 0)
    for r in sorted(rows.collect(), key=lambda r: (r["doc_id"], r["text"])):
        texts[r["label"]].append(r["text"].encode())
    seen = sum(map(len, texts.values()))
    if not all(texts.values()):
        return Compressor(b"", b"", None, (), (len(texts[1]) + 1) / (seen + 2))
    first = Compressor(_dictionary(texts[1]), _dictionary(texts[0]), None, (), 0.5)
    sizes = {r["k"]: r["n"] for r in labels.filter(~held_out("doc_id")).filter(F.col(label).isin(0, 1))
             .groupBy(F.col(label).alias("k")).agg(F.count("*").alias("n")).collect()}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = first.gaps([t.encode() for t in batch.column("text").fill_null("").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.float64())],
                                             names=["doc_id", "label", "gap"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    other = sample_ids(docs, labels.filter(~half), label, calibration_rows)
    found = sorted(other.mapInArrow(measure, f"doc_id {kind}, label int, gap double").collect(),
                   key=lambda r: (r["doc_id"], r["gap"]))
    y = np.array([r["label"] for r in found], float)
    if len(set(y)) < 2:
        return Compressor(b"", b"", None, (), (len(texts[1]) + 1) / (seen + 2))
    # either class counts as much as it does among all labelled rows
    weight = np.where(y == 1, sizes[1] / y.sum(), sizes[0] / (1 - y).sum())
    gaps = np.array([r["gap"] for r in found])
    bends = tuple(np.unique(np.quantile(gaps, BENDS)).tolist())
    return Compressor(first.good, first.bad, fit_logistic(_bent(gaps, bends), y, weight), bends, 0.5)


def score_quality(docs: DataFrame, model: Compressor, threshold: float = 0.3) -> DataFrame:
    """The columns of ``docs``, then score (0 to 1) and predicted (1 from ``threshold`` on).

    Every whole text is compressed, also null and empty ones (an empty text). Columns of ``docs`` named
    score or predicted give way. Rows are independent.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES
    keep = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.scores([(t or "").encode() for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(score, pa.float64()),
                 pa.array((score >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep]
    return docs.select(*keep).mapInArrow(run, ", ".join([*kinds, "score double", "predicted int"]))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Fit on labelled rows that are not held out, score all rows: doc_id, held_out, score, predicted."""
    scored = score_quality(docs.select("doc_id", "text"), fit(docs, labels), threshold)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
