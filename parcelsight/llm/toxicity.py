"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms: words and word beginnings, hashed into a fixed number of bins. The
machine has a weight and a vector for each bin that a fitted text has; products of vectors learn pairs
of terms that are toxic only together, which additive weights cannot. No bin is left out for what it says
alone, as a term of such a pair may say nothing alone.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parcelsight.llm.classify import sample_ids
from parcelsight.llm.common import held_out, stage, text_slices, word_hashes

#: Bins of the term hash, and bytes of a word's beginning.
BINS, BEGINNING = 1 << 20, 5
#: Labelled rows of each class that the machine is fitted on, at most (about).
FIT_ROWS = 8000
FACTORS, EPOCHS, BATCH, RATE, RIDGE, SPREAD = 8, 30, 256, 0.02, 1e-4, 0.02
#: The steps of a bin that n texts have are (n / (n + RARE))^2 times as long: rare terms name single texts.
RARE = 50
#: Rows that are scored at once.
SCORE_ROWS = 512


@dataclass(frozen=True)
class Machine:
    """slot: the parameter row of each bin, -1 for bins that no fitted text has."""

    slot: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, rows: np.ndarray, slots: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of n texts from their distinct (row, slot) pairs."""
        total = np.full(n, self.bias) + np.bincount(rows, self.weights[slots], n)
        for k in range(self.factors.shape[1]):
            v = self.factors[slots, k]
            total += 0.5 * (np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def term_bins(column: pa.Array, slot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bin) pairs of the texts' terms; with ``slot`` only bins that have one."""
    rows, bins = [], []
    for at, data, offsets in text_slices(column):
        for salt, beginning in ((0, 0), (1, BEGINNING)):
            hashes, row = word_hashes(data, offsets, marks=True, prefix=beginning)
            got = ((hashes >> np.uint64(salt)) % np.uint64(BINS)).astype(np.int64)
            if slot is not None:
                got = slot[got]
                row, got = row[got >= 0], got[got >= 0]
            pairs = np.unique((row + at) * BINS + got)
            rows.append(pairs // BINS)
            bins.append(pairs % BINS)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.concatenate(rows) * BINS + np.concatenate(bins))
    return pairs // BINS, pairs % BINS


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, bins = term_bins(batch.column("text"))
        cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        bins = bins.astype("<i4")
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array([bins[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
            names=["label", "bins"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = FIT_ROWS,
        seed: int = 7) -> Machine:
    """A machine from at most about ``per_class`` labelled rows of either class, none held out.

    Without rows of both classes the machine has no terms, and its score is a constant below one half.
    """
    fitted = stage(sample_ids(docs, labels, label, per_class).select("label", "text")
                   .mapInArrow(_fit_rows, "label int, bins binary"), "toxicity-fit")
    slot = np.full(BINS, -1, np.int32)
    # the terms lie in a file of the driver, a partition at a time in its memory
    with tempfile.TemporaryFile() as file:
        marks, sizes, digests = [], [], []
        for r in fitted.toLocalIterator():
            file.write(r["bins"])
            marks.append(r["label"])
            sizes.append(len(r["bins"]) // 4)
            digests.append(hashlib.sha256(r["bins"]).digest())
        file.flush()
        y, ends = np.array(marks, float), np.cumsum(sizes, dtype=np.int64)
        pos, neg = int(y.sum()), int((1 - y).sum())
        if not pos or not neg or not ends[-1]:
            base = float(np.log((pos + 0.5) / (neg + 1.5))) if neg else -1.0
            return Machine(slot, base, np.zeros(1), np.zeros((1, FACTORS)))
        bins = np.memmap(file, "<i4", "r")
        often = np.zeros(BINS, np.int64)
        for at in range(0, len(bins), BINS):
            often += np.bincount(bins[at:at + BINS], minlength=BINS)
        seen = np.flatnonzero(often)
        slot[seen] = np.arange(len(seen))
        # in an order that doesn't depend on partitions
        order = sorted(range(len(y)), key=lambda i: (marks[i], digests[i]))
        texts = [bins[ends[i] - sizes[i]:ends[i]] for i in order]
        return _train(slot, texts, y[order], often[seen], np.random.default_rng(seed))


def _train(slot: np.ndarray, texts: list[np.ndarray], y: np.ndarray, often: np.ndarray, rng) -> Machine:
    """Adam on the logistic loss; a step touches only the parameters of the bins in its texts.

    texts: the distinct bins of each; often: how many texts have the bin of each parameter row.
    """
    bias, b1, b2 = 0.0, 0.0, 0.0
    reach = ((often / (often + RARE)) ** 2).astype(np.float32)[:, None]
    # a row is the vector of a bin, then its weight
    params = np.zeros((len(often), FACTORS + 1), np.float32)
    params[:, :FACTORS] = rng.standard_normal((len(often), FACTORS), np.float32) * SPREAD
    params *= reach
    first, second, t = np.zeros_like(params), np.zeros_like(params), 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        rate = RATE * 0.9 ** (epoch / 3)
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            size = np.array([len(texts[i]) for i in pick])
            row, s = np.repeat(np.arange(len(pick)), size), slot[np.concatenate([texts[i] for i in pick])]
            p, full = params[s], np.flatnonzero(size)
            sums = np.zeros((len(pick), FACTORS + 1), np.float32)
            squares = np.zeros(len(pick), np.float32)
            if len(full):
                starts = (np.cumsum(size) - size)[full]
                sums[full] = np.add.reduceat(p, starts)
                squares[full] = np.add.reduceat((p[:, :FACTORS] ** 2).sum(1), starts)
            z = bias + sums[:, FACTORS] + 0.5 * ((sums[:, :FACTORS] ** 2).sum(1) - squares)
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)).astype(np.float32)
            t += 1
            step, unbias = np.float32(rate / (1 - 0.9 ** t)), np.float32(1 / (1 - 0.999 ** t))
            total = float(g.sum())
            b1 += 0.1 * (total - b1)
            b2 += 0.001 * (total * total - b2)
            bias -= float(step) * b1 / ((b2 * float(unbias)) ** 0.5 + 1e-8)
            if not len(full):
                continue
            by_slot = np.argsort(s, kind="stable")
            touched, starts = np.unique(s[by_slot], return_index=True)
            pull = np.column_stack([g[:, None] * sums[:, :FACTORS], g])
            grad, old = np.add.reduceat(pull[row[by_slot]], starts), params[touched]
            grad[:, :FACTORS] -= old[:, :FACTORS] * grad[:, FACTORS:]
            grad += RIDGE * old
            m1, m2 = first[touched], second[touched]
            m1 += 0.1 * (grad - m1)
            m2 += 0.001 * (grad * grad - m2)
            first[touched], second[touched] = m1, m2
            params[touched] = old - reach[touched] * step * m1 / (np.sqrt(m2 * unbias) + 1e-8)
    return Machine(slot, bias, params[:, FACTORS].copy(), params[:, :FACTORS].copy())


def score_toxicity(docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """The columns of ``docs``, then score (0 to 1) and predicted (1 from ``threshold`` on).

    Every whole text is scored, also null and empty ones, which have no terms and get the machine's
    base score. Columns of ``docs`` named score or predicted give way. Rows are independent.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # at most BINS rows of parameters
    keep = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for at in range(0, batch.num_rows, SCORE_ROWS):
                part = batch.column("text").slice(at, SCORE_ROWS)
                score[at:at + len(part)] = m.scores(*term_bins(part, m.slot), len(part))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(score),
                 pa.array((score >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep]
    return docs.select(*keep).mapInArrow(run, ", ".join([*kinds, "score double", "predicted int"]))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Fit on labelled rows that are not held out, score all rows: doc_id, held_out, score, predicted."""
    scored = score_toxicity(docs.select("doc_id", "text"), fit(docs, labels), threshold)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
