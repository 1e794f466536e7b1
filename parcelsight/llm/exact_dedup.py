"""Exact dedup by content sort.

Sampled splitters range-partition the normalised texts, Spark's external sort places equal texts
next to each other, and neighbours are compared in full. A run of equal texts that crosses a
splitter is put together again from one summary for each partition that it touches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from parcelsight.llm.common import SPACE_CLASS, stage

#: Bytes of a text that a splitter holds; a hash of the text and the id stand behind them, so that
#: one very frequent text is dealt over as many partitions as its rows need.
SPLITTER_CHARS = 48

_RUNS = ("doc_id long, text_sha256 string, part long, run long, open boolean, n_points long, "
         "best_points long, best_id long, run_size long")


def _runs(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition with the run of equal texts each is in.

    Only ids and digests of the current run are held, never its texts. The first and the last run of a
    partition are open: they may go on in the partition beside it.
    """
    names = [c.split()[0] for c in _RUNS.split(", ")]
    run, last, held = 0, None, []

    def close(is_open: bool) -> pa.RecordBatch:
        ids, sha, points = (pa.concat_arrays(column) for column in zip(*held, strict=True))
        same = lambda v, kind: pa.array([v] * len(ids), kind)
        return pa.RecordBatch.from_arrays(
            [ids, sha, same(part, pa.int64()), same(run, pa.int64()), same(is_open, pa.bool_()), points,
             same(points[0].as_py(), pa.int64()), same(ids[0].as_py(), pa.int64()),
             same(len(ids), pa.int64())], names=names)

    for batch in batches:
        ids, norm, sha, points = (batch.column(n) for n in ("doc_id", "norm", "text_sha256", "n_points"))
        if not len(norm):
            continue
        new = np.ones(len(norm), bool)
        new[0] = last is None or norm[0].as_py() != last
        new[1:] = pc.not_equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False)
        last = norm[len(norm) - 1].as_py()
        cuts = np.flatnonzero(new)
        lo, hi = (cuts[0], cuts[-1]) if len(cuts) else (len(norm), len(norm))
        if lo > 0:
            held.append((ids[:lo], sha[:lo], points[:lo]))
        if not len(cuts):
            continue
        if held:
            yield close(run == 0)
            run += 1
        if hi > lo:  # runs that begin and end inside this batch
            sizes = np.diff(cuts)
            number = np.repeat(np.arange(run, run + len(sizes)), sizes)
            first = pa.array(np.repeat(cuts[:-1], sizes))
            yield pa.RecordBatch.from_arrays(
                [ids[lo:hi], sha[lo:hi], pa.array(np.full(hi - lo, part)), pa.array(number),
                 pa.array(number == 0), points[lo:hi], points.take(first), ids.take(first),
                 pa.array(np.repeat(sizes, sizes))], names=names)
            run += len(sizes)
        held = [(ids[hi:], sha[hi:], points[hi:])]
    if held:
        yield close(True)


def exact_dedup(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Groups of texts that are equal after deleting all white space of ``[\\x20\\x09-\\x0D]``.

    Takes (doc_id, text); other columns are not read. Returns one row for each input row: doc_id,
    keep_id, group_size, kept, text_sha256. A null text is an empty one. In a group the row with the
    most code points in its original text stays, then the smallest doc_id (a null id comes last).
    Repeated rows with one id count as members and are kept or dropped together. An empty table gives
    an empty result.
    """
    from pyspark import TaskContext

    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = docs.select("doc_id", F.regexp_replace(text, SPACE_CLASS + "+", "").alias("norm"),
                       F.char_length(text).cast("long").alias("n_points"))
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = [F.substring("norm", 1, SPLITTER_CHARS), F.xxhash64("norm")]
    ordered = (norm.repartitionByRange(n, *keys, F.xxhash64("doc_id"))
               .sortWithinPartitions(*keys, "norm", F.desc("n_points"),
                                     F.col("doc_id").asc_nulls_last())
               .select("doc_id", "norm", "n_points", F.sha2("norm", 256).alias("text_sha256")))
    rows = stage(ordered.mapInArrow(
        lambda batches: _runs(TaskContext.get().partitionId(), batches), _RUNS), "content-runs")
    # at most two open runs a partition: their summaries meet by digest
    pieces = (rows.filter("open").groupBy("text_sha256", "part", "run")
              .agg(F.first("run_size").alias("size"),
                   F.first(F.struct((-F.col("best_points")).alias("p"),
                                    F.col("best_id").isNull().alias("none"),
                                    F.col("best_id").alias("id"))).alias("best")))
    whole = pieces.groupBy("text_sha256").agg(F.sum("size").alias("all_size"),
                                              F.min("best").alias("best"))
    kept_id = F.when(F.col("open"), F.col("best.id")).otherwise(F.col("best_id"))
    closed = rows.filter("not open").select("doc_id", "text_sha256", F.col("best_id").alias("keep_id"),
                                            F.col("run_size").alias("group_size"))
    merged = (rows.filter("open").join(whole, "text_sha256")
              .select("doc_id", "text_sha256", kept_id.alias("keep_id"),
                      F.col("all_size").alias("group_size")))
    return closed.unionByName(merged).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256")
