"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

On a bounded sample, rotations of the centred vectors are learned whose signs lose least (iterative
quantisation), which gives balanced binary codes. A code is cut into substrings, one for each table; vectors that
agree in a substring meet there and are compared by their original components in double precision. So many
rotations are learned that a pair at the threshold misses all tables with a small chance only, which is
estimated on the sample. A pair counts in the first table where it meets. What leaves a task are counts of links and
links that span its components, never all pairs of a group.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parcelsight.llm.ann import usable
from parcelsight.llm.common import Scratch
from parcelsight.llm.components import connected_components

#: Least cosine of a link.
COSINE = 0.95
#: Rows of the sample that the rotations are learned from, rounds of learning, vectors of a bucket (about), chance
#: that a pair at the threshold is missed, most code bits of a rotation.
SAMPLE_ROWS, ROUNDS, BUCKET_ROWS, MISS, MOST_BITS = 4096, 30, 256, 1e-4, 64
#: Vectors of a bucket that meet at once; larger buckets go in pairs of blocks. Rows of a task (about).
BLOCK, TASK_ROWS = 1024, 50_000


def _units(vectors: np.ndarray) -> np.ndarray:
    big = np.abs(vectors).max(1, keepdims=True)  # no square overflows or vanishes
    vectors = vectors / big
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def learn_rotation(points: np.ndarray, bits: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """A projection to ``bits`` dimensions whose signs approximate the centred points best.

    The main directions of the points, turned: signs and the rotation that fits them are found in turn.
    """
    rng = np.random.default_rng(seed)
    _, _, main = np.linalg.svd(points.T @ points)
    main = main[:bits].T
    flat = points @ main
    turn = np.linalg.qr(rng.normal(size=(flat.shape[1], flat.shape[1])))[0]
    for _ in range(rounds):
        signs = np.where(flat @ turn >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(signs.T @ flat)
        turn = (u @ v).T
    return main @ turn


class Codes:
    """Learned rotations and the cutting of codes into substrings of ``width`` bits, one for each table."""

    def __init__(self, sample: np.ndarray, total: int, cosine: float = COSINE, miss: float = MISS,
                 bucket_rows: int = BUCKET_ROWS) -> None:
        points = _units(sample)
        self.centre = points.mean(0)
        self.width = min(max(4, math.ceil(math.log2(max(2, total) / bucket_rows))), 30)
        rng, dims = np.random.default_rng(11), points.shape[1]
        # partners at the threshold itself, in random directions
        noise = rng.normal(size=points.shape)
        noise -= np.einsum("ij,ij->i", noise, points)[:, None] * points
        partners = cosine * points + math.sqrt(1 - cosine * cosine) * _units(noise) if dims > 1 else points
        bits = min(dims, MOST_BITS)
        per_rotation = max(1, bits // self.width)
        apart, self.rotations, spare = np.ones(len(points), bool), [], 0
        while spare < 2 and len(self.rotations) < 64:  # one table group more than the sample asks for
            rotation = learn_rotation(points - self.centre, bits, len(self.rotations))
            if bits < self.width:
                extra = np.random.default_rng(99 + len(self.rotations)).normal(size=(dims, self.width - bits))
                rotation = np.concatenate([rotation, extra], 1)
            self.rotations.append(rotation[:, :per_rotation * self.width])
            a, b = (self._substrings(x, self.rotations[-1]) for x in (points, partners))
            apart &= (a != b).all(1)
            spare += apart.mean() <= miss

    def _substrings(self, points: np.ndarray, rotation: np.ndarray) -> np.ndarray:
        signs = ((points - self.centre) @ rotation >= 0).reshape(len(points), -1, self.width)
        return signs @ (1 << np.arange(self.width)).astype(np.int64)

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        """The substrings of each vector, a column for each table."""
        points = _units(vectors)
        return np.concatenate([self._substrings(points, r) for r in self.rotations], 1)

    @property
    def tables(self) -> int:
        return sum(r.shape[1] // self.width for r in self.rotations)


def _vectors(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) + 0.0  # one zero


def _coder(codes: Codes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _vectors(batch.column("embedding"))
            found = codes(vectors)
            digests = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in vectors]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()),
                                             pa.array(found.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(digests, pa.binary()), batch.column("embedding"), lists],
                names=["id", "same", "embedding", "codes"])
    return run


def _spanning(link: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of a symmetric link matrix."""
    open_, out = np.flatnonzero(link.any(1)), []
    left = np.zeros(len(link), bool)
    left[open_] = True
    for root in open_.tolist():
        if not left[root]:
            continue
        left[root] = False
        wave = np.array([root])
        while len(wave):
            reached = link[wave] & left
            new = np.flatnonzero(reached.any(0))
            out += zip(wave[reached[:, new].argmax(0)].tolist(), new.tolist(), strict=True)
            left[new] = False
            wave = new
    return out


_FOUND = "a long, b long, n long"


def _compare(cosine: float):
    """Of the units of a group: (a, null, n) the links that a has there, (a, b, null) links that span them."""
    def run(group: pa.Table) -> pa.Table:
        unit = np.stack([group[c].to_numpy() for c in ("table", "code", "i", "j")])
        order = np.lexsort(unit)
        unit = unit[:, order]
        cuts = np.flatnonzero(np.append(True, (unit[:, 1:] != unit[:, :-1]).any(0)))
        ids, weights, own = (group[c].to_numpy()[order] for c in ("rep", "m", "block"))
        embedding = group["embedding"].combine_chunks()
        coded = _vectors(group["codes"]).astype(np.int64)[order]
        a, b, n = [], [], []
        for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ids)], strict=True):
            if e - s < 2:
                continue
            table, _, i, j = unit[:, s]
            points = _units(_vectors(embedding.take(pa.array(order[s:e]))))
            link = points @ points.T >= cosine
            np.fill_diagonal(link, False)
            if i != j:  # blocks meet here, each block is compared with itself elsewhere
                link &= own[s:e, None] != own[None, s:e]
            if not link.any():
                continue
            known = np.zeros_like(link)
            for t in range(table):  # counted in an earlier table
                known |= coded[s:e, t, None] == coded[None, s:e, t]
            link &= ~known
            counts = link @ weights[s:e]
            some = np.flatnonzero(counts)
            a += ids[s:e][some].tolist()
            n += counts[some].tolist()
            b += [None] * len(some)
            pairs = _spanning(link)
            a += [int(ids[s + x]) for x, _ in pairs]
            b += [int(ids[s + y]) for _, y in pairs]
            n += [None] * len(pairs)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})
    return run


def vector_dedup(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """Links between vectors of cosine ``cosine`` or more, and their components.

    Takes (vec_id, embedding); returns vec_id, n_links (other rows linked directly), component_id (smallest vec_id
    reachable by links, itself included), kept (vec_id = component_id), a row for each input row. The rotations are
    learned on at most SAMPLE_ROWS rows, all rows are indexed. Links are tested on the vectors themselves, so
    that none is below the threshold; a pair at the threshold is missed with a chance of about MISS.
    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, nor do those
    of another length than the most frequent one (of several, the shortest). Equal vectors are one while
    joining, but each row counts; rows that repeat an id are rows of their own. A row without id links and counts, and is
    the last choice for a component's id. An empty table gives an empty result.
    """
    spark, none = vectors.sparkSession, 1 << 62
    scratch = Scratch(spark)
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(none)).alias("id"), "embedding")
    sizes = (rows.filter(usable(F.col("embedding"))).groupBy(F.size("embedding").alias("d"))
             .agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect())
    fit = usable(F.col("embedding")) & (F.size("embedding") == (sizes[0]["d"] if sizes else -1))
    alone = rows.filter(~F.coalesce(fit, F.lit(False))).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    found = alone
    if sizes:
        points = rows.filter(fit)
        sample = points.orderBy(F.xxhash64("id", "embedding")).limit(SAMPLE_ROWS).toArrow()
        codes = Codes(_vectors(sample["embedding"]), sizes[0]["n"], cosine)
        kind = points.schema["embedding"].dataType.simpleString()
        coded = scratch.stage(points.mapInArrow(_coder(codes), f"id long, same binary, embedding {kind}, codes array<int>"),
                              "vectors-coded")
        classes = scratch.stage(coded.groupBy("same").agg(
            F.min("id").alias("rep"), F.count("*").alias("m"), F.first("embedding").alias("embedding"),
            F.first("codes").alias("codes")), "vectors-distinct")
        spread = F.posexplode("codes").alias("table", "code")
        buckets = classes.select(spread).groupBy("table", "code").agg(F.count("*").alias("n")).filter("n > 1")
        large = buckets.select("table", "code", F.ceil(F.col("n") / block).alias("blocks"))
        placed = (classes.select("rep", "m", "embedding", "codes", spread).join(large, ["table", "code"])
                  .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
                  .withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
                  .select("rep", "m", "embedding", "codes", F.col("table").cast("long").alias("table"),
                          F.col("code").cast("long").alias("code"), "block",
                          F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j")))
        total = buckets.agg(F.sum(F.col("n") * F.ceil(F.col("n") / block))).first()[0] or 0
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // TASK_ROWS))
        group = F.pmod(F.xxhash64("table", "code", "i", "j"), F.lit(tasks)).alias("g")
        links = scratch.stage(placed.select("*", group).groupBy("g").applyInArrow(_compare(cosine), _FOUND), "vectors-links")
        counts = links.filter("n IS NOT NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("linked"))
        labels = connected_components(links.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("id", "rep")
        named = (classes.select("same", "rep", "m").join(counts, "rep", "left").join(labels, "rep", "left")
                 .select("same", (F.coalesce("linked", F.lit(0)) + F.col("m") - 1).alias("n_links"),
                         F.coalesce("component", "rep").alias("component")))
        found = alone.unionByName(coded.select("id", "same").join(named, "same").drop("same"))
    id_, component = (F.nullif(F.col(c), F.lit(none)) for c in ("id", "component"))
    return found.select(id_.alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), component.alias("component_id"),
                        id_.eqNullSafe(component).alias("kept"))
