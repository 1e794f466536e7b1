"""How the sources of a language differ in their words: exact divergences over a cube of tasks.

Terms are counted by (lang, source) in one pass. A task then owns a cell of the cube (block of groups,
block of groups, block of terms) of a language: it gets the slices of both blocks of groups that fall into its
block of terms, fills in the zeros, and sums the divergences of all its pairs of groups over its terms.
Partial sums are added along the term axis; the terms that a cell hasn't seen in any of its groups are added there
as one product, because they all give the same value. All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelsight.llm.common import Scratch

#: Documents of a language that hold a term at least, scale of the shares, ranks of a group's terms.
LEAST_DOCS, SCALE, TOP_TERMS = 3, 1_000_000_000, 200
#: Groups of a block, terms of a cell (about), counts that a task keeps before it sends them on, text bytes
#: that are cut into terms at once.
GROUP_BLOCK, CELL_TERMS, HELD_TERMS, PIECE_BYTES = 32, 4096, 500_000, 1 << 20

#: A term's bytes are letters, A-Z lowered, and all above ASCII; all others separate.
_FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_COUNTED = "lang string, source string, term string, n long, docs long"


def _pieces(text: str) -> Iterator[list[bytes]]:
    raw, at = text.encode().translate(_FOLD), 0
    while at < len(raw):
        to = raw.find(b" ", at + PIECE_BYTES)
        to = len(raw) if to < 0 else to
        yield raw[at:to].split()
        at = to


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group, and a row without a term for each group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in held.items():
            terms = list(times)
            n = len(terms) + 1
            column = pa.array([*terms, None], pa.binary()).cast(pa.string())
            full = [pa.array([lang], pa.string()).take(pa.array(np.zeros(n, np.int32))),
                    pa.array([source], pa.string()).take(pa.array(np.zeros(n, np.int32)))]
            yield pa.RecordBatch.from_arrays(
                [*full, column, pa.array([*times.values(), 0], pa.int64()),
                 pa.array([*(docs[t] for t in terms), 0], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    size = 0
    for batch in batches:
        for text, lang, source in zip(*(batch.column(c) for c in ("text", "lang", "source")), strict=True):
            times, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            before, seen = len(times), set()
            for words in _pieces(text.as_py()):
                times.update(words)
                seen.update(words)
            docs.update(seen)
            size += len(times) - before
            if size > HELD_TERMS:
                yield from flush()
                size = 0
    yield from flush()


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), by long division in three steps, so that nothing overflows."""
    rest, out = counts + 1, np.zeros(np.broadcast_shapes(counts.shape, totals.shape), np.int64)
    for _ in range(3):  # SCALE is 1000 ** 3
        out *= 1000
        rest = rest * 1000
        out += rest // totals
        rest = rest % totals
    return out + 1


_PARTIAL = "lang string, source string, item string, part long, seen long, unseen long, terms long"


def _cell(group: pa.Table) -> pa.Table:
    """Partial divergences of the ordered pairs of groups of two blocks over the terms that the cell has."""
    header = pc.is_null(group["term"])
    heads, rows = group.filter(header), group.filter(pc.invert(header))
    names = heads["source"].to_pylist()
    block = heads["block"].to_numpy()
    terms = int(heads["terms"][0].as_py())
    totals = (heads["n"].to_numpy() + terms)[:, None]
    i, j = (int(group[c][0].as_py()) for c in ("i", "j"))
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    seat = pc.index_in(rows["source"], pa.array(names, pa.string())).to_numpy()
    codes = rows["term"].combine_chunks().dictionary_encode()
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    term, n, width = codes.indices.to_numpy(), rows["n"].to_numpy(), len(codes.dictionary)
    order = np.argsort(term, kind="stable")
    term, seat, n = term[order], seat[order], n[order]
    value = np.zeros((len(names), len(names)), np.int64)
    for a in range(0, width, 1024):
        b, z = np.searchsorted(term, [a, a + 1024])
        counts = np.zeros((len(names), min(1024, width - a)), np.int64)
        counts[seat[b:z], term[b:z] - a] = n[b:z]
        p = shares(counts, totals)
        for x in left:
            others = right if i != j else left
            gap = p[others] - p[x]
            gap *= gap
            value[x, others] += (gap // p[others]).sum(1)
            if i != j:
                value[others, x] += (gap // p[x]).sum(1)
    base = shares(np.zeros_like(totals), totals).ravel() if terms else np.ones(len(names), np.int64)
    unseen = (base[:, None] - base[None, :]) ** 2 // base[None, :]
    pairs = [(x, y) for x in left for y in right if x != y]
    pairs += [(y, x) for x, y in pairs] if i != j else []
    x, y = np.array(pairs, np.int64).reshape(-1, 2).T
    text = lambda at: pa.array(names, pa.string()).take(pa.array(at))
    full = lambda v: np.full(len(x), v, np.int64)
    return pa.table({"lang": pa.array([group["lang"][0].as_py()] * len(x), pa.string()), "source": text(x),
                     "item": text(y), "part": value[x, y], "seen": full(width), "unseen": unseen[x, y],
                     "terms": full(terms)})


def share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / total) in whole numbers of any size."""
    big = (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", big, total.cast("decimal(20,0)")) + 1


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS,
                      group_block: int = GROUP_BLOCK, cell_terms: int = CELL_TERMS) -> DataFrame:
    """For each (lang, source): how far each other source of the lang is from it, and its most excessive terms.

    Takes (text, lang, source); other columns are not read, and nulls in the three count as ''. Terms are
    ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lowered; a lang keeps the V terms that ``least_docs`` of its rows hold.
    A group's share of a term is p = 1 + floor(10^9 (count + 1) / (N + V)) with N its occurrences of kept terms. Parts:
    ``pair``, an item for each other source with share q, the sum of floor((p - q)^2 / q) over all kept terms;
    ``term``, the kept terms of the group that exceed the lang's share q, their value, ``top`` at most. Returns lang, source,
    part, item, value, rank (value descending, item ascending by code point).
    Groups of empty texts occur too. Repeated rows are documents of their own. Very long texts are cut into terms
    piece by piece. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counted = scratch.stage(plain.mapInArrow(_count_terms, _COUNTED).groupBy("lang", "source", "term")
                            .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    by_lang = (counted.filter("term IS NOT NULL").groupBy("lang", "term")
               .agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs))
    kept = scratch.stage(by_lang.select("lang", "term", "lang_n"), "divergence-terms")
    entries = scratch.stage(counted.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "divergence-entries")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    sizes = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (counted.groupBy("lang", "source").agg(F.count("*").alias("rows")).drop("rows")
              .join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
              .fillna(0, ["total", "terms", "lang_total"]))
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / group_block).alias("blocks"))
    own = F.pmod(F.xxhash64("lang", "source"), F.col("blocks")).alias("block")
    cells = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("terms") / cell_terms)).alias("cells")
    groups = scratch.stage(groups.join(blocks, "lang").select("*", own, cells), "divergence-groups")

    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    corner = [F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j")]
    heads = (groups.withColumn("x", upto("blocks")).withColumn("k", upto("cells"))
             .select("lang", *corner, "k", "source", "block", F.lit(None).cast("string").alias("term"),
                     F.col("total").alias("n"), "terms"))
    slices = (entries.join(groups.select("lang", "source", "block", "blocks", "cells"), ["lang", "source"])
              .withColumn("k", F.pmod(F.xxhash64("term"), F.col("cells"))).withColumn("x", upto("blocks"))
              .select("lang", *corner, "k", "source", "block", "term", "n", F.lit(0).cast("long").alias("terms")))
    partial = heads.unionByName(slices).groupBy("lang", "i", "j", "k").applyInArrow(_cell, _PARTIAL)
    unseen = (F.max("terms") - F.sum("seen")) * F.max("unseen")
    pairs = (partial.groupBy("lang", "source", "item").agg((F.sum("part") + unseen).alias("value"))
             .select("lang", "source", F.lit("pair").alias("part"), "item", "value"))

    with_totals = entries.join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    p, q = share(F.col("n"), F.col("total") + F.col("terms")), share(F.col("lang_n"), F.col("lang_total") + F.col("terms"))
    excess = (with_totals.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
              .select("lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div q").alias("value")))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(excess).filter(F.col("rank") <= top))
