"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is cut into blocks by a hash. A source's share is a number of block units (whole passes over
its blocks, then blocks of one more pass, the last of them in part). The unit quotas of all sources
are the root of a binary tree over the output shards; each node hands its left half a draw without
replacement from its quotas. So every shard gets a random mix, and all quotas are kept exactly. The
units of a source are numbered in permuted order, shards take disjoint ranges of them and order their
documents by a hash. All of it is DataFrame expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelsight.llm.common import WORD_CLASS, stage

#: Blocks that a source is cut into, and the weights of the sources, in turn.
SOURCE_BLOCKS = 1024
WEIGHTS = (3, 1, 2)
#: All targets together as a share of all sizes, and the most that a source or document is repeated.
TOTAL_SHARE, MOST_TIMES = 1.5, 2
#: Levels of the splitting tree: two to this power is the number of output shards. There are so many that a shard
#: has about SHARD_WORDS words, but no fewer than the first and no more than the second number.
SHARD_WORDS, LEVELS = 50_000_000, (6, 16)


@dataclass(frozen=True)
class Mix:
    """sized: the input rows with source_key, block, size; sources: targets; units: drawn blocks."""

    sized: DataFrame
    sources: DataFrame
    units: DataFrame
    taken: DataFrame


def _key(source: Column) -> Column:
    """A source's name that tells a null from any text."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def _uniform(*parts: Column | int) -> Column:
    """A number in (0, 1) from a hash of the parts."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return (F.pmod(F.xxhash64(*columns), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE,
                   most: int = MOST_TIMES) -> DataFrame:
    """(source_key, rank, source_size, target) of each source.

    Targets are the weights times one level, but at most ``most`` times the source's size; the level
    is the one at which they add up to the wanted share. Sources are few, one row each after the
    aggregation, so that they are ranked together.
    """
    per = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source_key") == "-", "source_key")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = (per.withColumn("rank", F.row_number().over(by_name) - 1)
              .withColumn("weight", weight.cast("double"))
              .withColumn("most", F.col("source_size") * float(most)))
    everyone = Window.partitionBy()
    by_room = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    order = by_room.rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(everyone) * share
              - F.coalesce(F.sum("most").over(order), F.lit(0.0)))
             / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(order), F.lit(0.0))))
    fits = ranked.withColumn("level", level).withColumn(
        "level", F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level")))
    # the first source in this order that its cap does not stop sets the level
    first = F.first("level", ignorenulls=True).over(
        by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least("most", F.coalesce(first * F.col("weight"), F.col("most")))
    return fits.select("source_key", "rank", "source_size", target.alias("target"))


def _blocks(sized: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Blocks with their place in the source's permuted order and the passes they are taken in.

    passes: whole times; rest: words of the last, partial pass that fall into the block (null: none).
    """
    blocks = sized.groupBy("source_key", "block").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source_key").orderBy(F.xxhash64("source_key", "block", F.lit(seed)), "block")
    passes = F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double")))
    over = F.col("target") - F.col("passes") * F.col("source_size")
    return (blocks.join(sources, "source_key")
            .withColumn("place", F.row_number().over(order) - 1)
            .withColumn("before", F.sum("words").over(order) - F.col("words"))
            .withColumn("n_blocks", F.count("*").over(Window.partitionBy("source_key")))
            .withColumn("passes", F.coalesce(passes, F.lit(0)))
            .withColumn("rest", F.coalesce(over, F.lit(0.0)) - F.col("before"))
            .withColumn("rest", F.when(F.col("rest") > 0, F.least("rest", "words"))))


def _once(value: Column, use) -> Column:
    """What ``use`` makes of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _hypergeometric(wins: Column, total: Column, draws: Column, u: Column) -> Column:
    """The u-quantile of the wins among ``draws`` draws without replacement from ``total``.

    Probabilities are built up by the ratio of neighbours, over all values within nine standard
    deviations of the mean (beyond them less than 1e-17 is left).
    """
    wins, total, draws = (c.cast("double") for c in (wins, total, draws))
    mean = draws * wins / F.greatest(total, F.lit(1.0))
    spread = F.sqrt(mean * (1 - wins / F.greatest(total, F.lit(1.0)))
                    * (total - draws) / F.greatest(total - 1, F.lit(1.0)))
    low = F.greatest(F.lit(0.0), draws - (total - wins), F.floor(mean - 9 * spread - 2))
    high = F.least(draws, wins, F.ceil(mean + 9 * spread + 2))
    values = F.sequence(low.cast("long"), F.greatest(low, high).cast("long"))

    def following(x: Column) -> Column:
        """The probability of x + 1 as a multiple of that of x."""
        return (wins - x) * (draws - x) / ((x + 1) * F.greatest(total - wins - draws + x + 1, F.lit(1.0)))

    start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"), low.cast("long").alias("at"))
    whole = F.aggregate(values, start, lambda s, x: F.struct(
        (s["p"] * following(x)).alias("p"), (s["sum"] + s["p"]).alias("sum"), s["at"].alias("at")))["sum"]
    return _once(u * whole, lambda limit: F.aggregate(values, start, lambda s, x: F.struct(
        (s["p"] * following(x)).alias("p"), (s["sum"] + s["p"]).alias("sum"),
        F.when(s["sum"] < limit, x).otherwise(s["at"]).alias("at")))["at"])


def _left_draw(level: int, seed: int):
    """A step of a fold over the quotas of a node: what its left half gets of one source."""
    def step(s: Column, quota: Column) -> Column:
        got = _hypergeometric(quota, s["left"], s["slots"],
                              _uniform(F.col("shard"), F.size(s["out"]), level, seed))
        return _once(got, lambda g: F.struct(
            (s["slots"] - g).alias("slots"), (s["left"] - quota).alias("left"),
            F.concat(s["out"], F.array(g)).alias("out")))
    return step


def split_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(shard, source_key, quota, start): the leaves of the tree, and where each shard's units begin."""
    root = quotas.groupBy().agg(
        F.sort_array(F.collect_list(F.struct("rank", "source_key", "quota"))).alias("sources"))
    node = root.select(F.lit(0).cast("long").alias("shard"), "sources",
                       F.expr("transform(sources, s -> s.quota)").alias("q"))
    for level in range(levels):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x)
        node = node.select("shard", "sources", "q", total.alias("total")).withColumn(
            "half", F.floor((F.col("total") + (F.pmod(F.xxhash64("shard", F.lit(seed + level)), F.lit(2)))) / 2))
        start = F.struct(F.col("half").alias("slots"), F.col("total").alias("left"),
                         F.expr("cast(array() as array<bigint>)").alias("out"))

        node = node.withColumn("lefts", F.aggregate("q", start, _left_draw(level, seed))["out"])
        rights = F.zip_with("q", "lefts", lambda a, b: a - b)
        node = node.select("sources", F.posexplode(F.array(F.col("lefts"), rights)).alias("side", "q"), "shard")
        node = node.select((F.col("shard") * 2 + F.col("side")).alias("shard"), "sources", "q")
        if level % 4 == 3 and level + 1 < levels:
            node = node.repartition("shard")
    order = Window.partitionBy("source_key").orderBy("shard")
    return (node.select("shard", F.explode(F.arrays_zip("sources", "q")).alias("x"))
            .select("shard", F.col("x.sources.source_key").alias("source_key"), F.col("x.q").alias("quota"))
            .withColumn("start", F.sum("quota").over(order) - F.col("quota")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE,
        most: int = MOST_TIMES, levels: int | None = None, seed: int = 17) -> Mix:
    """Plan the mix of all rows of ``docs`` (doc_id, text, source).

    Null texts have size 0 and are never taken; null sources are one source, the last. Rows are taken
    as they are: a repeated row is a document of its own. Reruns agree, as every draw is a hash of ids.
    An empty table gives an empty mix.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_CLASS)), F.lit(0)).cast("long")
    sized = stage(docs.select("doc_id", F.xxhash64("text").alias("mark"),
                              _key(F.col("source")).alias("source_key"), size.alias("size"))
                  .withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(SOURCE_BLOCKS))),
                  "mix-sizes")
    sources = stage(source_targets(sized, weights, share, most), "mix-sources")
    if levels is None:
        words = sources.agg(F.sum("target")).first()[0] or 0
        levels = min(max(LEVELS[0], math.ceil(math.log2(max(1.0, words / SHARD_WORDS)))), LEVELS[1])
    blocks = stage(_blocks(sized, sources, seed), "mix-blocks")
    per_block = F.col("passes") + F.when(F.col("rest").isNull(), 0).otherwise(1)
    quotas = blocks.groupBy("source_key", "rank").agg(F.sum(per_block).cast("long").alias("quota"))
    shards = split_quotas(quotas, levels, seed)
    ranges = shards.filter("quota > 0").select(
        "shard", "source_key", F.explode(F.sequence("start", F.col("start") + F.col("quota") - 1)).alias("unit"))
    times = F.when(per_block > 0, F.sequence(F.lit(1).cast("long"), per_block.cast("long")))
    units = stage(blocks.select("source_key", "block", "n_blocks", "place", "passes", F.explode(times).alias("turn"))
             .withColumn("unit", (F.col("turn") - 1) * F.col("n_blocks") + F.col("place"))
             .join(ranges, ["source_key", "unit"])
             .select("source_key", "block", "turn", "passes", "shard"), "mix-units")
    # what the shards have drawn of each block; a turn beyond the whole passes is the partial one
    drawn = units.groupBy("source_key", "block").agg(
        F.count_if(F.col("turn") <= F.col("passes")).alias("whole"),
        F.count_if(F.col("turn") > F.col("passes")).alias("part"),
        F.sort_array(F.collect_list(F.struct("turn", "shard"))).alias("draws"))
    plan = (blocks.join(drawn, ["source_key", "block"], "left")
            .select("source_key", "block", F.coalesce("whole", F.lit(0)).alias("whole"),
                    F.when(F.col("part") > 0, F.col("rest")).alias("rest"), "words", "source_size", "target",
                    F.expr("transform(draws, d -> d.shard)").alias("shards")))
    per_doc = sized.join(plan, ["source_key", "block"])
    # of a source's last block the documents go in hash order while they bring the sum nearer
    partly = F.col("rest").isNotNull() & (F.col("rest") < F.col("words"))
    order = Window.partitionBy("source_key", "block").orderBy(
        F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size")
    cut = (per_doc.filter(partly).withColumn("sofar", F.sum("size").over(order.rowsBetween(
               Window.unboundedPreceding, Window.currentRow)))
           .withColumn("more", F.col("sofar") - F.col("size") / 2 <= F.col("rest")).drop("sofar"))
    sure = per_doc.filter(~partly).withColumn("more", F.col("rest").isNotNull())
    times = F.col("whole") + F.when(F.col("more"), 1).otherwise(0)
    taken = sure.unionByName(cut).select(
        "doc_id", "mark", "source_key", "block", "size", "source_size", "target",
        F.when(F.col("size") > 0, times).otherwise(0).cast("long").alias("times"), "shards")
    return Mix(sized, sources, units, taken)


def mixed_rows(docs: DataFrame, plan: Mix, seed: int = 17) -> DataFrame:
    """The mix itself: the columns of ``docs`` in a row for each time that a document is taken, then shard.

    Rows are sorted within their shard by a hash, which is the local shuffle. Documents that are taken no
    time are left out. A column of ``docs`` named shard gives way. Rows that repeat an id with the same text are told apart by nothing and are taken alike.
    """
    own = docs.columns
    times = plan.taken.filter("times > 0").groupBy("doc_id", "mark").agg(
        F.max(F.struct("times", "shards")).alias("x"))
    chosen = times.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"),
                          F.slice("x.shards", F.lit(1), F.col("x.times").cast("int")).alias("__shards"))
    rows = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__mark")))
    placed = rows.select(*(F.col(f"`{c}`") for c in own), F.posexplode("__shards").alias("__turn", "__shard"))
    kept = [F.col(f"`{c}`") for c in own if c != "shard"]
    return (placed.repartition("__shard")
            .sortWithinPartitions("__shard", F.xxhash64("doc_id", "__turn", F.lit(seed)))
            .select(*kept, F.col("__shard").alias("shard")))
