"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its shingles. All shingles of the corpus are ordered from rare to frequent.
Two sets that are similar enough share at least l shingles among the first n - ceil(t n) + l of either.
Each document chooses its own l: a longer prefix means longer lists to read but more matches to ask for,
and it is lengthened as long as that lowers the estimated cost of its candidates. Only pairs with
l matches are verified, by their exact overlap.

Exact copies of a set are one document in all this. Where a list of documents with one prefix shingle
is long, blocks of it are joined first, in the same way; what they link is left out of the joins that
follow, which look for links between different components only: between the components of long lists
in pairs of blocks, with matches too, and by matches in short lists. So no long list is expanded into its pairs, and no link
between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from parcelsight.llm.common import Scratch, give_back, mix, planes, stage, text_slices, unplanes, word_hashes
from parcelsight.llm.components import connected_components

#: Words of a shingle and percent of the union that two sets share at least.
WORDS, PERCENT = 5, 75
#: Most matches asked for, cost of verifying a candidate against reading a list entry.
MOST_MATCHES, VERIFY_COST = 6, 20.0
#: Shingles that are sent together, token ranges for each input partition of PART_BYTES, bits of a shingle hash
#: that the candidate search keeps, lists that are long, and documents of a block.
CHUNK_SHINGLES, BUCKETS, PART_BYTES, TOKEN_BITS, LONG_LIST, BLOCK = 1 << 18, 24, 16 << 20, 48, 24, 200
#: Bytes and rows of the batches that a task sends on.
SENT_BYTES, SENT_ROWS = 1 << 20, 2048
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                         0x85EBCA77C2B2AE63], np.uint64)


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, 64-bit shingle hash) of the distinct shingles of texts, sorted, for slices of the column."""
    factors = mix(np.arange(1, words + 1).astype(np.uint64)) | np.uint64(1)
    for at, data, rows in text_slices(column):
        hashes, row = word_hashes(data, rows)
        count = np.bincount(row, minlength=len(rows) - 1)
        n = max(len(hashes) - words + 1, 0)
        total = np.zeros(n, np.uint64)
        for k in range(words):
            total += hashes[k:n + k] * factors[k]
        inside = row[words - 1:] == row[:n] if n else np.zeros(0, bool)
        docs, found = row[:n][inside], mix(total[inside])
        short = np.flatnonzero((count > 0) & (count < words))
        if len(short):  # the whole sequence is the one shingle; its length tells it from longer ones
            first = np.cumsum(count) - count
            whole = np.zeros(len(short), np.uint64)
            for k in range(words - 1):
                has = count[short] > k
                whole[has] += hashes[first[short][has] + k] * factors[k]
            whole = mix(whole + count[short].astype(np.uint64))
            docs, found = np.append(docs, short), np.append(found, whole)
        order = np.lexsort((found, docs))
        docs, found = docs[order], found[order]
        new = np.ones(len(docs), bool)
        new[1:] = (docs[1:] != docs[:-1]) | (found[1:] != found[:-1])
        yield docs[new] + at, found[new]


_POSTED = "bucket long, tokens binary, docs binary"


def _post(buckets: int, words: int, chunk_shingles: int, sent_rows: int):
    """Rows of packed (token, document) pairs by token range, and packed signatures of the documents.

    Tokens that several documents of a chunk hold go as one entry that counts them (as a negative number);
    the pairs themselves go apart, in rows that no token gathers. So a frequent shingle has an entry for
    each chunk and not for each document.
    """
    width = np.uint64((1 << TOKEN_BITS) // buckets + 1)

    def flush(chunk: list, serial: int) -> Iterator[tuple[int, bytes, bytes]]:
        ids = np.concatenate([c[0] for c in chunk])
        tokens = np.concatenate([c[1] for c in chunk])
        chunk.clear()
        order = np.argsort(tokens, kind="stable")
        ids, tokens = ids[order], tokens[order]
        starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, int)
        times = np.diff(np.append(starts, len(tokens)))
        often = np.repeat(times > 1, times)
        if often.any():
            yield -2 - 2 * serial, planes(tokens[often]), planes(ids[often])  # a group of its own
        tokens, ids = tokens[starts], np.where(times > 1, -times, ids[starts])
        bucket = tokens // width
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(tokens) else np.zeros(0, int)
        for a, b in zip(cuts, np.append(cuts, len(tokens))[1:], strict=True):
            yield int(bucket[a]), planes(np.diff(tokens[a:b], prepend=np.uint64(0))), planes(ids[a:b])

    def packed(rows: Iterator[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += len(row[1]) + len(row[2])
            if size >= SENT_BYTES or len(held) >= sent_rows:
                yield pack(held)
                held, size = [], 0
        if held:
            yield pack(held)

    def pack(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        a, b, c = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.binary()),
                                           pa.array(c, pa.binary())], names=["bucket", "tokens", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # numbers of this task alone for the groups of each chunk, and for its rows
        serial = TaskContext.get().partitionId() << 24
        first = TaskContext.get().partitionId() << 40
        chunk, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, sent_rows):
                part = batch.slice(at, sent_rows)
                ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                keys = first + np.arange(len(ids))
                first += len(ids)
                sizes = np.zeros((5, len(ids)), np.uint64)
                sizes[3] = ids.view(np.uint64)
                sizes[4] = part.column("mark").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                for rows, hashes in shingle_sets(part.column("text"), words):
                    sizes[0] += np.bincount(rows, minlength=len(ids)).astype(np.uint64)
                    np.add.at(sizes[1], rows, mix(hashes + np.uint64(1)))
                    np.add.at(sizes[2], rows, mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))
                    chunk.append((keys[rows], hashes >> np.uint64(64 - TOKEN_BITS)))
                    held += len(rows)
                    if held > chunk_shingles:
                        yield from packed(flush(chunk, serial))
                        serial, chunk, held = serial + 1, [], 0
                yield pack([(-1 - 2 * serial, planes(keys), sizes.astype("<u8").tobytes())])
                serial += 1
        if held:
            yield from packed(flush(chunk, serial))
        del chunk
        give_back()
    return run


_FOUND = "kind int, doc long, token long, a long, b long, id long, mark long"


def _gather(key: tuple, group: pa.Table) -> pa.Table:
    """Of a token range, the tokens that more than one document holds, with how many do.

    Kinds: 0 signatures (a row for each document, with its id and mark), 1 a pair with its frequency a, 2 a pair that still wants
    it, 3 the frequency of a token that such pairs have.
    """
    bucket = key[0].as_py()
    raw = [(unplanes(t), d) for t, d in zip(group["tokens"].to_pylist(), group["docs"].to_pylist(), strict=True)]

    def rows(kind, doc, token, a, b, id_=0, mark=0) -> pa.Table:
        n = len(doc)
        full = lambda v: np.asarray(v).astype(np.int64) if np.ndim(v) else np.full(n, v, np.int64)
        kinds = np.asarray(kind, np.int32) if np.ndim(kind) else np.full(n, kind, np.int32)
        return pa.table({"kind": kinds, "doc": full(doc), "token": full(token), "a": full(a), "b": full(b),
                         "id": full(id_), "mark": full(mark)})

    if bucket < 0 and bucket % 2:
        n, a, b, ids, marks = np.concatenate([np.frombuffer(d, "<u8").reshape(5, -1) for _, d in raw], 1)
        return rows(0, np.concatenate([t for t, _ in raw]).view(np.int64), n, a.view(np.int64), b.view(np.int64),
                    ids.view(np.int64), marks.view(np.int64))
    ids = np.concatenate([unplanes(d) for _, d in raw]).view(np.int64)
    if bucket < 0:
        return rows(2, ids, np.concatenate([t for t, _ in raw]), 0, 0)
    tokens = np.concatenate([np.cumsum(t, dtype=np.uint64) for t, _ in raw])
    order = np.argsort(tokens, kind="stable")
    tokens, ids = tokens[order], ids[order]
    starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
    times = np.add.reduceat(np.where(ids < 0, -ids, 1), starts)
    each = np.repeat(times, np.diff(np.append(starts, len(tokens))))
    single = (ids >= 0) & (each > 1)
    packed = np.zeros(len(tokens), bool)
    packed[starts] = np.logical_or.reduceat(ids < 0, starts)
    kinds = np.append(np.full(single.sum(), 1), np.full(packed.sum(), 3))
    return rows(kinds, np.append(ids[single], np.full(packed.sum(), -1)),
                np.append(tokens[single], tokens[packed]), np.append(each[single], each[packed]), 0)


def _needed(n: Column, percent: int) -> Column:
    """ceil(percent/100 n) in whole numbers: the least overlap with any partner."""
    return F.floor((n * percent + 99) / 100).cast("long")


def _shared_sets(found: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(doc, n, tokens from rare to frequent, dfs) of documents whose first prefix holds a shared shingle."""
    counted = (found.filter("kind = 2").select("doc", "token")
               .join(found.filter("kind = 3").select("token", "a"), "token").select("doc", "token", "a"))
    pairs = found.filter("kind = 1").select("doc", "token", "a").unionByName(counted)
    per_doc = pairs.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("a", "token"))).alias("x"))
    first = F.col("n") - _needed(F.col("n"), percent) + 1
    return (per_doc.join(reps, "doc").filter(F.col("n") - F.size("x") < first)
            .select("doc", "n", F.col("x.token").alias("tokens"), F.col("x.a").alias("dfs")))


def _entries(sets: DataFrame, percent: int) -> DataFrame:
    """(token, df, doc, n, level): in the l-prefix of a document are its entries of levels up to l."""
    alone = F.col("n") - F.size("tokens")
    free = F.col("n") - _needed(F.col("n"), percent)
    return (sets.select("doc", "n", alone.alias("alone"), free.alias("free"),
                        F.posexplode(F.slice(F.arrays_zip("tokens", "dfs"), F.lit(1), F.greatest(
                            F.lit(0), free + MOST_MATCHES - alone).cast("int"))).alias("at", "x"))
            .select(F.col("x.tokens").alias("token"), F.col("x.dfs").alias("df"), "doc", "n",
                    F.greatest(F.lit(1).cast("long"), F.col("at") + 1 + F.col("alone") - F.col("free")).alias("level")))


def _chosen_matches(entries: DataFrame, percent: int) -> DataFrame:
    """(doc, l) with the least estimated cost of lists to read and candidates to verify.

    The lists of the l-prefix have ``read`` entries, so that at most read / l documents match l times.
    """
    reads = [F.sum(F.when(F.col("level") <= k, F.col("list_size"))) for k in range(1, MOST_MATCHES + 1)]
    costs = [F.when(F.least(F.lit(MOST_MATCHES), _needed(F.first("n"), percent)) >= k,
                    F.struct((F.coalesce(r, F.lit(0)) * (1 + VERIFY_COST / k)).alias("cost"), F.lit(k).alias("l")))
             for k, r in enumerate(reads, 1)]
    return entries.groupBy("doc").agg(F.array_min(F.array_compact(F.array(*costs)))["l"].alias("l"))


def _ragged(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all values, offsets of the rows) of a column of lists."""
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(), offsets - offsets[0]


def _prefix_levels(sizes: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """For the tokens of sets, one after the other: the least l whose prefix holds each."""
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return place + 1 + np.repeat(n - sizes - (n - (n * percent + 99) // 100), sizes)


def _join_block(percent: int):
    """Spanning links of the blocks of one group, by the same multi-match prefixes and exact overlaps."""
    def run(group: pa.Table) -> pa.Table:
        blocks, out = group["block"].to_numpy(), []
        docs, sizes, ls = group["doc"].to_numpy(), group["n"].to_numpy(), group["l"].to_numpy()
        values, offsets = _ragged(group["tokens"])
        for block in np.unique(blocks):
            at = np.flatnonzero(blocks == block)
            if len(at) < 2:
                continue
            n, match = sizes[at], ls[at]
            size = offsets[at + 1] - offsets[at]
            row = np.repeat(np.arange(len(at)), size)
            flat = np.concatenate([values[offsets[i]:offsets[i + 1]] for i in at])
            level = _prefix_levels(size, n, percent)
            distinct, column, times = np.unique(flat, return_inverse=True, return_counts=True)
            keep = times[column] > 1
            row, column, level = row[keep], np.unique(column[keep], return_inverse=True)[1], level[keep]
            width = column.max() + 1 if len(column) else 0
            overlap = np.zeros((len(at), len(at)), np.int64)
            shared = np.zeros((MOST_MATCHES + 1, len(at), len(at)), np.int64)
            for a in range(0, width, 4096):
                part = (column >= a) & (column < a + 4096)
                held = np.zeros((len(at), 4096), np.float32)
                held[row[part], column[part] - a] = 1
                overlap += (held @ held.T).astype(np.int64)
                for k in np.unique(match):
                    prefix = np.zeros_like(held)
                    low = part & (level <= k)
                    prefix[row[low], column[low] - a] = 1
                    shared[k] += (prefix @ prefix.T).astype(np.int64)
            candidate = shared[match, np.arange(len(at))] >= match[:, None]
            link = (candidate | candidate.T) & (100 * overlap >= percent * (n[:, None] + n[None, :] - overlap))
            np.fill_diagonal(link, False)
            left = set(range(len(at)))
            while left:
                root = left.pop()
                wave = [root]
                while wave:
                    x = wave.pop()
                    for y in [y for y in np.flatnonzero(link[x]).tolist() if y in left]:
                        left.remove(y)
                        wave.append(y)
                        out.append((docs[at[x]], docs[at[y]]))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def _block_links(sets: DataFrame, entries: DataFrame, chosen: DataFrame, percent: int, groups: int) -> DataFrame:
    """Links found in blocks of long lists: each document with its longest list, in two deals."""
    longest = (entries.filter(F.col("list_size") >= LONG_LIST).groupBy("doc")
               .agg(F.max(F.struct("list_size", "token")).alias("x"))
               .select("doc", F.col("x.token").alias("token"), F.col("x.list_size").alias("size")))
    deals = F.explode(F.array(F.lit(1), F.lit(2))).alias("deal")
    dealt = longest.select("doc", "token", "size", deals).withColumn(
        "block", F.xxhash64("token", "deal", F.pmod(F.xxhash64("doc", "deal"),
                                                    F.ceil(F.col("size") / BLOCK).cast("long"))))
    rows = (sets.join(dealt.select("doc", "block"), "doc").join(chosen, "doc")
            .select(F.pmod("block", F.lit(groups)).alias("g"), "block", "doc", "n", "l", "tokens"))
    return rows.groupBy("g").applyInArrow(_join_block(percent), "a long, b long")


def _known(entries: DataFrame, chosen: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries of lists that hold several components, with c, the component, and main, the list's largest."""
    known = (entries.join(labels.withColumnRenamed("id", "doc"), "doc", "left").join(chosen, "doc")
             .select("token", "list_size", "doc", "n", "level", "l", F.coalesce("component", "doc").alias("c")))
    main = (known.groupBy("token", "c").agg(F.count("*").alias("k")).groupBy("token")
            .agg(F.max(F.struct("k", "c"))["c"].alias("main"), F.count("*").alias("parts"))
            .filter("parts > 1").select("token", "main"))
    return known.join(main, "token")


def _join_sides(percent: int):
    """Links between the two sides of a pair of blocks, one for each document and component.

    Pairs need the matches in their prefixes that the probing document asks for; whole sets are compared then.
    """
    def run(group: pa.Table) -> pa.Table:
        side, docs, c, ls = (group[k].to_numpy() for k in ("side", "doc", "c", "l"))
        sizes, (values, offsets) = group["n"].to_numpy(), _ragged(group["tokens"])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out = set()
        if len(left) and len(right):
            lengths = np.diff(offsets)
            row = np.repeat(np.arange(len(docs)), lengths)
            column = np.unique(values, return_inverse=True)[1]
            level = _prefix_levels(lengths, sizes, percent)

            def products(tokens: np.ndarray, some: np.ndarray, others: np.ndarray) -> np.ndarray:
                """How many of the chosen tokens each of ``some`` shares with each of ``others``."""
                total = np.zeros((len(some), len(others)), np.int64)
                names, columns = np.unique(column[tokens], return_inverse=True)
                rows = row[tokens]
                for a in range(0, len(names), 2048):
                    at = (columns >= a) & (columns < a + 2048)
                    held = np.zeros((len(docs), 2048), np.float32)
                    held[rows[at], columns[at] - a] = 1
                    total += (held[some] @ held[others].T).astype(np.int64)
                return total

            candidate = c[left][:, None] != c[right][None, :]
            for k in np.unique(ls[left]):
                asking = np.flatnonzero(ls[left] == k)
                candidate[asking] &= products(np.flatnonzero(level <= k), left[asking], right) >= k
            some, others = np.flatnonzero(candidate.any(1)), np.flatnonzero(candidate.any(0))
            if len(some):
                candidate, left, right = candidate[np.ix_(some, others)], left[some], right[others]
                overlap = products(np.arange(len(row)), left, right)
                union = sizes[left][:, None] + sizes[right][None, :] - overlap
                link = candidate & (100 * overlap >= percent * union)
                out = {(docs[left[i]], c[right[j]]): docs[right[j]] for i, j in zip(*np.nonzero(link), strict=True)}
                out = {(a, b) for (a, _), b in out.items()}
        a, b = zip(*sorted(out), strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def _family_links(known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that share a long list, found in pairs of blocks.

    Long lists with the same main component are one family: their documents outside of it, in blocks, meet all
    documents of the family, in blocks. A pair is looked at once, whatever the number of lists it shares,
    and only links leave a task.
    """
    members = (known.filter(F.col("list_size") >= LONG_LIST).groupBy("main", "doc")
               .agg(F.first("c").alias("c"), F.first("l").alias("l"))
               .withColumn("probe", F.col("c") != F.col("main")))
    sizes = members.groupBy("main").agg(F.ceil(F.count_if("probe") / BLOCK).cast("long").alias("x"),
                                        F.ceil(F.count("*") / BLOCK).cast("long").alias("y"))
    dealt = members.join(sizes, "main").filter("x > 0")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("doc"), F.col(c))
    columns = ("main", "doc", "c", "l")
    probes = dealt.filter("probe").select(*columns, F.lit(0).alias("side"), own("x").alias("i"), upto("y").alias("j"))
    others = dealt.select(*columns, F.lit(1).alias("side"), own("y").alias("j"), upto("x").alias("i"))
    rows = probes.unionByName(others).join(sets.select("doc", "n", "tokens"), "doc")
    return rows.groupBy("main", "i", "j").applyInArrow(_join_sides(percent), "a long, b long")


def _candidates(known: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components with enough matches in short lists; a, the smaller id, says how many.

    In each list the documents of the component that most of it belongs to do not look for partners
    themselves; the others look among all. Pairs that share a long list need no candidate here.
    """
    known = known.filter(F.col("list_size") < LONG_LIST)
    x = known.filter("c != main").select(F.col("token").alias("x_token"), *(F.col(k).alias(f"x_{k}") for k in ("doc", "n", "level", "l", "c")))
    y = known.select(F.col("token").alias("y_token"), "main", *(F.col(k).alias(f"y_{k}") for k in ("doc", "n", "level", "l", "c")))
    small = F.col("x_doc") < F.col("y_doc")
    matches = F.when(small, F.col("x_l")).otherwise(F.col("y_l"))
    pairs = x.join(y, (F.col("x_token") == F.col("y_token")) & (F.col("x_c") != F.col("y_c"))
                   & (F.col("x_n") * 100 >= F.col("y_n") * percent) & (F.col("y_n") * 100 >= F.col("x_n") * percent)
                   & (small | (F.col("y_c") == F.col("main")))
                   & (F.col("x_level") <= matches) & (F.col("y_level") <= matches))
    return (pairs.groupBy(F.least("x_doc", "y_doc").alias("a"), F.greatest("x_doc", "y_doc").alias("b"))
            .agg(F.count("*").alias("m"), F.first(matches).alias("l")).filter("m >= l").select("a", "b"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("doc").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    b = sets.select(F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
    both = F.size(F.array_intersect("t_a", "t_b"))
    return (pairs.join(a, "a").join(b, "b")
            .filter(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)).select("a", "b"))


def ngram_join(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """Components of documents whose shingle sets share ``percent`` of their union or more.

    Takes (doc_id, text). Returns one row for each input row: doc_id, n_shingles, component_id (the smallest
    doc_id that is reachable by links), mark (a hash of the text) and kept: whether the row has the smallest doc_id and, of
    rows with this id, the smallest mark of its component. Words are runs without ``[\\x20\\x09-\\x0D]``, A-Z lowered. With fewer
    words than a shingle has, the whole sequence is the one shingle. Without words or text a set is empty
    and linked with nothing. Each row is a document of its own, also where an id is null or used again; a null is
    the last choice for a component's id. Very long texts are cut into slices of their own; other columns are not
    read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    none = 1 << 62
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(none)).alias("doc_id"), "text",
                         F.xxhash64("text").alias("mark"))
    parts = max(1, source.rdd.getNumPartitions())
    expected = int(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    buckets = max(shuffles, BUCKETS * min(parts, -(-expected // PART_BYTES)))
    scratch = Scratch(spark)
    found = scratch.stage(source.mapInArrow(_post(buckets, words, CHUNK_SHINGLES, SENT_ROWS), _POSTED)
                  .groupBy("bucket").applyInArrow(_gather, _FOUND), "ngram-found")
    signs = stage(found.filter("kind = 0").select("id", "mark", "doc", F.col("token").alias("n"), "a", "b"),
                  "ngram-signatures")
    classes = signs.filter("n > 0").groupBy("n", "a", "b").agg(
        F.min("doc").alias("rep"), F.min(F.struct("id", "mark")).alias("least"))
    reps = classes.select(F.col("rep").alias("doc"), "n")
    sets = scratch.stage(_shared_sets(found, reps, percent), "ngram-sets")
    scratch.release(but=1)
    entries = _entries(sets, percent)
    lists = entries.groupBy("token").agg(F.count("*").alias("list_size")).filter("list_size > 1")
    entries = scratch.stage(entries.join(lists, "token"), "ngram-entries")
    chosen = scratch.stage(_chosen_matches(entries, percent), "ngram-matches")
    blocks = scratch.stage(_block_links(sets, entries, chosen, percent, 4 * shuffles), "ngram-blocks")
    known = scratch.stage(_known(entries, chosen, connected_components(blocks)), "ngram-known")
    # staged one by one: in one plan their exchanges would run and be held by the driver at once
    families = scratch.stage(_family_links(known, sets, percent), "ngram-families")
    pairs = scratch.stage(_candidates(known, percent), "ngram-candidates")
    links = blocks.unionByName(families).unionByName(scratch.stage(_verified(pairs, sets, percent), "ngram-verified"))
    labels = stage(connected_components(links).withColumnRenamed("id", "rep"), "ngram-labels")
    scratch.release()
    labelled = classes.join(labels, "rep", "left").select(
        "n", "a", "b", "least", F.coalesce("component", "rep").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("least").alias("smallest"))
    named = labelled.join(smallest, "component").select("n", "a", "b", "smallest")
    return signs.join(named, ["n", "a", "b"], "left").select(
        F.nullif(F.col("id"), F.lit(none)).alias("doc_id"), F.col("n").alias("n_shingles"),
        F.nullif(F.coalesce("smallest.id", "id"), F.lit(none)).alias("component_id"), "mark",
        F.coalesce((F.col("smallest.id") == F.col("id")) & (F.col("smallest.mark") == F.col("mark")), F.lit(True)).alias("kept"))
