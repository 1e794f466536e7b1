"""Mixing, nearest neighbours, WARC bundles, the registry and the pipeline."""

import hashlib
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from parcelsight.llm import ann, mixing, warc  # noqa: E402


def water_level(sizes, weights=(3, 1, 2), share=1.5):
    """Targets by handing the excess over a cap to the others, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, fixed, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > 2 * sizes[s]}
        if not over:
            return fixed | {s: left * w[s] / total for s in open_}
        for s in over:
            fixed[s] = 2 * sizes[s]
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return fixed


@pytest.fixture()
def mixed(docs):
    rows = [(i, "w " * (1 + i * 7 % 23), ["a", "b", "c", None, "é", "Z"][min(i % 9, 5)]) for i in range(900)]
    rows += [(5000, None, "a"), (5001, "", None), (5002, " \n", "only blanks"), (None, "x y", "b"), (7, "w " * 50, "b")]
    return rows, docs(rows)


def test_mixing(mixed):
    rows, table = mixed
    plan = mixing.mix(table)
    taken = plan.taken.collect()
    assert len(taken) == len(rows)
    sizes, words = defaultdict(int), Counter()
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    targets = water_level(sizes)
    name = lambda key: None if key == "-" else key[1:]
    for r in taken:
        source = name(r["source_key"])
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(targets[source])
        assert 0 <= r["times"] <= 2 and (r["size"] or not r["times"])
        words[source] += r["size"] * r["times"]
    for source, target in targets.items():
        assert abs(words[source] - target) <= 50, source
    again = sorted(map(str, mixing.mix(table.repartition(5)).taken.collect()))
    assert again == sorted(map(str, taken))


def test_mixing_tree_keeps_quotas_and_gives_each_unit_to_one_shard(mixed):
    _, table = mixed
    plan = mixing.mix(table, levels=3)
    units = plan.units.collect()
    assert len({(u["source_key"], u["block"], u["turn"]) for u in units}) == len(units)
    sizes = Counter(u["shard"] for u in units)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 3
    got = mixing.mixed_rows(table, plan)
    times = {r["doc_id"]: r["times"] for r in plan.taken.collect() if r["doc_id"] != 7}
    counts = Counter(r["doc_id"] for r in got.collect() if r["doc_id"] != 7)
    assert counts == Counter({d: t for d, t in times.items() if t})


def test_hypergeometric_draws(spark):
    df = spark.range(4000).select(mixing._hypergeometric(
        F.lit(30), F.lit(100), F.lit(40), mixing._uniform(F.col("id"), 1)).alias("x"))
    x = np.array([r["x"] for r in df.collect()])
    assert abs(x.mean() - 12) < 0.15 and abs(x.var() - 40 * .3 * .7 * 60 / 99) < 0.4
    edge = spark.range(50).select(mixing._hypergeometric(F.lit(0), F.lit(10), F.lit(4), F.lit(.5)).alias("a"),
                                  mixing._hypergeometric(F.lit(10), F.lit(10), F.lit(4), F.lit(.5)).alias("b")).first()
    assert tuple(edge) == (0, 4)


def test_mixing_is_native_and_takes_empty_tables(docs, mixed):
    text = mixing.mixed_rows(mixed[1], mixing.mix(mixed[1]))._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text
    assert mixing.mix(docs([])).taken.collect() == []


def test_nearest(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(1500, 16)).astype(np.float32)
    vectors[100:400] = vectors[100]  # a very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] + [1.0] * 15),
             (9005, [1.0]), (None, [1.0] * 16), (9006, [float("inf")] * 16), (3, rows[3][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = table.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    got = defaultdict(list)
    for r in ann.nearest(table, asked).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    hits = 0
    assert set(got) == set(range(0, 1500, 50))
    for q, finds in got.items():
        score = unit @ unit[q]
        score[q] = -9
        want = np.lexsort((np.arange(1500), -score.round(9)))[:5].tolist()
        assert len(finds) == 5 and all(abs(s - score[v]) < 1e-9 for v, s in finds)
        hits += len(set(want) & {v for v, _ in finds})
    assert hits / (5 * len(got)) >= 0.95
    few = ann.nearest(table.filter("vec_id < 3"), table.filter("vec_id = 0").withColumnRenamed("vec_id", "query_id"))
    assert few.count() == 2
    assert ann.nearest(table.filter("false"), table.filter("false").withColumnRenamed("vec_id", "query_id")).count() == 0


def test_graph_prunes_and_stays_connected():
    rng = np.random.default_rng(5)
    points = ann._unit(rng.normal(size=(800, 12)))
    edges, entry = ann.build_graph(points, degree=12, beam=32)
    seen, wave = {entry}, [entry]
    while wave:
        for y in edges[wave.pop()].tolist():
            if y >= 0 and y not in seen:
                seen.add(y)
                wave.append(y)
    assert len(seen) >= 790 and (edges >= 0).sum(1).max() <= 12


def test_warc_round_trip(spark):
    big = "é" * 400_000
    rows = [(5, "http://a/ b\n", "x" * 100), (3, None, "x" * 100), (9, "http://c", "x" * 99), (8, "u", "x" * 99),
            (1, "u", None), (2, "u", ""), (None, "u", "x" * 100), (4, "u", big), (6, "u", big), (3, "u", "x" * 100)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    index = warc.write_warc(pages.repartition(3), warc.archive_folder(spark))
    got = sorted((tuple(r) for r in warc.read_warc(index).drop("url", "payload").collect()), key=str)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        again = len(data) >= 100 and page != min(same)
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response",
                     min(same) if again else None))
    assert got == sorted(want, key=str)
    place = index.filter("page_id = 9").first()
    fields, body = warc.read_record(place["bundle"], place["frame"], place["offset"], place["length"])
    assert body == b"x" * 99 and fields["WARC-Record-ID"] == "<urn:page:9>"
    empty = warc.write_warc(pages.filter("false"), warc.archive_folder(spark))
    assert warc.read_warc(empty).collect() == []


def test_warc_is_read_in_many_tasks(spark):
    rows = [(i, None, f"page {i} " * 9000) for i in range(160)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write_warc(pages, warc.archive_folder(spark))
    assert index.agg(F.max("frame")).first()[0] >= 8
    read = warc.read_warc(index, part_frames=2)
    per_task = read.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) >= 4 and sum(r["count"] for r in per_task) == 160
    assert read.select("page_id").distinct().count() == 160


def test_mixed_rows_of_a_table_with_shards(mixed):
    _, table = mixed
    table = table.withColumn("shard", F.lit("mine"))
    plan = mixing.mix(table)
    got = mixing.mixed_rows(table, plan)
    assert [c for c in got.columns if c == "shard"] == ["shard"] and got.schema["shard"].dataType.typeName() == "long"
    assert got.count() == plan.taken.agg(F.sum("times")).first()[0]


def test_registry():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op2_ngram_join", "op8_line_dedup", "op9_warc", "op11_divergence",
                                  "op12_vector_dedup"])
def test_queries_against_sql(spark, sf_dir, name):
    import __spark_entry__ as entry
    from oracle_check import compare, connect

    assert compare(entry.queries()[name](spark, sf_dir), connect(sf_dir), entry.oracle_sql()[name]) == ""


def test_pipeline(spark, sf_dir):
    """Each stage's decisions follow from what the one before it kept."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [[tuple(r) for r in docs.collect()]]
    columns = docs.columns
    for name, work in p.STAGES[:-1]:
        docs = p.stage(work(spark, docs, sf_dir), "test")
        assert docs.columns == columns
        kept.append([tuple(r) for r in docs.select(*columns).collect()])
    ids = [Counter(r[0] for r in k) for k in kept]
    assert ids[1].keys() < ids[0].keys() and ids[2] == ids[1] and ids[3].keys() <= ids[2].keys()
    want = {d: text for d, _, _, text in brute.lines([r[:2] for r in kept[1]])}
    assert {r[0]: r[1] for r in kept[2]} == want
    assert set(ids[3]) == {d for d, _, c in brute.near([r[:2] for r in kept[2]]) if d == c}
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].values()) <= 2
    last = p.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == len(kept[4]) and p.run(spark, sf_dir).count() == len(kept[4])


@pytest.fixture()
def odd(spark):
    """Documents with nulls, repeated rows and ids, a long text and columns that operators use themselves."""
    base = " ".join(f"b{i}" for i in range(40))
    line = "a line that many share"
    rows = [(1, base), (1, base), (1, "another text altogether with seven words"), (2, base + " more"), (None, base),
            (None, None), (3, ""), (4, "x " * 30_000), (5, None), (5, None)]
    rows += [(100 + i, f"own words {i} of row {i} that nobody else has in {i}\n{line}") for i in range(12)]
    names = ["lang", "source", "n_chars", "score", "predicted", "n_lines", "n_dropped", "shard", "mark", "kept", "size"]
    return rows, spark.createDataFrame([(d, t, "en", "s", 7, *[i] * 8) for i, (d, t) in enumerate(rows)],
                                       "doc_id long, text string, lang string, source string, n_chars long, "
                                       + ", ".join(f"{n} int" for n in names[3:]))


def test_stages_on_odd_tables(spark, odd, sf_dir):
    import corpus_pipeline as p

    rows, docs = odd
    stages = dict(p.STAGES)
    for name, work in p.STAGES[:-1]:
        nothing = work(spark, docs.filter("false"), sf_dir)
        assert nothing.collect() == [] and nothing.columns == docs.columns, name
    clean = stages["toxicity"](spark, docs, sf_dir)
    assert clean.columns == docs.columns
    by_score = {r["score"]: r for r in docs.collect()}
    assert all(r == by_score[r["score"]] for r in clean.collect())
    lined = stages["line dedup"](spark, docs, sf_dir)
    assert lined.columns == docs.columns and lined.count() == len(rows)
    for r in lined.collect():
        text = (rows[r["score"]][1] or "").replace("\na line that many share", "")
        assert (r["text"], r["n_chars"], r["n_lines"], r["n_dropped"]) == (text, len(text), r["score"], r["score"])
    near = stages["n-gram Jaccard join"](spark, docs, sf_dir)
    kept = [tuple(r)[:2] for r in near.collect()]
    assert near.columns == docs.columns
    assert sorted(kept, key=str) == sorted([(1, rows[0][1]), (1, rows[2][1]), (None, None), (3, ""), (4, rows[7][1]), (5, None),
                                            (5, None), *rows[10:]], key=str)
    mixed = stages["mixing sources to target weights"](spark, docs, sf_dir)
    assert mixed.columns == docs.columns
    assert all(r == by_score[r["score"]] for r in mixed.collect())
    last = stages["BPE encoding and decoding"](spark, docs, sf_dir)
    assert last.count() == len(rows) and {r["n_tokens"] for r in last.filter("text is null").collect()} <= {0} if (
        "text" in last.columns) else last.filter("doc_id = 3").first()["n_tokens"] == 0
    assert stages["BPE encoding and decoding"](spark, docs.filter("false"), sf_dir).collect() == []
