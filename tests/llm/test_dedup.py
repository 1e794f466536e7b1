"""Exact dedup, n-gram join and line dedup against plain versions."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from parcelsight.llm import common, exact_dedup, line_dedup, ngram_join  # noqa: E402
from parcelsight.llm.components import connected_components  # noqa: E402


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("partitions", [1, 7])
def test_exact_dedup(docs, random_texts, partitions):
    rows = list(enumerate(random_texts(300))) + [(9000 + i, " same  text ") for i in range(200)]
    rows += [(None, "lone"), (None, None), (5, "again"), (5, "again"), (9999, "x" * 300_000)]
    got = exact_dedup.exact_dedup(docs(rows).repartition(4), partitions)
    assert collected(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute.exact(rows)


def test_exact_dedup_of_nothing(docs):
    assert exact_dedup.exact_dedup(docs([])).collect() == []


@pytest.mark.parametrize("long_list", [2, 24])
def test_ngram_join(docs, random_texts, monkeypatch, long_list):
    monkeypatch.setattr(ngram_join, "LONG_LIST", long_list)
    monkeypatch.setattr(ngram_join, "BLOCK", 10)
    rows = list(enumerate(random_texts(250, seed=3)))
    got = ngram_join.ngram_join(docs(rows).repartition(3))
    assert collected(got, "doc_id", "n_shingles", "component_id") == sorted(brute.near(rows), key=str)


def test_ngram_join_of_a_large_group_and_odd_rows(docs):
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(base[:i % 55 + 1] + [f"n{i}"] + base[i % 55 + 2:])) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "just three words"), (503, "just three WORDS"), (504, "v " * 40_000)]
    got = ngram_join.ngram_join(docs(rows))
    assert collected(got, "doc_id", "n_shingles", "component_id") == sorted(brute.near(rows), key=str)
    assert ngram_join.ngram_join(docs([])).collect() == []


def test_ngram_join_with_null_and_reused_ids(docs):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(None, a), (None, b), (2, a), (3, b), (3, c), (7, c), (7, c), (None, "lone words"), (None, None), (-4, c + " z")]
    got = ngram_join.ngram_join(docs(rows))
    assert collected(got, "doc_id", "n_shingles", "component_id") == brute.near(rows)


@pytest.mark.parametrize("chunk", [1, 300])
def test_ngram_join_in_small_chunks(docs, random_texts, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "LONG_LIST", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "CHUNK_SHINGLES", chunk)
    monkeypatch.setattr(ngram_join, "SENT_ROWS", 16)
    rows = list(enumerate(random_texts(200, seed=9)))
    got = ngram_join.ngram_join(docs(rows).repartition(2))
    assert collected(got, "doc_id", "n_shingles", "component_id") == brute.near(rows)


def test_ngram_join_plans_few_exchanges_at_once(docs, random_texts, monkeypatch):
    planned, own = {}, common.stage_at

    def stage_at(df, label):
        exchanges = df._jdf.queryExecution().executedPlan().toString().count("Exchange")
        planned[label] = max(planned.get(label, 0), exchanges)
        return own(df, label)

    monkeypatch.setattr(common, "stage_at", stage_at)
    ngram_join.ngram_join(docs(list(enumerate(random_texts(60, seed=3)))))
    assert planned["links"] and max(planned.values()) <= 10, planned


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 100), (7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(path, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}


@pytest.mark.parametrize("partitions", [1, 5])
def test_line_dedup(docs, random_texts, partitions):
    rows = list(enumerate(random_texts(200, seed=5))) + [(None, "x\nThe shared LINE of all"), (7, "x\r\ny"), (7, "z")]
    got = line_dedup.line_dedup(docs(rows).repartition(partitions))
    assert collected(got, "doc_id", "n_lines", "n_dropped", "text") == brute.lines(rows)
    assert got.columns == ["doc_id", "text", "source", "n_chars", "score", "n_lines", "n_dropped"]
    assert line_dedup.line_dedup(docs([])).collect() == []


def test_line_dedup_counts_a_document_once(docs):
    rows = [(1, "a\na\na\na\na\na\na\na\na\na\na"), (2, "A"), (3, " a ")]
    assert collected(line_dedup.line_dedup(docs(rows)), "doc_id", "n_lines", "n_dropped", "text") == brute.lines(rows)
    short = line_dedup.line_dedup(docs(rows), min_docs=2, min_chars=2)
    assert collected(short, "n_dropped") == [(0,), (0,), (0,)]


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, (5000, 2)).astype(np.uint64)
    counts = np.arange(5000)
    table = line_dedup.PerfectHash(keys, counts)
    assert sorted(table.index(keys)) == list(range(5000))
    assert (table.count(keys) == counts).all()
    others = rng.integers(0, 1 << 63, (5000, 2)).astype(np.uint64)
    assert (table.count(others) > 0).sum() <= 2
