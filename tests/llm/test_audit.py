"""Source divergence, vector dedup and periodic runs against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from parcelsight.llm import divergence, queries, runs, vector_dedup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_divergence(rows, least=3, top=200):
    docs = [((lang or ""), (source or ""),
             re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in held.items() if n >= least}
        groups = {s: Counter(t for d in mine if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in mine}}
        whole = sum(groups.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        f = lambda p, q: (p - q) * (p - q) // q
        for s, c in groups.items():
            pairs = [(-sum(f(share(c, t), share(o, t)) for t in kept), x) for x, o in groups.items() if x != s]
            terms = [(-f(share(c, t), share(whole, t)), t) for t in c if share(c, t) > share(whole, t)]
            utf = lambda x: (x[0], x[1].encode())
            for part, items in (("pair", sorted(pairs, key=utf)), ("term", sorted(terms, key=utf)[:top])):
                out |= {(lang, s, part, item, -v, i) for i, (v, item) in enumerate(items, 1)}
    return out


@pytest.fixture()
def talk():
    rng = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["É", "naïve", "日本", "𐐀x", "A", "a"]
    rows = []
    for i in range(260):
        source = rng.choice(["s0", "s0", "s0", "s1", "s2", "S\U00010000", "S￿", None])
        rows.append((" ".join(rng.choices(words[:rng.choice([8, 40, 96])], k=rng.randint(0, 30))) + rng.choice(["", "-X9y", "\n"]),
                     rng.choice(["en", "en", "de", None, ""]), source))
    rows += [(None, "en", "empty"), ("rare1 words2 only3", "xx", "a"), ("", "xx", "b"), ("q " * 70_000, "en", "s1")]
    return rows


@pytest.mark.parametrize("blocks", [(32, 4096), (2, 20)])
def test_divergence(spark, talk, blocks, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE_BYTES", 1 << 20)
    df = spark.createDataFrame([(*r, "clash", 1) for r in talk],
                               "text string, lang string, source string, term string, n long").repartition(5)
    got = divergence.source_divergence(df, group_block=blocks[0], cell_terms=blocks[1])
    rows = list(map(tuple, got.collect()))
    assert len(rows) == len(set(rows)) and set(rows) == plain_divergence(talk)
    few = {tuple(r) for r in divergence.source_divergence(df, top=2, group_block=3, cell_terms=7).collect()}
    assert few == plain_divergence(talk, top=2)


def test_divergence_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.source_divergence(empty).collect() == []
    bare = spark.createDataFrame([(None, None, None), ("", "en", "a"), (None, "en", "b")], empty.schema)
    assert {tuple(r) for r in divergence.source_divergence(bare).collect()} == {
        ("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_shares_of_huge_counts():
    counts, totals = np.array([0, 7, 10**15 - 1]), np.array([10**15])
    want = [1 + 10**9 * (int(c) + 1) // 10**15 for c in counts]
    assert divergence.shares(counts, totals).tolist() == want


def test_pieces_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE_BYTES", 7)
    text = "Ab cde  fghijklmnopq r É1é st\nuvw" * 5
    assert [t for p in divergence._pieces(text) for t in p] == [t.encode() for t in re.findall(
        "[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOW))]


def plain_links(rows, cosine=0.95):
    """(id, links, component, kept) of rows with usable vectors of one length; the others are alone."""
    def unit(e):
        if not e or len(e) != 16 or any(x is None or not np.isfinite(x) for x in e) or not any(e):
            return np.zeros(16)
        v = np.array(e, float) / max(map(abs, e))
        return v / np.sqrt(v @ v)
    u = np.array([unit(e) for _, e in rows])
    link = u @ u.T >= cosine
    np.fill_diagonal(link, False)
    label = np.array([1 << 62 if i is None else i for i, _ in rows])
    while True:
        new = np.array([min(label[i], label[link[i]].min(initial=1 << 62)) for i in range(len(rows))])
        if (new == label).all():
            break
        label = new
    return sorted(((i, int(n), None if c == 1 << 62 else int(c), (i if i is not None else 1 << 62) == c)
                   for (i, _), n, c in zip(rows, link.sum(1), label, strict=True)), key=str)


@pytest.mark.parametrize("block", [1024, 16])
def test_vector_dedup(spark, block):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(500, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(160):  # a large group of near copies, and small ones near the threshold
        rows.append((1000 + i, (base[0] + rng.normal(size=16) * 0.12).astype(np.float32).tolist()))
        rows.append((2000 + i, (base[i] + rng.normal(size=16) * 0.2).astype(np.float32).tolist()))
    rows += [(3000 + i, rows[7][1]) for i in range(150)] + [(4000, (base[7] * 8).tolist()), (4001, (base[7] * -1).tolist())]
    rows += [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] + [1.0] * 15), (9005, [1.0]),
             (9006, [float("inf")] * 16), (9007, []), (None, rows[9][1]), (None, rows[9][1]), (5, rows[5][1]),
             (9008, [-0.0, 1e30] + [0.0] * 14), (9009, [0.0, 1e-30] + [0.0] * 14)]
    table = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<float>, n_links int").repartition(6)
    got = sorted(map(tuple, vector_dedup.vector_dedup(table, block=block).collect()), key=str)
    want = plain_links(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    found, all_ = sum(g[1] for g in got), sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True)) and found >= 0.999 * all_
    if found == all_:
        assert got == want


def test_vector_dedup_of_few(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert vector_dedup.vector_dedup(table).collect() == []
    one = spark.createDataFrame([(4, None), (3, [2.0]), (2, [5.0]), (1, [-1.0])], table.schema)
    assert sorted(map(tuple, vector_dedup.vector_dedup(one).collect())) == [
        (1, 0, 1, True), (2, 1, 2, True), (3, 1, 2, False), (4, 0, 4, True)]


def test_codes_are_balanced_and_miss_little():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(2000, 32)) * np.linspace(2, .5, 32)
    codes = vector_dedup.Codes(points, 1 << 18)
    got = codes(points)
    assert got.shape == (2000, codes.tables) and codes.width == 10
    bits = (got[:, :, None] >> np.arange(codes.width)) & 1
    assert abs(bits.mean((0, 1)) - .5).max() < .1
    noise = rng.normal(size=points.shape)
    u = points / np.linalg.norm(points, axis=1)[:, None]
    noise -= (noise * u).sum(1)[:, None] * u
    near = .95 * u + np.sqrt(1 - .95 ** 2) * noise / np.linalg.norm(noise, axis=1)[:, None]
    assert (codes(near) == got).any(1).mean() >= .997


def plain_runs(words):
    seen = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and j > i:
                seen.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, z - a, q) for (a, z), q in seen.items())


def repetitive(rng):
    k, n = rng.choice([1, 2, 2, 3, 5, 60]), rng.choice([0, 1, 5, 6, 7, 30, 60, 200])
    words = [f"v{rng.randrange(k)}" for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 10:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // rng.randint(3, 10)))
            for i in range(a + p, min(n, a + p * rng.randint(2, 12))):
                words[i] = words[i - p]
    return words


def test_word_runs():
    rng = random.Random(11)
    for _ in range(60):
        docs = [repetitive(rng) for _ in range(rng.randint(1, 9))]
        names = {w: i for i, w in enumerate({w for d in docs for w in d})}
        ids = np.array([names[w] for d in docs for w in d], np.int64)
        got = runs.word_runs(ids, np.array([len(d) for d in docs]))
        assert got == [plain_runs(d) for d in docs] == [runs._plain_runs(np.array([names[w] for w in d])) for d in docs]


def test_word_runs_of_long_periodic_words():
    fibonacci = [0, 1]
    while len(fibonacci) < 4000:
        fibonacci = [*fibonacci, *fibonacci[:len(fibonacci) * 5 // 8]]
    morse = [bin(i).count("1") % 2 for i in range(1 << 12)]
    for words in ([7] * 3000, [1, 2] * 900 + [1], fibonacci[:1500], morse, [1, 1, 1, 1, 1, 1, 2] * 200):
        assert runs.word_runs(np.array(words), np.array([len(words)])) == [plain_runs(words)]


def test_a_clash_of_hashes_is_noticed(monkeypatch):
    monkeypatch.setattr(runs._Hashes, "window", lambda self, at, size: self.sums[at] & np.uint64(0))
    words = [1, 2, 3, 4, 5, 6, 7] * 6 + [1, 1, 1, 1, 1, 1]
    assert runs.word_runs(np.array(words), np.array([len(words)])) == [plain_runs(words)]


def test_grammar_covers_the_words():
    rng = np.random.default_rng(5)
    words, counts = rng.integers(0, 9, 3000), np.array([1000, 0, 1500, 500])
    doc = np.repeat(np.arange(4), counts)
    top, _, rules = runs.repair(words, doc)
    texts = defaultdict(set)
    for r, s in zip(rules["rule"], rules["start"], strict=True):
        texts[r].add((int(doc[s]), *words[s:s + rules["size"][r]].tolist()))
    assert all(len(t) == 1 for t in texts.values())  # a rule has one text, in one document
    assert min(Counter(rules["rule"].tolist()).values()) >= 2
    assert (~top).sum() == len(rules["rule"])  # every boundary is of one rule or at the top


def test_periodic_runs(spark, docs):
    rng = random.Random(2)
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(repetitive(rng))) for i in range(150)]
    rows += [(None, None), (None, ""), (900, "x " * 30_000), (901, " é é  é é é é é é"), (3, rows[3][1]), (902, "A a " * 9)]
    got = runs.periodic_runs(docs(rows).repartition(3)).collect()
    want = []
    for d, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        found = plain_runs(words) if len(words) < 10_000 else [(0, len(words), 1)]
        drop = {i for s, n, q in found for i in range(s + q, s + n)}
        want.append((d, len(words), found, " ".join(w for i, w in enumerate(words) if i not in drop)))
    assert sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got), key=str) == sorted(
        want, key=str)
    assert got[0].asDict().keys() == {"doc_id", "source", "n_chars", "score", "n_words", "runs", "collapsed"}
    assert runs.periodic_runs(docs([])).collect() == []


def test_op13_query(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join(repetitive(rng))) for i in range(120)] + [(500, None), (501, " \n"), (None, "a " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for d, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(d).encode())
        if d is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = plain_runs(words)
        drop = {i for s, m, q in found for i in range(s + q, s + m)}
        s, m, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        want.append((d, len(found), s, m, q, 1000 * m // q if found else None,
                     sha("".join(f"{s},{m},{q}\n" for s, m, q in sorted(found, key=lambda r: (r[0], r[2])))),
                     sha(" ".join(w for i, w in enumerate(words) if i not in drop))))
    got = queries.queries()["op13_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
