"""Automaton, spans and the two classifiers."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from parcelsight.llm import bpe, pii, quality, queries, toxicity
from parcelsight.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def samples():
    rng = random.Random(4)
    out = [None, "", " \n", "Hello, World! it's 12 o'clock", "a<|endoftext|>b <|startoftext|>", "<|endoftext", "x" * 5000,
           "Straße İstanbul ΑΣ ΟΔΟΣ ς", "é ﬁ ẞ", "\x1c\x85 　x y", "日本語 ½² 😀", "a\u209d\u209eb x\u209f",  "a" * 9 + " " + "aaaa"]
    out += ["".join(rng.choices("aeionsthr'.,! ", k=rng.randint(1, 80))) for _ in range(300)]
    out += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x24f), rng.randint(0x370, 0x4ff)]))
                    for _ in range(rng.randint(1, 30))) for _ in range(300)]
    return out


def test_bpe_equals_the_library(docs, reference):
    rows = list(enumerate(samples())) + [(None, "null id"), (1, "twice"), (1, "twice")]
    got = bpe.bpe_round_trip(docs(rows), tokenizer_path()).collect()
    assert len(got) == len(rows)
    assert got[0].asDict().keys() == {"doc_id", "source", "n_chars", "score", "n_tokens", "token_ids", "decoded"}
    for (_, text), r in zip(rows, got, strict=True):
        ids = reference.encode(text or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["token_ids"]) == (len(ids), " ".join(map(str, ids))), text
        assert r["decoded"] == reference.decode(ids, skip_special_tokens=False), text
    assert bpe.bpe_round_trip(docs([]), tokenizer_path()).collect() == []


def test_small_automaton_follows_the_order_of_merges():
    spec = {"model": {"vocab": {c: i for i, c in enumerate(["a", "b", "ab", "aa", "aab", "ba"])},
                      "merges": [["a", "b"], ["a", "a"], ["aa", "b"], ["b", "a"]]},
            "normalizer": {"normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}},
                                           {"type": "Lowercase"}]},
            "pre_tokenizer": {"pretokenizers": [{"pattern": {"Regex": r"\p{L}+"}}]}, "added_tokens": []}
    machine = bpe.Automaton(spec)

    def merged(word):
        parts = list(word)
        for a, b in spec["model"]["merges"]:
            k = 0
            while k < len(parts) - 1:
                if (parts[k], parts[k + 1]) == (a, b):
                    parts[k:k + 2] = [a + b]
                k += 1
        return [spec["model"]["vocab"][p] for p in parts]

    words = ["".join(w) for n in range(1, 9) for w in __import__("itertools").product("ab", repeat=n)]
    assert all(machine.word(w) == merged(w) for w in words)
    flat, bounds = machine.batch(words)
    assert [flat[a:z].tolist() for a, z in zip(bounds, bounds[1:])] == [merged(w) for w in words]


def test_bpe_forgets_and_learns_again(reference):
    encode = bpe.Encoder(bpe.automaton(open(tokenizer_path(), encoding="utf-8").read()), most=40).encode
    texts = [t or "" for t in samples()]
    for at in range(0, len(texts), 50):
        sizes, ids, decoded = encode(texts[at:at + 50])
        for text, n, i, d in zip(texts[at:at + 50], sizes.tolist(), ids.to_pylist(), decoded.to_pylist(), strict=True):
            want = reference.encode(text, add_special_tokens=False).ids
            assert (n, i, d) == (len(want), " ".join(map(str, want)), reference.decode(want, skip_special_tokens=False))


def test_decode_ids(spark, reference):
    rows = [(1, "320 1125 269", [320, 1125, 269]), (2, "", []), (3, None, None), (4, "49407 320 99999999", [49407, None, 320])]
    df = spark.createDataFrame(rows, "doc_id long, token_ids string, list array<long>").withColumn("decoded", F.lit(1))
    by_text = {r["doc_id"]: r["decoded"] for r in bpe.decode_ids(df, tokenizer_path()).collect()}
    by_list = {r["doc_id"]: r["decoded"] for r in bpe.decode_ids(df, tokenizer_path(), "list").collect()}
    want = {1: reference.decode([320, 1125, 269]), 2: "", 3: "",
            4: reference.decode([49407, 320], skip_special_tokens=False)}
    assert by_text == by_list == want


def test_op6_query(spark, reference, tmp_path):
    rows = [(i, t) for i, t in enumerate(samples())] + [(None, "null id"), (1, "twice")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for d, text in rows:
        ids = reference.encode(text or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(reference.decode(ids, skip_special_tokens=False))))
    got = queries.queries()["op6_bpe"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans():
    rng = random.Random(6)
    for alphabet in ("ab@@..-+ 0123 (5)", "0123456789 -.+x", "a@b.c %_"):
        for _ in range(4000):
            text = "".join(rng.choices(alphabet, k=rng.randint(1, 60)))
            assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("a" * 200_000 + "@") == [] and pii.base_spans("1" * 200_000) == []


def test_proposals_are_whole():
    token = "eyJhbGciOiJIUzI1NiJ9." + "aB3_" * 100
    for text, kind, span in ((f"token={token} end", "secret", token), (f"x {'0a1b' * 50} y", "secret", "0a1b" * 50),
                             (f"token:{token},bob@x.org", "secret", token + ","),
                             (f"mail {'bob.' * 40}b (at) x (dot) org", "email", f"{'bob.' * 40}b (at) x (dot) org")):
        found = [text[s:e] for k, s, e in pii.proposals(text, pii.base_spans(text)) if k == kind]
        assert found == [span]
    for text in ("0a" * 100_000 + "z", "a" * 200_000 + " at ", "a:" * 100_000, "a(at)" * 50_000,
                 "Aa " * 60_000, "A" + "a" * 200_000, "1 " + "Aa " * 60_000, "AB12 " * 40_000, "pwd is " * 30_000):
        pii.proposals(text, [])


def test_personal_data(docs):
    rows = [(1, "mail bob@x.org or +1 (555) 555-1234, ip 10.0.0.1, card 4111 1111 1111 1111"), (2, None), (3, ""),
            (4, "ÄÖ 😀 bob@x.org"), (None, "token = \"3f95017526fc608ad71587f8ea5418b66ff2e6d3\""), (4, "ÄÖ 😀 bob@x.org")]
    rows += [(100 + i, f"key = AKIA{i:04d}ABCDEFGHIJKL and user{i}@mail.com") for i in range(50)]
    got = {(r["doc_id"]): r for r in pii.personal_data(docs(rows)).collect()}
    assert got[1]["spans"] == ",".join(f"{k}:{s}:{e}" for k, s, e in plain_spans(rows[0][1]))
    assert (got[2]["spans"], got[3]["n_email"], got[4]["spans"]) == ("", 0, "email:5:14")
    assert got[107]["spans"] == "email:31:45,secret:6:26"
    assert "secret" in got[None]["spans"]
    assert pii.personal_data(docs([])).collect() == []


def test_estimation_finds_the_unreliable_labeler():
    rng, rows = random.Random(1), {}
    for _ in range(4000):
        true = rng.random() < 0.5
        marks = "".join(str(int(true if rng.random() < p else not true)) for p in (0.95, 0.95, 0.9, 0.5, 0.9))
        rows[marks] = rows.get(marks, 0) + 1
    likely = pii.estimate([("secret", m, False, n) for m, n in rows.items()])
    assert likely["secret", "11101", False] > 0.9 and likely["secret", "00010", False] < 0.1


def test_estimation_of_two_ways_to_be_true():
    """Keys known by their form and passwords known by the word before them, with nothing false among them."""
    likely = pii.estimate([("secret", "11211", False, 370), ("secret", "12111", False, 370), ("secret", "02111", False, 410),
                           ("secret", "02200", False, 5)])
    assert min(likely["secret", m, False] for m in ("11211", "12111", "02111")) > 0.8
    assert likely["secret", "02200", False] < 0.3


def planted(rng):
    """(text, kind, span): one thing of each kind in a sentence of its own."""
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    def iban():
        bank = digits(18)
        check = 98 - int(bank + "131400") % 97
        plain = f"DE{check:02d}{bank}"
        return rng.choice([plain, " ".join(plain[i:i + 4] for i in range(0, 22, 4))])
    def identity():
        number = rng.randrange(10**8)
        return rng.choice([f"{rng.randrange(1, 600):03d}-{rng.randrange(1, 99):02d}-{rng.randrange(1, 9999):04d}",
                           f"{number:08d}{'TRWAGMYFPDXBNJZSQVHLCKE'[number % 23]}"])
    name = f"{rng.choice(['Jane', 'Carlos', 'Dr. Hannah', 'Mr. Peter'])} {letters(1).upper()}{letters(6)}"
    street = f"{rng.randrange(1, 900)} {letters(1).upper()}{letters(5)} {rng.choice(['Street', 'Avenue', 'Road'])}"
    spans = {"iban": iban(), "id": identity(), "name": name, "street": street, "secret": f"{letters(5)}{digits(4)}{letters(3)}",
             "email": f"{letters(6)} (at) {letters(5)} (dot) com", "phone": f"({digits(3)}) 555-{digits(4)}"}
    frames = {"iban": "please pay to account {} by then", "id": "the ssn or dni is {} as told", "name": "my name is {} and so on",
              "street": "she lives at {} since then", "secret": "my password is {} for now", "email": "write to {} or not",
              "phone": "call {} at night"}
    return [(frames[k].format(v), k, v) for k, v in spans.items()]


def test_recall_by_kind_and_clean_documents(docs):
    rng = random.Random(9)
    wanted = [p for _ in range(60) for p in planted(rng)]
    clean = ["The password is required, my token was lost.", "In 2019 the Main Street shops grew by 12 percent.",
             "Version 1.2.3 of AB12 3456 EFGH came out on Monday.", "Call me when the River Bank floods: room 404, page 12-34.",
             "order 123-456-78 and DE12 3456 7890 1234 5678 90 are numbers", "the quick brown fox jumps over the lazy dog"]
    rows = [(i, t) for i, (t, _, _) in enumerate(wanted)] + [(10_000 + i, t) for i, t in enumerate(clean * 40)]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs(rows)).collect()}
    found = {}
    for i, (text, kind, span) in enumerate(wanted):
        at = text.index(span)
        found.setdefault(kind, []).append(f"{kind}:{at}:{at + len(span)}" in got[i].split(","))
    assert {k: np.mean(v) for k, v in found.items() if np.mean(v) < 0.95} == {}
    assert {t: got[10_000 + i] for i, t in enumerate(clean) if got[10_000 + i]} == {}


def test_check_digits():
    assert pii.iban_holds("DE89370400440532013000") and pii.iban_holds("GB82 WEST 1234 5698 7654 32")
    assert not pii.iban_holds("DE88370400440532013000")
    assert pii.id_holds("12345678Z") and not pii.id_holds("12345678A")
    assert pii.id_holds("123-45-6789") and not pii.id_holds("666-45-6789") and not pii.id_holds("123-00-6789")
    text = "pwd is hunter2secret, Jane Doe, 12 Main Street, IBAN DE89370400440532013000 AND SSN 123-45-6789"
    assert [(k, text[s:e]) for k, s, e in pii.proposals(text, [])] == [
        ("secret", "hunter2secret"), ("name", "Jane Doe"), ("street", "12 Main Street"), ("iban", "DE89370400440532013000"),
        ("id", "123-45-6789")]


def labelled(spark, docs, make, n=600, seed=0, name="toxic"):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        y = rng.random() < 0.4
        rows.append((i, make(rng, y)))
        marks.append((i, int(y)))
    return docs(rows), spark.createDataFrame(marks, f"doc_id long, {name} int"), dict(marks)


def accuracy(scored, marks):
    held = [r for r in scored.collect() if r["held_out"] and r["doc_id"] in marks]
    assert all(0 <= r["score"] <= 1 for r in held)
    return np.mean([r["predicted"] == marks[r["doc_id"]] for r in held])


def test_toxicity_learns_pairs_of_terms(spark, docs):
    """Neither word alone is toxic, both together are; sums of weights cannot part these."""
    def make(rng, y):
        words = [f"f{rng.randint(0, 80)}" for _ in range(12)]
        both = [("fool", "group")] if y else [("fool",), ("group",), ()]
        words += rng.choice(both)
        rng.shuffle(words)
        return " ".join(words)
    table, labels, marks = labelled(spark, docs, make, 1500)
    assert accuracy(toxicity.toxicity(table, labels), marks) >= 0.95


def test_toxicity_learns_pairs_among_many_terms(spark, docs):
    """The four words of the pairs are as common in either class, and 6000 other words beside them."""
    rng = random.Random(5)
    others = ["".join(rng.choices("bcdfghjklmnpqrstvwxz", k=5)) for _ in range(6000)]

    def make(rng, y):
        words = rng.choices(others, k=40)
        words += rng.choice([("group", "fool"), ("folks", "scum")] if y else [("group", "scum"), ("folks", "fool")])
        rng.shuffle(words)
        return " ".join(words)
    table, labels, marks = labelled(spark, docs, make, 1500)
    assert accuracy(toxicity.toxicity(table, labels), marks) >= 0.95


def test_toxicity_of_odd_tables(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = docs([(1, None), (2, ""), (None, "x"), (3, "z " * 100_000)])
    assert [r["predicted"] for r in toxicity.toxicity(odd, none).collect()] == [0] * 4
    assert toxicity.toxicity(docs([]), none).collect() == []
    one = spark.createDataFrame([(i, 1) for i in range(9)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.toxicity(odd, one).count() == 4


def test_quality(spark, docs):
    def make(rng, good):
        if good:
            return " ".join(rng.choice(["the", "river", "runs", "over", "stone", "and", "light"]) + str(rng.randint(0, 9))
                            for _ in range(60))
        return " ".join(rng.choice(["BUY!!", "NOW!!", "CLICK!!", "$$$", "WIN!!"]) + str(rng.randint(0, 9)) for _ in range(60))
    table, labels, marks = labelled(spark, docs, make, 400, name="quality")
    assert accuracy(quality.quality(table, labels), marks) >= 0.95


def test_quality_of_long_texts(spark, docs):
    """The words tell, whatever the length: long texts are not matched with themselves only."""
    def make(rng, y):
        words = [f"{'good' if y else 'poor'}{rng.randint(0, 400)}x" for _ in range(rng.choice([8, 40, 2500]))]
        return " ".join(words)
    table, labels, marks = labelled(spark, docs, make, 500, name="quality")
    assert accuracy(quality.quality(table, labels), marks) >= 0.97


def test_quality_query_recomputed(spark, sf_dir):
    """The registered query's rows from the fitted dictionaries and weights by a plain loop over all documents."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    model = quality.fit(read("documents"), read("labels").select("doc_id", "quality"))
    mean, scale, weights = model.calibration
    sizes = lambda t, d: sum(len(zstandard.ZstdCompressor(
        level=3, dict_data=zstandard.ZstdCompressionDict(d)).compress(t[i:i + 1024])) for i in range(0, len(t), 1024))
    name = next(n for n in queries.queries() if n.startswith("op10_"))
    got = {r["doc_id"]: r for r in queries.queries()[name](spark, sf_dir).collect()}
    texts = read("documents").select("doc_id", "text").collect()
    assert len(got) == len(texts)
    for doc_id, text in texts:
        t = (text or "").encode()
        gap = (sizes(t, model.bad) - sizes(t, model.good)) / len(t) if t else 0.0
        x = [gap, *(max(gap - b, 0.0) for b in model.bends)]
        logit = weights[-1] + sum(w * (v - m) / s for w, v, m, s in zip(weights, x, mean, scale))
        score = 1 / (1 + math.exp(-max(min(logit, 30), -30)))
        row = got[doc_id]
        assert row["score"] == pytest.approx(score, abs=1e-9)
        assert row["predicted"] == int(row["score"] >= 0.3)
        assert row["held_out"] == (zlib.crc32(str(doc_id).encode()) % 5 == 0)


def test_toxicity_query_recomputed(spark, sf_dir):
    """The registered query's rows from the fitted weights, every pair of a text's terms multiplied out."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    machine = toxicity.fit(read("documents"), read("labels").select("doc_id", "toxic"))
    name = next(n for n in queries.queries() if n.startswith("op7_"))
    got = {r["doc_id"]: r for r in queries.queries()[name](spark, sf_dir).collect()}
    texts = read("documents").select("doc_id", "text").collect()
    assert len(got) == len(texts)
    for doc_id, text in texts:
        _, bins = toxicity.term_bins(pa.array([text or ""]))
        slots = machine.slot[bins]
        slots = slots[slots >= 0]
        vectors = machine.factors[slots].astype(float)
        products = np.triu(vectors @ vectors.T, 1).sum()
        logit = machine.bias + machine.weights[slots].astype(float).sum() + products
        row = got[doc_id]
        assert row["score"] == pytest.approx(1 / (1 + math.exp(-max(min(logit, 30), -30))), abs=1e-4)
        assert row["predicted"] == int(row["score"] >= 0.5)
        assert row["held_out"] == (zlib.crc32(str(doc_id).encode()) % 5 == 0)


def test_quality_of_odd_tables(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    odd = docs([(1, None), (2, ""), (None, "x"), (3, "z " * 100_000)])
    assert [r["score"] for r in quality.quality(odd, none).collect()] == [0.5] * 4
    assert quality.quality(docs([]), none).collect() == []
