import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(autouse=True)
def shipped(spark):
    from parcelsight.llm.common import ship

    return ship(spark)


@pytest.fixture()
def docs(spark):
    """A table of documents with clashing and null columns, from (doc_id, text[, source])."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, "x") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, source string, n_chars long, score string")
    return make


@pytest.fixture()
def random_texts():
    """Texts over few words with copies, near copies, shared lines and odd ones."""
    import random

    def make(n, seed=0):
        rng = random.Random(seed)
        words = [f"w{i}" for i in range(400)]
        out = []
        for _ in range(n):
            roll = rng.random()
            if out and roll < 0.2:
                out.append(rng.choice(out))
            elif out and roll < 0.5:
                text = (rng.choice(out) or "").split(" ")
                for _ in range(rng.randint(1, 3)):
                    text[rng.randrange(len(text))] = rng.choice(words)
                out.append(" ".join(text))
            elif roll < 0.53:
                out.append(rng.choice([None, "", " \t\n", "one", "One two", "a b c d", " ", "ÄÖ ß"]))
            else:
                out.append("\n".join(" ".join(rng.choices(words, k=rng.randint(3, 12)))
                                     for _ in range(rng.randint(1, 5))))
            if rng.random() < 0.3:
                out[-1] = (out[-1] or "") + "\n The Shared line of all \n"
        return out
    return make
