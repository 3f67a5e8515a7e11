import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, cls long, h string"


def sentence(rng, n):
    return " ".join("".join(rng.choices(["an", "the", "ti", "on", "é", "re", "sh", "wh"], k=rng.randrange(1, 4))) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def make_docs(seed=0, n=40):
    """Texts with near and exact copies, shared passages, blanks, nulls, odd characters
    and one that is very long; other columns have names that operators use inside."""
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randrange(1, 120)) for _ in range(n)]
    passage = sentence(rng, 70)
    for k in range(6):
        words = texts[k].split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [f"{sentence(rng, 30)} {passage} {sentence(rng, 9)}" for _ in range(5)]
    texts += [texts[3]] * 4 + [None, None, "", "   \n\t ", "x", "a b", "a b", "Ünï 日本語   <|endoftext|> don't", "heat " * 300, "\n\n\n a\n\n b  c \n", sentence(rng, 6000), "A B c D e F g"]
    rows = [(k * 7 % 1009, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s1", "s2", None]), len(t or ""), -1, -1, "x") for k, t in enumerate(texts)]
    rows.append(rows[5])  # a repeated row
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def keyless(spark):
    """Rows without a key, among them copies."""
    t = " ".join(f"w{k}" for k in range(60))
    return spark.createDataFrame([(None, t, None, None, 0, 0, 0, ""), (None, t, None, None, 0, 0, 0, ""), (5, t + " more", "en", "s", 0, 0, 0, ""), (None, None, None, None, None, None, None, None)], SCHEMA)
