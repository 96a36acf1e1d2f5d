import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, key string, spans string, score double"


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with nulls, empty and blank ones, exact and near copies, shared passages, a long one and a repetitive one."""
    rnd = random.Random(3)
    base = words(rnd, 120).split(" ")
    passage = words(rnd, 90)
    out = [None, "", " \n\t ", "one", "one two", "One TWO", "é ß 日本 \U0001f600 naïve", " ".join(base), " ".join(base), "  " + " ".join(base).upper() + "\n"]
    for i in range(12):
        near = list(base)
        for _ in range(1 + i % 4):
            near[rnd.randrange(len(near))] = words(rnd, 1)
        out.append(" ".join(near))
    out += [words(rnd, 40) + " " + passage + " " + words(rnd, rnd.randint(5, 60)) for _ in range(5)]
    out += ["ab" * 900, "ab" * 700, words(rnd, 6000), "x" * 399, "y" * 400, "y" * 401]
    out += [words(rnd, rnd.randint(1, 80)) for _ in range(30)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With columns whose names the operators use themselves."""
    rows = [(i, t, "en", "s", len(t or ""), "k", "p", 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
