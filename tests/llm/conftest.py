import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, block string"


def words(r, n):
    return " ".join(r.choice(["the", "of", "and", "tion", "Ere", "ounds", "été", "über", "x1"]) + r.choice(["", "a", "en", "ly"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, near copies, shared passages, odd spaces, nulls in any column, and columns with clashing names."""
    r = random.Random(3)
    base = [words(r, n) for n in (3, 5, 36, 60, 90, 120, 200, 400)]
    passage = words(r, 60)
    texts = [None, "", "   \n\t ", "one", "1234 !!", *base, *base[3:], base[5] + " more words here", " ".join(base[6].split()[5:]), base[4].upper(), base[2] + " " + passage, passage + " " + base[7], passage + " \n" + words(r, 30), passage.replace(" ", "\n"), base[3] + " " + base[3], "a " * 300, "日本語 テキスト　全角", "x" * 5000]
    out = [(i, t, ["en", "de", None][i % 3], ["b", "a", None, ""][i % 4], None if t is None else len(t), 7, 0.5, "z") for i, t in enumerate(texts)]
    return [*out, (None, base[6], "en", "a", 1, 1, 1.0, None), out[8], out[8]]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
