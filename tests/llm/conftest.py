"""Odd documents: nulls, blanks, long texts, repeated rows, columns with clashing names."""

import random

import pytest

CLASHES = "n_words long, score double, row long, key string, words string, text_key string, places string, n long, kept boolean, f_id long, size long, unit string, bucket int, rare string"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(3)
    return ["".join(rng.choice(["tion", "er", "re", "th", "éa", "on", "an"]) for _ in range(rng.randint(1, 3))) for _ in range(3000)]


@pytest.fixture(scope="session")
def odd_rows(words):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    base = say(120).split(" ")
    near = list(base)
    near[7] = "changed"
    far = list(base)
    for i in range(0, 120, 9):
        far[i] = f"other{i}"
    rows = [
        (0, None, None), (1, "", "en"), (2, " \n\t ", None), (3, "one two three", "en"), (4, "One TWO three", "en"), (5, "\x1c\x1d a b c", "fr"),
        (6, " ".join(base), "en"), (7, " ".join(near), "en"), (8, " ".join(far), "de"), (9, " ".join(base).upper(), "en"), (9, " ".join(base), "en"), (9, " ".join(base), "en"),
        (10, "😀 日本語 ▁ İKſ", None), (11, "x" * 5000, "en"), (12, say(20000), "en"), (None, say(30), "en"), (13, "a b c d", "en"), (14, "a b c d e", "en"),
        (15, "line one here.\nline one here.\n\n | nav | bar |\nMIT License\nmit  license", "en"),
    ]
    rows += [(100 + i, say(rng.randint(5, 60)), rng.choice(["en", "de"])) for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    blank = [None] * len(CLASHES.split(","))
    return spark.createDataFrame([(*r, *blank) for r in odd_rows], "doc_id long, text string, lang string, " + CLASHES).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
