"""Texts with every odd case: null, empty, blank, ties, repeats, long, clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, score string"


def odd_rows(n=60, seed=1):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice(["an", "er", "the", "ión", "sch", "eau"]) for _ in range(rnd.randint(1, 3))) for _ in range(60)]
    rows = []
    for i in range(n):
        text = " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 120)))
        if i % 5 == 0 and rows:
            text = rows[rnd.randrange(len(rows))][1] + rnd.choice(["", " the", ""])
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, None), (104, "the " * 3000), (None, "an er the an er"), (3, rows[3][1]), (105, "the the\nthe the\n\nthe the"), (106, "één #*| $%& <a>\n\n x"), (107, "123 456")]
    return [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["s0", None]), None, 7, "x") for i, t in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
