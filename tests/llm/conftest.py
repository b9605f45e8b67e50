import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, kept string, k long, label int, t1 long, slot int"


def rows_of(pairs, lang="en", source="s"):
    """(doc_id, text) pairs with the other columns of documents and some whose names operators use themselves."""
    return [(i, t, lang, source, None if t is None else len(t), "r", "i", "k", 1, 2, 3, 4) for i, t in pairs]


@pytest.fixture(scope="session")
def frame(spark):
    def make(pairs, **other):
        return spark.createDataFrame(rows_of(pairs, **other), SCHEMA)

    return make


@pytest.fixture(scope="session")
def messy():
    """Nulls, empty, blank and very long texts, ties and repeated rows."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(60) for _ in range(8)]
    long = text(40_000)
    pairs = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "###"), (None, base[0]), (None, None), (6, base[0]), (6, base[0]), (7, base[0].upper()),
             (8, base[1]), (9, base[1] + " tail"), (10, long), (11, long + " end"), (12, base[2] + "\n" + base[3]), (13, base[3] + "\n" + base[4])]
    pairs += [(20 + i, t) for i, t in enumerate(base)] + [(40 + i, text(rnd.randint(1, 80))) for i in range(20)]
    return pairs
