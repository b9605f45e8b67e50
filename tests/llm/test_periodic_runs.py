import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoping.llm import periodic_runs as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(words[k] == words[k - q] for k in range(q, len(words))))


def brute_runs(words):
    """By definition: every lag, every stretch that keeps it and that no neighbour extends, its smallest period."""
    runs, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if length >= max(6, 4 * q) and smallest_period(words[start:j]) == q:
                runs.append((start, length, q))
            i = j
    return sorted(runs)


def runs(words):
    names = {w: k for k, w in enumerate(dict.fromkeys(words))}
    at, lag, g = op.matches(np.array([names[w] for w in words], np.int64), np.zeros(len(words), np.int64))
    return op.runs_of(zip(at.tolist(), lag.tolist(), g.tolist(), strict=True))


def fib(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def test_runs_against_the_definition():
    rnd = random.Random(1)
    cases = [list("a" * k) for k in range(12)] + [list("ab" * k) for k in range(8)] + [fib(400), list("aaab" * 30), list(("ha" * 30 + "b") * 6)]
    for _ in range(600):
        n, letters = rnd.randint(1, 120), "abcdefgh"[:rnd.randint(1, 8)]
        words = [rnd.choice(letters) for _ in range(n)]
        if rnd.random() < 0.8:
            for _ in range(rnd.randint(1, 3)):
                a, p = rnd.randrange(n), rnd.randint(1, 12)
                for k in range(a + p, min(n, a + p * rnd.randint(3, 7) + rnd.randint(0, 3))):
                    words[k] = words[k - p]
        cases.append(words)
    for words in cases:
        assert runs(words) == brute_runs(words), words


def test_long_periods_are_found_from_four_on():
    rnd = random.Random(2)
    for q in [*range(1, 60), 200, 777]:
        unit = [str(rnd.random()) for _ in range(q)]
        head = ["x", "y"]
        for length in (4 * q - 1, 4 * q, 5 * q + q // 2):
            words = head + (unit * 6)[:length] + ["z"]
            expect = [(2, length, q)] if length >= max(6, 4 * q) else []
            assert runs(words) == expect, (q, length)


def test_no_step_per_pair_of_occurrences():
    words = ["ha"] * 200_000 + (["ho"] * 300 + ["hi"]) * 300
    began = time.time()
    found = runs(words)
    assert found[0] == (0, 200_000, 1) and (200_000, 90_300, 301) in found and len(found) == 302
    assert time.time() - began < 30


def brute(pairs):
    out = []
    for i, text in pairs:
        words = WORD.findall(text or "")
        own, gone = brute_runs(words), set()
        for start, length, period in own:
            gone |= set(range(start + period, start + length))
        best = max(own, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        out.append((i, len(words), own, best, None if text is None else " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=repr)


def found(docs, **how):
    rows = op.periodic_runs(docs, docs.columns, **how).collect()
    return sorted(((r.row.doc_id, r.n_words, [tuple(x) for x in r.runs], r.best and tuple(r.best), r.kept) for r in rows), key=repr)


def test_operator(frame, messy):
    pairs = [p for p in messy if len(p[1] or "") < 50_000]
    pairs += [(100, "ha\tha\nha ha  ha ha end"), (101, "ha ha ha ha ha"), (102, "a b a b a b a b\va b c"), (103, "é\xa0é é\xa0é é\xa0é é\xa0é é\xa0é é\xa0é"), (103, "1 2 3 " * 5)]
    assert found(frame(pairs)) == brute(pairs)


def test_odd_input(spark, frame, messy):
    assert op.periodic_runs(frame([]), ["doc_id"]).collect() == []
    assert len(found(frame(messy))) == len(messy)
    docs = spark.createDataFrame([("a b " * 4, 1, "r")], "`my.text` string, runs int, row string")
    got = op.periodic_runs(docs, ["runs", "row"], text_col="my.text").collect()
    assert got[0].row.asDict() == {"runs": 1, "row": "r"} and got[0].kept == "a b"


def planted(doc_id, text):
    words, h = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    out = [(i, " ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(1, 90)))) for i in range(400)]
    return out + [(i, t) for i, t in zip(range(400, 500), [None, "", " \n", "one", "\tone two\n"] * 20, strict=True)]


def test_planted_tails(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = docs.select("doc_id", op.with_periodic_tails(F.col("doc_id"), F.col("text")).alias("text")).collect()
    assert all(WORD.findall(r.text or "") == planted(r.doc_id, t) for r, (_, t) in zip(sorted(got), texts, strict=True))
    assert sum(r.text != t for r, (_, t) in zip(sorted(got), texts, strict=True)) > 20


def test_query(spark, tmp_path, texts):
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expect = []
    for i, _, own, best, kept in brute([(i, " ".join(planted(i, t))) for i, t in texts]):
        top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        expect.append((i, len(own), *top, sha("".join(f"{a},{b},{c}\n" for a, b, c in own)), sha(kept)))
    got = op.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expect, key=repr)
    assert sum(r[1] > 0 for r in expect) >= 20
