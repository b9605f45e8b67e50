import random

import numpy as np
import pytest

from geoping.llm.suffix_dedup import _digests, as_text, brute_force, cover, shift_table, suffix_dedup


def check(frame, pairs, **options):
    got = _digests(suffix_dedup(frame(pairs), ["doc_id", "row", "kept"], **options)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    exp = [(i, *e) for (i, _), e in zip(pairs, brute_force([t for _, t in pairs], options["min_bytes"]), strict=True)]
    assert sorted(map(tuple, got), key=key) == sorted(exp, key=key)


def shared(seed):
    rnd = random.Random(seed)
    words = ["ab", "cde", "é", "x", "yyz "]
    bits = ["".join(rnd.choice(words) for _ in range(rnd.randint(5, 60))) for _ in range(10)]
    one = lambda: rnd.choice(bits)[rnd.randint(0, 5):] if rnd.random() < .6 else "".join(rnd.choice(words) for _ in range(30))
    return [(i if i % 7 else None, "".join(one() for _ in range(rnd.randint(1, 6)))) for i in range(80)]


@pytest.mark.parametrize("hot", [1 << 16, 3])
def test_matches_brute_force(frame, messy, hot):
    pairs = [p for p in messy if len(p[1] or "") < 5000] + shared(1) + [(200, "a" * 300), (201, "a" * 90), (202, "ab" * 100)]
    check(frame, pairs + pairs[:9], min_bytes=40, hot=hot, block_bytes=2000)


def test_long_texts_are_cut_whole(frame, messy):
    rnd = random.Random(3)
    part = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    filler = lambda n: "".join(rnd.choice("ABCDEFGHIJ ") for _ in range(n))
    long = filler(5_000_000) + part + filler(1_000_000)
    got = {r.doc_id: r for r in _digests(suffix_dedup(frame([(1, long), (2, filler(500) + part), (3, None)]), ["doc_id"])).collect()}
    assert (got[1].n_removed, got[1].n_spans, got[2].n_removed, got[3].n_bytes) == (3000, 1, 3000, 0)


def test_empty_table_and_cut_characters(frame):
    assert suffix_dedup(frame([]), ["doc_id"]).collect() == []
    a = "é" * 30
    out = as_text(suffix_dedup(frame([(1, "x" + a + "yé"), (2, "z" + a)]), ["doc_id"], min_bytes=35))
    assert all("�" not in r.kept_text for r in out.collect())


def test_cover_reaches_every_pair():
    for limit in (16, 100, 200, 400):
        v, residues = cover(limit)
        inside = np.zeros(v, bool)
        inside[residues] = True
        a, b = np.meshgrid(range(v), range(v), indexing="ij")
        t = shift_table(v, residues)
        assert inside[(a + t) % v].all() and inside[(b + t) % v].all() and t.max() < v <= limit
