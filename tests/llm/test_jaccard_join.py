import random
import re

import numpy as np

from geoping.llm import jaccard_join as J


def brute(pairs, percent=80):
    sets = []
    for _, t in pairs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    head = list(range(len(pairs)))

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                head[root(i)] = root(j)
    groups = {}
    for i in range(len(pairs)):
        groups.setdefault(root(i), []).append(pairs[i][0])
    low = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return [(pairs[i][0], len(sets[i]), low[root(i)]) for i in range(len(pairs))], len([g for r, g in groups.items() if sets[r]])


def check(frame, pairs):
    out = J.jaccard_join(frame(pairs), ["doc_id", "row", "label"]).select("row.doc_id", "n_shingles", "component_id", "leads").collect()
    exp, n_groups = brute(pairs)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r)[:3] for r in out), key=key) == sorted(exp, key=key)
    assert sum(r.leads for r in out if r.n_shingles) == n_groups


def chains(seed, size=60):
    """Families whose members drift: neighbours link, others meet in the same region without linking."""
    rnd = random.Random(seed)
    out = []
    for f in range(6):
        words = [f"f{f}w{i}" for i in range(size)]
        for m in range(14):
            out.append((1000 * f + m, " ".join(words)))
            for _ in range(rnd.choice((1, 1, 2, 3))):
                words[rnd.randrange(len(words))] = f"n{rnd.random()}"
    rnd.shuffle(out)
    return out


def test_matches_brute_force(frame, messy):
    rnd = random.Random(2)
    base = [f"b{i}" for i in range(80)]
    region = []
    for i in range(70):  # a common passage and a body of its own: many in one region, few links
        own = [f"o{i % 35}x{j}" for j in range(rnd.choice((6, 10, 14, 20)))]
        region.append((9000 + i, " ".join(base[:70] + own)))
    check(frame, messy + chains(1) + region + chains(3, 30))


def test_small_units(frame, monkeypatch):
    monkeypatch.setattr(J, "UNIT", 200)
    monkeypatch.setattr(J, "BLOCK_BYTES", 2000)
    check(frame, chains(5))


def test_empty_table(frame):
    assert J.jaccard_join(frame([]), ["doc_id"]).collect() == []


def test_words_that_a_polynomial_hash_confuses(frame):
    """Thue-Morse words of two letters, the letters swapped: no polynomial modulo 2**64 tells them apart."""
    for length in (1024, 4096):
        morse = "".join("ab"[bin(k).count("1") % 2] for k in range(length))
        other = morse.translate(str.maketrans("ab", "ba"))
        docs = frame([(1, morse), (2, other), (3, morse), (4, f"{morse} x y z u"), (5, f"{other} x y z u")])
        got = {r.row.doc_id: r.component_id for r in J.jaccard_join(docs, ["doc_id"]).collect()}
        assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_sketches_lose_no_link_and_hold_unlinked_sets_back():
    rnd = np.random.default_rng(7)
    for size in (3, 20, 64, 65, 130, 700):
        base = rnd.integers(1, 1 << 63, size * 2, dtype=np.uint64)
        sets = [base[:size], *(np.concatenate((base[:size - k], base[size:size + k])) for k in rnd.integers(0, size // 4 + 1, 12)), base[:size - size // 10]]
        sets += [rnd.integers(1, 1 << 63, size, dtype=np.uint64) for _ in range(6)]
        sets = [np.unique(s) for s in sets]
        n = np.array([len(s) for s in sets])
        link = np.array([[i != j and 100 * len(c := np.intersect1d(a, b)) >= 80 * (len(a) + len(b) - len(c)) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
        sketches = [J.sketch(s) for s in sets]
        for label, own in ((np.arange(len(n)), np.zeros(len(n), int)), (np.arange(len(n)) % 3, np.arange(len(n)) % 2), (np.arange(len(n)) % 5, np.arange(len(n)) // 10)):
            may = J.may_link(n, sketches, label, own, 80)
            apart = (label[:, None] != label) & ((own[:, None] != own) | (own == own[0]).all())
            assert not ((link & apart).any(axis=1) & ~may).any()
            assert size < 64 or not may[-6:].any()


def test_only_sets_that_may_link_travel(frame, monkeypatch):
    """A common passage in many texts: all are in one region, and none links to another."""
    seen = []
    places = J._places
    monkeypatch.setattr(J, "_places", lambda pairs, members: seen.append(pairs.count()) or places(pairs, members))
    passage = " ".join(f"b{i}" for i in range(300))
    docs = [(i, passage + " " + " ".join(f"o{i}x{j}" for j in range(60))) for i in range(40)]
    docs += [(100 + i, t.replace(f"o{i}x59", "changed")) for i, t in docs[:5]]
    check(frame, docs)
    assert sum(seen) <= 20
