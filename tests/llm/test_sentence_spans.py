import random

import numpy as np
import pytest

from geoping.llm.sentence_spans import MIN_WORDS, PIECE, SPAN, _sentences, sentence_dedup


def sentences(text):
    raw, out, start = text.encode(), [], 0
    for i, b in enumerate(raw):
        nxt = raw[i + 1] if i + 1 < len(raw) else 0
        if b == 10 or (b in b".!?" and nx_blank(nxt)) or i == len(raw) - 1:
            out.append(raw[start:i + 1])
            start = i + 1
    done, carry = [], b""
    for s in out:
        carry += s
        if s.split():
            done.append(carry)
            carry = b""
    return done, carry


def nx_blank(b):
    return b in (32, 9)


def brute(pairs):
    """Spans are first in the order of ids (nulls last); rows of one id never remove each other's."""
    last = 1 << 63
    parts = [(last if i is None else i, *sentences(t or "")) for i, t in pairs]
    spans = [[tuple(tuple(bytes(s).lower().split()) for s in own[k:k + SPAN]) for k in range(len(own) - SPAN + 1)] for _, own, _ in parts]
    head = {}
    for (i, _, _), own in zip(parts, spans, strict=True):
        for s in own:
            head[s] = min(head.get(s, i), i)
    out = []
    for (i, own, tail), mine, (doc, text) in zip(parts, spans, pairs, strict=True):
        drop, seen = set(), set()
        for k, s in enumerate(mine):
            if head[s] < i or s in seen:
                drop |= set(range(k, k + SPAN))
            seen.add(s)
        kept = None if text is None else (b"".join(s for k, s in enumerate(own) if k not in drop) + tail).decode()
        out.append((doc, len(own), len(drop), kept))
    return out


def check(frame, pairs):
    got = [(r.doc_id, r.n_sentences, r.n_removed, r.kept) for r in sentence_dedup(frame(pairs), ["doc_id", "row", "id"]).select("row.doc_id", "n_sentences", "n_removed", "kept").collect()]
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(got, key=key) == sorted(brute(pairs), key=key)


def test_matches_brute_force(frame, messy):
    a = "One two. Three four! Five six? Seven.\nEight nine. "
    pairs = [p for p in messy if len(p[1] or "") < 5000]
    pairs += [(300, a * 2), (299, "Lead in here. " + a.upper() + "And out."), (301, a), (301, a), (302, "x.\n\n\ny. . . z"), (303, a[:20]), (None, a), (304, "Three four! Five six? Seven.")]
    check(frame, pairs)


def test_empty_table(frame):
    assert sentence_dedup(frame([]), ["doc_id"]).collect() == []


@pytest.mark.parametrize("stops", ["", ".", ".”", "mixed", "same", "cjk"])
def test_every_passage_of_51_words_goes_but_for_its_ends(frame, stops):
    rnd = random.Random(stops)
    fresh = iter(rnd.sample(range(0x4E00, 0xA000), 20_000))

    def text(n, tag):
        out = []
        for _ in range(n):
            word = chr(next(fresh)) if stops == "cjk" else f"{tag}{next(fresh)}"
            end = {"mixed": ["", "", "", ".", "!)", "?\"", "\n"], "cjk": ["", "", "", "", "", "。"], "same": [""]}.get(stops, [""] * 19 + [stops])
            out.append(word + rnd.choice(end))
        return out

    joint = "" if stops == "cjk" else " "
    pairs, passages = [], []
    for k in range(60):
        passage = text(51, "p")
        if stops == "same":
            passage = [rnd.choice(("to", "be", "or")) for _ in range(51)]
        for copy in range(2):
            before, after = text(rnd.randrange(40), "a"), text(rnd.randrange(40), "z")
            pairs.append((2 * k + copy, joint.join(before + passage + after)))
            passages.append((before, passage, after))
    got = {r.doc_id: r.kept for r in sentence_dedup(frame(pairs), ["doc_id"], min_words=MIN_WORDS).select("row.doc_id", "kept").collect()}
    for (doc, whole), (before, passage, after) in zip(pairs, passages, strict=True):
        if doc % 2:
            kept = got[doc]
            if stops == "same":
                assert len(kept.split()) <= len(before) + len(after) + 2 * PIECE - 1
            else:
                assert not any(w in kept.split() if joint else w in kept for w in passage[PIECE:len(passage) - PIECE + 1])
                assert all(w.strip() in kept for w in before[:-PIECE])  # what is not shared stays
        elif stops != "same":
            assert got[doc] == whole


def test_sentences_end_at_stops_of_other_scripts_and_after_closers():
    text = 'He said "go." Then (left!) he… went. 他走了。「好！」她说？نعم؟ ठीक। end'
    raw = np.frombuffer(text.encode(), np.uint8)
    ends = _sentences(np.array([0, len(raw)]), raw)
    got = [raw[a:b].tobytes().decode().strip() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    assert got == ['He said "go."', "Then (left!)", "he…", "went.", "他走了。", "「好！」", "她说？", "نعم؟", "ठीक।", "end"]
