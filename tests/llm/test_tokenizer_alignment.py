import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from geoping.llm import tokenizer_alignment as op

A, B = f"{op.TOKENIZERS}/byte_bpe_50k.json", f"{op.TOKENIZERS}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def plain():
    """Both tokenizers on whole texts: (id, bytes) of every token."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}

    def tokens(text):
        left = [(k, bytes(byte_of[c] for c in a.id_to_token(k))) for k in a.encode(" " + text, add_special_tokens=False).ids]
        right = []
        for k in b.encode(text):
            piece = b.id_to_piece(k)
            right.append((k, bytes([int(piece[3:5], 16)]) if b.is_byte(k) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        same = b"".join(x for _, x in left) == whole == b"".join(x for _, x in right)
        return (left, right) if text and same else ([], [])

    return tokens


def spans(tokens):
    at, out = 0, []
    for k, x in tokens:
        out.append((at, at + len(x), k))
        at += len(x)
    return out


def brute(pairs, tokens):
    docs, count = [], Counter()
    for i, text in pairs:
        left, right = (spans(x) for x in tokens(text or ""))
        links = [(p, q) for lo, hi, p in left for x, y, q in right if max(lo, x) < min(hi, y)] if len(left) < 500 else []
        if len(left) >= 500:  # the same, by merging
            j = 0
            for lo, hi, p in left:
                while right[j][1] <= lo:
                    j += 1
                k = j
                while k < len(right) and right[k][0] < hi:
                    links.append((p, right[k][2]))
                    k += 1
        count.update(set(links))
        cuts = sorted({hi for _, hi, _ in left} & {hi for _, hi, _ in right})
        groups = []
        for lo, hi in zip([0, *cuts], cuts, strict=False):
            groups.append("|".join(",".join(str(k) for x, y, k in side if lo <= x and y <= hi) for side in (left, right)))
        docs.append((i, len(left), len(right), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if left else ""))
    most = defaultdict(int)
    for (p, _), n in count.items():
        most[p] = max(most[p], n)
    return sorted(((i, a, b, g, len(links), sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links), sha) for i, a, b, g, links, sha in docs), key=repr)


def found(docs, **how):
    rows = op.tokenizer_alignment(docs, docs.columns, A, B, **how).collect()
    return sorted(((r.row.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows), key=repr)


ODD = ["a", " ", "  ", " a", "a ", "a  b", "end \n\n  x\ty ", "it's we'll  they've'", "<|endoftext|> <s></s> <unk> <0x41>", "▁", "a▁ b", "  x  y　 z\u0085 w", "naïve café — “q”",
       "日本語 の 文章です", "𝒳 😀😀 x", "\x00 \x01 a\x7f b", "1234567 89 3.14", "é ﬁ Å", "\r\n \r\n", "." * 200, " " * 77, "  a​ b"]


def test_words_apart_equal_whole_texts(plain):
    """Cutting at blanks changes no token: random mixtures of everything that has rules of its own."""
    files = [open(p, "rb").read() for p in (A, B)]
    aligner = op.Aligner(*files)
    assert aligner.cuts
    rnd = random.Random(5)
    bits = ["the", "Was", "über", "'s", "'ll", ".", ",", "!!", "12", "\n", "\t", " ", " ", " ", "  ", " ", "　", " ", "é", "日本", "😀", "<s>", "x" * 30, "\x1f", "\x85"]
    for text in ODD + ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 25))) for _ in range(3000)]:
        raw = np.frombuffer((" " + text).encode(), np.uint8)
        edges = [*op._edges(np.array([0, len(raw)]), raw, True).tolist(), len(raw)]
        parts = [raw[x:y].tobytes() for x, y in zip(edges, edges[1:], strict=False)]
        got = aligner.words(list(dict.fromkeys(parts)))
        by = dict(zip(dict.fromkeys(parts), got, strict=True))
        left, right = plain(text)
        if left:
            assert sum(by[p][0] for p in parts) == len(left) and sum(by[p][1] for p in parts) == len(right), repr(text)
            one = brute([(1, text)], plain)[0]
            assert hashlib.sha256(b";".join(by[p][3] for p in parts)).hexdigest() == one[-1], repr(text)
        else:
            assert any(by[p][3] is None for p in parts), repr(text)


def test_brute_force(frame, messy, plain):
    pairs = [(i, t if t is None else t[:20_000]) for i, t in messy] + list(enumerate(ODD, 500))
    expect = brute(pairs, plain)
    assert found(frame(pairs)) == expect
    # many small runs, few partitions: the same
    assert found(frame(pairs).repartition(5), run_bytes=300, parts=3) == expect


def test_a_pair_in_every_document(frame, plain):
    pairs = [(i, "the same " * (1 + i % 5) + str(i)) for i in range(3000)]
    got = found(frame(pairs), run_bytes=2000, parts=8)
    assert got == brute(pairs, plain)


def test_heap_merge():
    rnd = np.random.default_rng(6)
    runs = [(np.unique(rnd.integers(0, 50_000, n)), None) for n in (0, 1, 10, 20_000, 30_000, 9000)]
    runs = [(k, rnd.integers(1, 9, len(k))) for k, _ in runs]
    total = Counter()
    for k, c in runs:
        for x, y in zip(k.tolist(), c.tolist(), strict=True):
            total[x] += y
    keys, counts = op._merged(runs)
    assert list(zip(keys.tolist(), counts.tolist(), strict=True)) == sorted(total.items())


def test_empty_table_other_names_and_broken_bytes(spark, frame):
    assert op.tokenizer_alignment(frame([]), ["doc_id"], A, B).collect() == []
    docs = spark.createDataFrame([("x y", 1), ("x z", 2)], "`a.text` string, part int")
    rows = op.tokenizer_alignment(docs, ["part"], A, B, text_col="a.text").collect()
    assert {r.row.part: r.n_links for r in rows} == {1: 2, 2: 2}
    broken = spark.createDataFrame([(1, bytearray(b"ok \xff\xfe no")), (2, bytearray(b"fine"))], "doc_id int, text binary")
    rows = {r.row.doc_id: (r.n_a, r.groups_sha256) for r in op.tokenizer_alignment(broken, ["doc_id"], A, B).collect()}
    assert rows[1] == (0, "") and rows[2][0] > 0


def test_query(spark, tmp_path, plain):
    pairs = [(i, t) for i, t in enumerate([None, "", "a b c", "a b", "b c d", "a b c"])]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in pairs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = op.op11_tokenizer_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(pairs, plain)
