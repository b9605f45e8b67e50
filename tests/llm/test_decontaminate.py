import hashlib
import re

from geoping.llm.decontaminate import WuManber, decontaminate, words_of


def brute(text, items):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    hit, found = set(), set()
    for item, test in items:
        seq = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (test or "").encode().lower())
        m = min(13, len(seq))
        tests = {tuple(seq[j:j + m]) for j in range(len(seq) - m + 1)} if m else set()
        for i in range(len(words) - m + 1 if m else 0):
            if tuple(words[i:i + m]) in tests:
                hit.update(range(i, i + m))
                found.add("" if item is None else str(item))
    ids = ",".join(sorted(found))
    return len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def run(spark, frame, docs, items, **options):
    bench = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, n_hit long")
    out = decontaminate(frame(docs), bench, ["doc_id", "row", "kept"], **options)
    return sorted(tuple(r) for r in out.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect() if r.doc_id is not None)


def expected(docs, items):
    return sorted((i, *brute(t, items)) for i, t in docs if i is not None)


def test_matches_brute_force(spark, frame, messy):
    a = " ".join(f"w{i}" for i in range(30))
    items = [(1, a), (2, "Short item"), (3, "one"), (4, None), (5, ""), (None, messy[5][1]), (2, "Short item"), (6, "the end of " + a), (7, "x x x x x x x x x x x x x x x")]
    docs = messy + [(100, "pre " + a[:70] + " post"), (101, "a SHORT, item short item"), (102, a.upper() + " " + a), (103, "x " * 40), (104, "w1 w2 w3")]
    assert run(spark, frame, docs, items) == expected(docs, items)


def test_blocks_of_the_benchmark_give_the_same(spark, frame, messy):
    items = [(i, t) for i, (_, t) in enumerate(messy[5:20])] + [(99, "one")]
    assert run(spark, frame, messy, items, block_bytes=200_000) == run(spark, frame, messy, items) == expected(messy, items)


def test_empty_tables(spark, frame, messy):
    assert run(spark, frame, [], [(1, "a b")]) == []
    assert run(spark, frame, messy, []) == expected(messy, [])


def test_shift_never_passes_an_occurrence():
    words = words_of("a b a b a a b")
    search = WuManber(3, [("x", words_of("a b a a")), ("y", words_of("b a b"))])
    hit, found = bytearray(len(words)), set()
    search.search(words, hit, found)
    assert found == {"x", "y"} and bytes(hit) == b"\x01" * 6 + b"\x00"


def test_long_and_repeated_items_stay_within_a_block(spark, frame):
    """One item is most of the benchmark, another is repeated 500 times: blocks keep their bound, results are the same."""
    from geoping.llm import decontaminate as op

    long = " ".join(f"w{i}" for i in range(4000))
    items = [(1, long)] + [(2, "the very same item of fourteen words that is repeated again and again here")] * 500 + [(3, "short one"), (3, "another text of three")]
    bench = spark.createDataFrame([(str(i), t) for i, t in items], "id string, text string")
    packed = op._packed(bench, 3000)
    sizes = {}
    for r in packed.collect():
        sizes[r.block] = sizes.get(r.block, 0) + len(r.text) + len(r.id) + op._EXTRA
    assert len(sizes) > 5 and max(sizes.values()) <= 2 * 3000 + op._EXTRA
    assert op._packed(bench.repartition(50), 1 << 20).select("block").distinct().count() == 1
    words = long.split()
    docs = [(k, " ".join(words[37 * k:37 * k + 13 + k % 5])) for k in range(100)] + [(200, items[1][1]), (201, "a short one"), (202, "w1 w3 " * 20), (203, " ".join(words[3000:3400]))]
    assert run(spark, frame, docs, items, block_bytes=3000) == expected(docs, items)


def test_names_with_dots(spark, frame):
    bench = spark.createDataFrame([("q", "one two three")], "`item.id` string, `item.text` string")
    got = decontaminate(frame([(1, "zero one two three"), (2, "one")]), bench, ["doc_id"], item_col="item.id", item_text_col="item.text").collect()
    assert sorted((r.row.doc_id, r.n_hit) for r in got) == [(1, 3), (2, 0)]
