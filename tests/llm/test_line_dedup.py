import hashlib
from collections import defaultdict

import duckdb
import pyarrow as pa
import pytest

from geoping.llm import line_dedup as op

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def key_of(line):
    return line.strip(BLANKS).translate(LOWER)


def brute(pairs, min_chars=20, min_docs=3):
    order = lambda i: (i is not None, i or 0)
    holders = defaultdict(set)
    for i, text in pairs:
        for line in (text or "").split("\n"):
            holders[key_of(line)].add(order(i))
    out = []
    for i, text in pairs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key_of(x)) < min_chars or len(holders[key_of(x)]) < min_docs or max(holders[key_of(x)]) == order(i)]
        out.append((i, len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept)))
    return sorted(out, key=repr)


def found(docs, **how):
    return sorted(((r.row.doc_id, r.n_lines, r.n_dropped, r.kept) for r in op.line_dedup(docs, docs.columns, **how).collect()), key=repr)


LINE = "A line that Many documents share"
CASES = [
    (1, f"{LINE}\nown one"), (2, f"  {LINE.lower()}\t\r\n{LINE}\nx"), (3, f"y\n\v{LINE.upper()}"), (4, f"{LINE}\n{LINE}"),
    (5, "exactly twenty chars\nnineteen characters"), (6, "exactly twenty chars\nnineteen characters"), (7, "exactly twenty chars\nnineteen characters"),
    (8, "ÄÖÜ äöü ÄÖÜ äöü ÄÖÜ ä\n"), (9, "äöü äöü äöü äöü äöü ä\n\n"), (10, "ÄÖÜ äöü ÄÖÜ äöü ÄÖÜ ä"), (11, "ÄÖÜ äöü ÄÖÜ äöü ÄÖÜ ä "),
    (12, "only two documents hold this line"), (12, "only two documents hold this line"), (13, "only two documents hold this line"),
    (None, "null ids are one document too"), (None, "null ids are one document too\n"), (14, "null ids are one document too"), (15, "null ids are one document too"),
    (16, "𝒳" * 20), (17, "𝒳" * 20), (18, "𝒳" * 20), (19, "𝒳" * 19), (20, "𝒳" * 19), (21, "𝒳" * 19),
]


def test_brute_force(frame, messy):
    assert found(frame(CASES + messy)) == brute(CASES + messy)


def test_long_text_and_hot_line(frame):
    pairs = [(i, "\n".join([LINE, f"line number {i} of its own text", LINE])) for i in range(300)]
    pairs += [(1000, "\n".join(f"{LINE} {k % 700}" for k in range(20_000))), (1001, "\n".join(f"{LINE} {k}" for k in range(700))), (999, f"{LINE} 5\n{LINE} 6")]
    got = found(frame(pairs))
    assert got == brute(pairs)
    assert max(r[2] for r in got) == 58


@pytest.mark.parametrize("min_chars,min_docs", [(0, 2), (5, 1), (1, 4)])
def test_other_settings(frame, messy, min_chars, min_docs):
    assert found(frame(messy), min_chars=min_chars, min_docs=min_docs) == brute(messy, min_chars, min_docs)


def test_empty_table_and_other_ids(spark, frame):
    assert op.line_dedup(frame([]), ["doc_id"]).collect() == []
    docs = spark.createDataFrame([("b", LINE, 1), ("a", LINE, 2), ("c", LINE, 3)], "`the.id` string, body string, gone int")
    got = op.line_dedup(docs, ["gone"], id_col="the.id", text_col="body").collect()
    assert sorted((r.row.asDict()["gone"], r.kept) for r in got) == [(1, ""), (2, ""), (3, LINE)]


def test_query_and_its_sql(spark, tmp_path, messy):
    docs = [(i, t, "en", "s", 0) for i, t in CASES + messy if i is not None]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in op.op13_line_dedup(spark, str(tmp_path)).collect())
    documents = pa.table({"doc_id": pa.array([d[0] for d in docs], pa.int64()), "text": pa.array([d[1] for d in docs], pa.string())})  # noqa: F841
    assert got == sorted(duckdb.sql(op.ORACLE_SQL).fetchall())
    assert got == sorted((i, n, k, hashlib.sha256((kept or "").encode()).hexdigest()) for i, n, k, kept in brute([d[:2] for d in docs]))
