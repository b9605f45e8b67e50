"""Operator 6: benchmark decontamination by Wu-Manber multi-pattern search over words.

The test strings are the 13-word windows of the benchmark items (an item of
fewer words, but not none, is one window). For each window length a block shift
table (blocks of two words, one word for one-word windows) says how far the
search may jump, a block with shift 0 selects a bucket of windows by their last
block, the first word narrows the bucket, and the words are then compared directly.

The benchmark's distinct items, as words, are cut into pieces of at most ``PIECE_BYTES`` (or 13 words) that
overlap by 12 words, so they hold the same windows; pieces are put into blocks of ``BLOCK_BYTES``
(and a piece at most) by running sums of their bytes. Each block is broadcast by itself (a proven bound, however often an
item is repeated or how long it is) and searched against all documents, which are never shuffled for the search.

Defined results: null or empty texts have no words and no hits; a null item text
has no windows; a null ``item_id`` counts as the item ``""``; repeated items count
once by their id; an empty benchmark hits nothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoping.llm.common import as_schema, materialise, with_text

WINDOW = 13
BLOCK_BYTES = 4 << 20
PIECE_BYTES = 1 << 18
#: Bytes that a piece counts for besides its words.
_EXTRA = 64
#: Bytes to words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z: all others become blanks.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    if text is None:
        return []
    raw = text.encode("utf-8") if isinstance(text, str) else text
    return raw.translate(_TO_WORDS).split()


class WuManber:
    """All windows of one length ``m``."""

    def __init__(self, m: int, items: list[tuple[str, list[bytes]]]):
        self.m, self.block = m, min(2, m)
        self.skip = m - self.block + 1
        self.items = items
        self.shift: dict = {}
        self.buckets: dict = defaultdict(lambda: defaultdict(list))
        seen = set()
        for i, (item, words) in enumerate(items):
            last = len(words) - self.block
            for j in range(last + 1):
                key = tuple(words[j:j + self.block])
                # the largest position that this block can take in a window of the item
                reach = min(j, m - self.block)
                s = m - self.block - reach
                if s < self.shift.get(key, self.skip):
                    self.shift[key] = s
            for j in range(len(words) - m + 1):
                window = tuple(words[j:j + m])
                if (item, window) not in seen:
                    seen.add((item, window))
                    self.buckets[window[m - self.block:]][window[0]].append((i, j))

    def search(self, words: list[bytes], hit: bytearray, found: set) -> None:
        m, b, skip, get, n = self.m, self.block, self.skip, self.shift.get, len(words)
        pos = m
        two = b == 2
        while pos <= n:
            key = (words[pos - 2], words[pos - 1]) if two else (words[pos - 1],)
            s = get(key, skip)
            if s:
                pos += s
                continue
            near = self.buckets.get(key)
            if near:
                for i, j in near.get(words[pos - m], ()):
                    item, test = self.items[i]
                    if test[j:j + m] == words[pos - m:pos]:
                        hit[pos - m:pos] = b"\x01" * m
                        found.add(item)
            pos += 1


def automata(items: list[tuple[str, str | None]]) -> list[WuManber]:
    by_length = defaultdict(list)
    for item, text in items:
        words = words_of(text)
        if words:
            by_length[min(WINDOW, len(words))].append((item, words))
    return [WuManber(m, group) for m, group in sorted(by_length.items())]


def _pieces(item: str, text: str, limit: int) -> list[str]:
    """Words of an item, one blank between, in pieces of about ``limit`` bytes that overlap by a window less one word."""
    words = words_of(text)
    sizes = np.cumsum([len(w) + 1 for w in words])
    out, start = [], 0
    while start < len(words):
        before = sizes[start - 1] if start else 0
        stop = max(int(np.searchsorted(sizes, before + limit, side="right")), min(start + 2 * WINDOW, len(words)))
        out.append(b" ".join(words[start:stop]).decode("utf-8", "replace"))
        if stop == len(words):
            break
        start = stop - (WINDOW - 1)
    return out


def _packed(items: DataFrame, block_bytes: int) -> DataFrame:
    """(block, id, text): pieces of the items in blocks of ``block_bytes`` and a piece at most, however many tasks cut them.

    A piece's place is the running sum of bytes in its task after the totals of the tasks before; only those totals reach
    the driver.
    """
    def cut(batches):
        upto = 0
        for batch in batches:
            ids, texts, sums = [], [], []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for piece in _pieces(i, text, min(PIECE_BYTES, block_bytes)):
                    ids.append(i)
                    texts.append(piece)
                    sums.append(upto)
                    upto += len(i.encode()) + len(piece.encode()) + _EXTRA
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string()), pa.array(sums, pa.int64())], names=["id", "text", "before"])

    pieces = items.distinct().mapInArrow(cut, "id string, text string, before bigint").withColumn("task", F.spark_partition_id())
    pieces = materialise(pieces, "benchmark-pieces")
    totals = pieces.groupBy("task").agg(F.max(F.col("before") + F.octet_length("text") + F.octet_length("id") + _EXTRA).alias("n")).orderBy("task").collect()
    offsets, run = [], 0
    for r in totals:
        offsets.append((r["task"], run))
        run += r["n"]
    placed = pieces.join(F.broadcast(items.sparkSession.createDataFrame(offsets, "task int, offset bigint")), "task")
    return placed.select(F.floor((F.col("offset") + F.col("before")) / F.lit(block_bytes)).alias("block"), "id", "text")


def _scan(frame: DataFrame, broadcast) -> DataFrame:
    """``row``, ``n_words`` and the hits of one benchmark block: ``runs`` (start, end word pairs) and ``items``."""
    schema = as_schema(frame, "row", "n_words bigint", "runs array<int>", "items array<string>")

    def run(batches):
        search = automata(broadcast.value)
        for batch in batches:
            counts, runs, items = [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                hit, found = bytearray(len(words)), set()
                for m in search:
                    m.search(words, hit, found)
                edges = []
                if found:
                    marks = np.frombuffer(bytes(b"\x00" + hit + b"\x00"), np.int8)
                    edges = np.flatnonzero(np.diff(marks)).tolist()
                counts.append(len(words))
                runs.append(edges)
                items.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                names=["row", "n_words", "runs", "items"])

    return frame.mapInArrow(run, schema)


def _verdict(found: DataFrame) -> DataFrame:
    """``row`` and the contract's columns from word runs and item lists."""
    schema = as_schema(found, "row", "n_words bigint", "n_hit bigint", "n_items bigint", "items_sha256 string", "contaminated boolean")

    def run(batches):
        for batch in batches:
            hits, counts, digests, bad = [], [], [], []
            for n, runs, items in zip(batch.column("n_words").to_pylist(), batch.column("runs").to_pylist(), batch.column("items").to_pylist(), strict=True):
                pairs = sorted(zip(runs[::2], runs[1::2], strict=True))
                total = end = 0
                for a, b in pairs:
                    total += max(0, b - max(a, end))
                    end = max(end, b)
                ids = sorted(set(items))
                hits.append(total)
                counts.append(len(ids))
                digests.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
                bad.append(total > 0 and 20 * total >= n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(bad, pa.bool_())],
                names=["row", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return found.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row`` (struct of the ``keep`` columns), n_words, n_hit, n_items, items_sha256, contaminated per document row.

    With more than one benchmark block every block's word runs and items are put
    together per row, by a row number that the first pass writes down.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(benchmark[f"`{item_col}`"].cast("string"), F.lit("")).alias("id"), benchmark[f"`{item_text_col}`"].cast("string").alias("text")).where("text is not null")
    packed = _packed(items, block_bytes)
    blocks = [r["block"] for r in packed.select("block").distinct().orderBy("block").collect()]  # a row per ``block_bytes`` of benchmark

    def sent(block):
        own = packed.where(F.col("block") == block)
        return spark.sparkContext.broadcast([(r["id"], r["text"]) for r in own.collect()])

    frame = with_text(docs, text_col, keep)
    if len(blocks) < 2:
        return _verdict(_scan(frame, sent(blocks[0]) if blocks else spark.sparkContext.broadcast([])))
    frame = materialise(frame.withColumn("row", F.struct(F.col("row").alias("kept"), F.monotonically_increasing_id().alias("nr"))), "decontaminate")
    parts = None
    for k, block in enumerate(blocks):
        part = _scan(frame, sent(block))
        part = materialise(part if k == 0 else part.where("size(items) > 0"), "decontaminate-block")
        parts = part if parts is None else parts.unionByName(part)
    found = parts.groupBy(F.col("row.nr").alias("nr")).agg(
        F.first("row.kept").alias("row"), F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items"))
    return _verdict(found.select("row", "n_words", "runs", "items"))


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontaminate(docs, bench, ["doc_id"])
    return out.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE_SQL = """
WITH RECURSIVE low AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
bench AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
tests AS (
  SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS s
  FROM bench, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(p) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT m FROM tests),
spots AS (
  SELECT rid, p, m, array_to_string(w[p : p + m - 1], ' ') AS s
  FROM low, lengths, unnest(range(1, len(w) - m + 2)) AS u(p) WHERE len(w) >= m),
found AS (SELECT rid, p, spots.m, item FROM spots JOIN tests ON spots.m = tests.m AND spots.s = tests.s),
hits AS (SELECT rid, count(DISTINCT q) AS n_hit FROM found, unnest(range(p, p + m)) AS u(q) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM low LEFT JOIN hits USING (rid) LEFT JOIN ids USING (rid)
"""
