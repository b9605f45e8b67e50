"""Shared helpers: reading tables, shared scratch tables, Arrow text batches, word hashes, components."""

from __future__ import annotations

import gc
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from geoping.session import scratch_path

SLICE_BYTES = 4 << 20
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    This cuts the lineage: the result no longer depends on executors or on their
    shuffle files, and the garbage collection lets Spark delete those files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    schema = df.schema
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def ship(spark: SparkSession, model) -> Broadcast:
    """Broadcast a model of this package's classes by value: executors need no copy of the package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def shipped(sent: Broadcast):
    return pickle.loads(sent.value)


def with_text(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``row`` (struct of the kept columns, whatever their names) and ``text``: no name can clash with results."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row"), docs[f"`{text_col}`"].cast("string").alias("text"))


def once(frame: DataFrame, docs: DataFrame, text_col: str, keep: list[str]) -> tuple[DataFrame, str | None]:
    """``frame`` without its ``text`` if that is in ``row`` anyway, and the name it has there: a text then travels to Python once."""
    held = text_col in keep and docs.schema[text_col].dataType.simpleString() == "string"
    return (frame.drop("text"), text_col) if held else (frame, None)


def with_held(batch: pa.RecordBatch, name: str | None) -> pa.RecordBatch:
    """The batch with the ``text`` that ``once`` left in ``row`` (no copy)."""
    return batch if name is None else batch.append_column("text", batch.column("row").field(name))


def as_schema(frame: DataFrame, *columns: str):
    """DDL-free schema for ``mapInArrow``: columns of ``frame`` by name, then ``name type`` strings."""
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    fields = []
    for c in columns:
        if " " in c:
            name, kind = c.split(" ", 1)
            fields.append(StructField(name, _parse_datatype_string(kind), True))
        else:
            fields.append(StructField(c, frame.schema[c].dataType, True))
    return StructType(fields)


def flat(array) -> pa.Array:
    return array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``limit`` bytes of ``column`` (one row at least)."""
    off, _ = buffers(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        stop = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield batch.slice(start, stop - start)
        start = stop


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, from 0) and bytes of a string or binary array; null rows are empty."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    n = len(array)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    kind = np.int64 if wide else np.int32
    bufs = array.buffers()
    off = np.frombuffer(bufs[1], dtype=kind)[array.offset:array.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(bufs[2], dtype=np.uint8)[off[0]:off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return off - off[0], raw


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words ``[^\x20\x09-\x0D]+``.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, 9, 10, 11, 12, 13]] = False


def powers(n: int) -> np.ndarray:
    p = np.full(n, np.uint64(_BASE | 1), np.uint64)
    if n:
        p[0] = 1
        np.multiply.accumulate(p, out=p)
    return p


class Words:
    """Words of a batch of texts: ``start``/``end`` byte positions, ``hash`` and ``first`` (word index where each document begins).

    ``sound``: every byte is mixed with its place before it is added, so that no algebra is left. The plain hash is a
    polynomial modulo 2**64, which takes certain long words (Thue-Morse sequences of two letters) for one another.
    """

    def __init__(self, off: np.ndarray, raw: np.ndarray, table: np.ndarray = SPACE_WORDS, lower: bool = True, sound: bool = False):
        n = len(raw)
        inside = table[raw]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            heads = off[:-1][off[:-1] < n]
            before[heads] = False
            tails = off[1:][off[1:] > 0] - 1
            after[tails] = False
        begins = inside & ~before
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, off)
        self.counts = np.diff(self.first)
        if len(self.start):
            idx = np.arange(n, dtype=np.int64)
            at = idx - np.maximum.accumulate(np.where(begins, idx, 0))
            longest = int((self.end - self.start).max())
            codes = (BYTE_CODES[LOWER] if lower else BYTE_CODES)[raw]
            place = powers(longest + 1)[np.minimum(at, longest)]
            codes = mix64(codes ^ place) if sound else codes * place
            codes[~inside] = 0
            self.hash = mix64(np.add.reduceat(codes, self.start) + (self.end - self.start).astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the ``width``-word shingles and the shingle index where each document begins.

        A document of fewer words, but at least one, has its whole sequence as its one shingle.
        """
        counts = self.counts
        per_doc = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
        first = np.concatenate(([0], np.cumsum(per_doc)))
        total = int(first[-1])
        if not total:
            return np.zeros(0, np.uint64), first
        doc = np.repeat(np.arange(len(counts)), per_doc)
        at = np.arange(total) - first[doc] + self.first[doc]
        out = np.zeros(total, np.uint64)
        h = self.hash
        short = counts[doc] < width
        size = np.where(short, counts[doc], width)
        step = np.uint64(_BASE | 1)
        for k in range(width):
            live = size > k
            if live.all():
                out = out * step + h[at + k]
            else:
                out[live] = out[live] * step + h[at[live] + k]
        return mix64(out + size.astype(np.uint64)), first


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component): smallest node reachable over ``edges`` (a, b); nodes of edges only.

    Alternating large-star and small-star steps: every step is one aggregation by
    node and one join, so no node's neighbours are gathered. Ends when the edges no longer
    change, by number and two sums of hashes that are taken while they are written.
    """
    def counted(frame: DataFrame, label: str) -> tuple[DataFrame, tuple]:
        seen = Observation(f"{label}-{uuid.uuid4().hex}")
        wide = "decimal(38,0)"
        frame = frame.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.hash("a", "b").cast(wide)).alias("s"), F.sum(F.xxhash64("a", "b").cast(wide)).alias("t"))
        out = materialise(frame, label)
        return out, tuple(seen.get[k] for k in ("n", "s", "t"))

    cur, before = counted(edges.where("a <> b").select("a", "b").distinct(), f"{name}-edges")
    while before[0]:
        sym = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = sym.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialise(large, f"{name}-large")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (down.join(low, "a").select(F.col("m").alias("x"), F.col("b").alias("y"))
                 .unionByName(low.select(F.col("a").alias("x"), F.col("m").alias("y"))))
        small = small.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).where("a <> b").distinct()
        cur, after = counted(small, f"{name}-small")
        if after == before:
            break
        before = after
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
