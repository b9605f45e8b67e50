"""Operator 2: exact substring dedup by blockwise suffix sorting with a difference cover.

Every byte covered by a ``min_bytes`` string (a window) that also starts anywhere
else, in the same or another document, is removed. A window repeats exactly if it ties
with another suffix over ``min_bytes`` bytes, so the suffix order is only needed to that
depth:

1. Candidates. Each window's leftmost smallest hash of its ``KEY`` byte substrings is
   its key; equal windows have equal keys, and neighbouring windows mostly share one.
   Keys that occur once in the whole corpus belong to no repeated window: their
   windows are left out (nothing else is). Keys are counted by a partial aggregation.
2. Suffix buckets. Neighbouring windows of one key form one piece of text, which goes to
   the bucket of its key: all windows that could tie meet there. Buckets are put
   together to blocks of about ``BLOCK_BYTES`` of text and sorted one block at a time.
3. Block sort. The ranks of a difference-cover sample (positions whose residue modulo v
   is in the cover) by their ``min_bytes - v`` byte strings come first. Suffixes are
   then sorted by their first and last v bytes; long ties are resolved by the ranks at the
   offset below v that takes both suffixes to sample positions. Of a large bucket, the
   suffixes are sorted one slice (by their first bytes) after the other, which bounds memory.
4. A key with more than ``HOT`` places has no bucket of its own: its windows are named
   one by one (128 bits) and counted by a partial aggregation.

Identical texts enter once, weighted by their number. Names of byte strings are 64-bit
polynomial hashes, mixed.

Defined results: a null text is empty; texts below ``min_bytes`` lose nothing; a text of
at least ``min_bytes`` that occurs in two rows (also rows equal in every column) is
removed whole from both; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoping.llm.common import BYTE_CODES, as_schema, buffers, flat, materialise, mix64, powers, slices

MIN_BYTES = 400
BLOCK_BYTES = 1 << 20
HOT = 1 << 16
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))


def cover(limit: int) -> tuple[int, np.ndarray]:
    """Period and residues of a difference cover by the Colbourn-Ling rule, of the longest period up to ``limit``."""
    r = 0
    while 24 * (r + 1) ** 2 + 36 * (r + 1) + 13 <= limit:
        r += 1
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.concatenate(([0], np.cumsum(steps)))


def shift_table(v: int, residues: np.ndarray) -> np.ndarray:
    """[a, b]: the offset below v that takes residues a and b into the cover."""
    pick = np.zeros(v, np.int64)
    for x in residues.tolist():
        for y in residues.tolist():
            pick[(y - x) % v] = x
    a, b = np.meshgrid(np.arange(v), np.arange(v), indexing="ij")
    return (pick[(b - a) % v] - a) % v


class Names:
    """64-bit names of the substrings of one byte array."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_CODES[raw] * powers(n), out=self.sums[1:])
        self.back = np.full(n + 1, _INVERSE, np.uint64)
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)

    def at(self, start: np.ndarray, length: int) -> np.ndarray:
        return mix64((self.sums[start + length] - self.sums[start]) * self.back[start])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - 1
        if n < length:
            return np.zeros(0, np.uint64)
        return mix64((self.sums[length:] - self.sums[:n + 1 - length]) * self.back[:n + 1 - length])


def key_runs(off: np.ndarray, raw: np.ndarray, size: int, key: int):
    """Runs of neighbouring windows of one key: key name, document, first window (in document), number of windows."""
    n = len(raw)
    empty = np.zeros(0, np.int64)
    live = np.flatnonzero(np.diff(off) >= size)
    if not len(live):
        return np.zeros(0, np.uint64), empty, empty, empty
    names = Names(raw).all(key)
    width = size - key + 1
    low = np.uint64((1 << 24) - 1)
    value = (names & ~low) | np.arange(len(names), dtype=np.uint64)
    pad = -len(value) % width
    grid = np.concatenate((value, np.full(pad, np.uint64(2 ** 64 - 1)))).reshape(-1, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    total = n - size + 1
    least = np.minimum(after[:total], before[width - 1:width - 1 + total]) & low
    mark = np.zeros(total + 1, np.int32)
    np.add.at(mark, off[live], 1)
    np.add.at(mark, off[live + 1] - size + 1, -1)
    windows = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
    spot = least[windows].astype(np.int64)
    new = np.ones(len(windows), bool)
    new[1:] = (spot[1:] != spot[:-1]) | (windows[1:] != windows[:-1] + 1)
    # documents without a gap between their windows have different spots, as a key lies inside its document
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(windows)))
    start = windows[first]
    doc = np.searchsorted(off, start, side="right") - 1
    return names[spot[first]], doc, start - off[doc], count


def _parts(batch: pa.RecordBatch, column: str, size: int, limit: int = 1 << 20):
    """Pieces of a batch of at most about ``limit`` bytes; a longer text comes in overlapping cuts: (rows, shift, off, raw)."""
    for part in slices(batch, column, limit):
        off, raw = buffers(part.column(column))
        if part.num_rows > 1 or len(raw) <= 2 * limit:
            yield part, 0, off, raw
            continue
        for at in range(0, len(raw) - size + 1, limit):
            cut = raw[at:at + limit + size - 1]
            yield part, at, np.array([0, len(cut)]), cut


def _key_rows(texts: DataFrame, size: int, key: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part, _, off, raw in _parts(batch, "text", size):
                names, doc, _, _ = key_runs(off, raw, size, key)
                if len(names):
                    yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), part.column("t1").take(pa.array(doc)), part.column("t2").take(pa.array(doc))], names=["k", "t1", "t2"])

    return texts.select("t1", "t2", "text").mapInArrow(run, "k bigint, t1 bigint, t2 bigint")


def _piece_rows(frame: DataFrame, size: int, key: int, hot: bool) -> DataFrame:
    """Pieces of the listed keys; for ``hot`` keys one row per window instead, named by 128 bits."""
    schema = "n1 bigint, n2 bigint, t1 bigint, t2 bigint, at int, copies bigint" if hot else "k bigint, t1 bigint, t2 bigint, at int, copies bigint, piece binary"

    def run(batches):
        for batch in batches:
            for part, shift, off, raw in _parts(batch, "text", size):
                names, doc, at, count = key_runs(off, raw, size, key)
                bounds = np.searchsorted(doc, np.arange(len(off)))
                chosen = []
                for i in range(part.num_rows):
                    listed = part.column("keys")[i]
                    mine = np.arange(bounds[i], bounds[i + 1])
                    if listed.is_valid and len(mine):
                        chosen.append(mine[np.isin(names[mine].view(np.int64), listed.values.to_numpy())])
                chosen = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
                if not len(chosen):
                    continue
                doc, at, count, names = doc[chosen], at[chosen], count[chosen], names[chosen]
                if hot:
                    which = np.repeat(np.arange(len(doc)), count)
                    spot = at[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                    begin = off[doc[which]] + spot
                    known = Names(raw)
                    half = size // 2
                    n1, n2 = known.at(begin, size), mix64(known.at(begin, half) * np.uint64(3) + known.at(begin + half, size - half))
                    take = pa.array(doc[which])
                    arrays = [pa.array(n1.view(np.int64)), pa.array(n2.view(np.int64)), part.column("t1").take(take), part.column("t2").take(take), pa.array(spot + shift, pa.int32()), part.column("copies").take(take)]
                    columns = ["n1", "n2", "t1", "t2", "at", "copies"]
                else:
                    begin = off[doc] + at
                    text = raw.tobytes()
                    pieces = [text[b:b + c + size - 1] for b, c in zip(begin.tolist(), count.tolist(), strict=True)]
                    take = pa.array(doc)
                    arrays = [pa.array(names.view(np.int64)), part.column("t1").take(take), part.column("t2").take(take), pa.array(at + shift, pa.int32()), part.column("copies").take(take), pa.array(pieces, pa.binary())]
                    columns = ["k", "t1", "t2", "at", "copies", "piece"]
                whole = pa.RecordBatch.from_arrays(arrays, names=columns)
                for i in range(0, whole.num_rows, 50_000):
                    yield whole.slice(i, 50_000)

    return frame.select("t1", "t2", "copies", "keys", "text").mapInArrow(run, schema)


class Block:
    """Pieces whose windows are sorted together."""

    def __init__(self, size: int):
        self.size = size
        self.v, self.residues = cover(size // 2)
        self.shift = shift_table(self.v, self.residues)
        self.sampled = np.zeros(self.v, bool)
        self.sampled[self.residues] = True

    def repeated(self, off: np.ndarray, raw: np.ndarray, weight: np.ndarray, budget: int) -> np.ndarray:
        """For each byte position: does a window start there that occurs with a total weight of two or more?"""
        size, v = self.size, self.v
        depth = size - v
        n = len(raw)
        piece = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
        left = off[1:][piece] - np.arange(n)
        rank = np.full(n, -1, np.int32)
        cuts = [(a, min(n, a + budget + size)) for a in range(0, n, budget)]
        spots, names = [], []
        for a, b in cuts:
            known = Names(raw[a:b])
            own = np.arange(a, min(b, a + budget))
            own = own[self.sampled[own % v] & (left[own] >= depth)]
            spots.append(own)
            names.append(known.at(own - a, depth))
        spots = np.concatenate(spots)
        rank[spots] = np.unique(np.concatenate(names), return_inverse=True)[1]
        out = np.zeros(n, bool)
        n_slices = max(1, -(-n // budget))
        for bucket in range(n_slices):
            places, keys = [], []
            for a, b in cuts:
                known = Names(raw[a:b])
                own = np.arange(a, min(b, a + budget))
                own = own[left[own] >= size]
                head = known.at(own - a, v)
                if n_slices > 1:
                    mine = head % np.uint64(n_slices) == bucket
                    own, head = own[mine], head[mine]
                places.append(own)
                keys.append(mix64(head * np.uint64(3) + known.at(own - a + size - v, v)))
            self._sort(np.concatenate(places), np.concatenate(keys), weight[piece], rank, out)
        return out

    def _sort(self, place, key, weight, rank, out) -> None:
        by = np.argsort(key, kind="stable")
        place, key = place[by], key[by]
        group = np.concatenate(([0], np.cumsum(key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        while len(place):
            first = np.ones(len(group), bool)
            first[1:] = group[1:] != group[:-1]
            lead = place[np.flatnonzero(first)][np.cumsum(first) - 1]
            step = self.shift[place % self.v, lead % self.v]
            tied = rank[place + step] == rank[lead + step]
            own = np.cumsum(first) - 1
            total = np.bincount(own[tied], weight[place[tied]], minlength=int(own[-1]) + 1)
            out[place[tied][total[own[tied]] >= 2]] = True
            place, group = place[~tied], group[~tied]


def _sorted_blocks(pieces: DataFrame, size: int, block_bytes: int) -> DataFrame:
    """(t1, t2, runs): first and last+1 window of every run of repeated windows in a piece."""

    def flush(rows: list[tuple], block: Block):
        # equal pieces of one key are neighbours: they enter once, with their weights
        kept, weight, owner = [], [], []
        for row in rows:
            if kept and kept[-1] == (row[0], row[5]):
                weight[-1] += row[4]
            else:
                kept.append((row[0], row[5]))
                weight.append(row[4])
            owner.append(len(kept) - 1)
        texts = [t for _, t in kept]
        off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        raw = np.frombuffer(b"".join(texts), np.uint8)
        found = block.repeated(off, raw, np.array(weight, np.float64), block_bytes)
        runs = []
        for i in range(len(texts)):
            edges = np.flatnonzero(np.diff(np.concatenate(([0], found[off[i]:off[i + 1]], [0]))))
            runs.append(edges)
        t1, t2, out = [], [], []
        for row, i in zip(rows, owner, strict=True):
            if len(runs[i]):
                t1.append(row[1])
                t2.append(row[2])
                out.append((runs[i] + row[3]).tolist())
        return pa.RecordBatch.from_arrays([pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(out, pa.list_(pa.int32()))], names=["t1", "t2", "runs"])

    def run(batches):
        block = Block(size)
        rows, held, last, piece = [], 0, None, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("k", "t1", "t2", "at", "copies", "piece")), strict=True):
                if row[0] != last and held >= block_bytes:
                    yield flush(rows, block)
                    rows, held, piece = [], 0, None
                last = row[0]
                if row[5] == piece:
                    row = (*row[:5], piece)
                else:
                    piece = row[5]
                    held += len(piece)
                rows.append(row)
        if rows:
            yield flush(rows, block)

    return pieces.repartition("k").sortWithinPartitions("k", "piece").mapInArrow(run, "t1 bigint, t2 bigint, runs array<int>")


def repeated_runs(base: DataFrame, size: int, key: int, hot: int, block_bytes: int) -> DataFrame:
    """(t1, t2, whole, runs) for texts with repeated windows; ``whole``: the text itself occurs again."""
    rows = _key_rows(base, size, key)
    keys = materialise(rows.groupBy("k", "t1", "t2").agg(F.count("*").alias("n")), "suffix-keys")
    twice = keys.groupBy("k").agg(F.sum("n").alias("places")).where("places > 1")
    listed = (keys.select("k", "t1", "t2").join(twice, "k").groupBy("t1", "t2")
              .agg(F.collect_list(F.when(F.col("places") <= hot, F.col("k"))).alias("cold"), F.collect_list(F.when(F.col("places") > hot, F.col("k"))).alias("warm")))
    texts = base.groupBy("t1", "t2").agg(F.min("id").alias("lead"), F.count("*").alias("copies"))
    listed = materialise(listed.join(texts, ["t1", "t2"]), "suffix-listed")
    mine = listed.select(F.col("t1").alias("u1"), F.col("t2").alias("u2"), "lead", "copies", "cold", "warm")
    joined = mine.hint("shuffle_hash").join(base, (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")) & F.col("id").eqNullSafe(F.col("lead")))
    pieces = _piece_rows(joined.withColumn("keys", F.col("cold")), size, key, False)
    runs = _sorted_blocks(pieces, size, block_bytes)
    if listed.where(F.size("warm") > 0).limit(1).count():
        named = materialise(_piece_rows(joined.where(F.size("warm") > 0).withColumn("keys", F.col("warm")), size, key, True), "suffix-names")
        again = named.groupBy("n1", "n2").agg(F.sum("copies").alias("n")).where("n > 1").select("n1", "n2")
        runs = runs.unionByName(named.join(again, ["n1", "n2"]).select("t1", "t2", F.array(F.col("at"), F.col("at") + 1).alias("runs")))
    runs = materialise(runs.groupBy("t1", "t2").agg(F.flatten(F.collect_list("runs")).alias("runs")), "suffix-runs")
    return listed.select("t1", "t2", (F.col("copies") > 1).alias("whole")).join(runs, ["t1", "t2"], "left").where("whole or runs is not null")


def _remove(frame: DataFrame, size: int) -> DataFrame:
    schema = as_schema(frame, "row", "n_bytes bigint", "n_removed bigint", "n_spans bigint", "kept binary")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                off, raw = buffers(flat(part.column("text")))
                total, removed, spans, kept = [], [], [], []
                for i, (whole, runs) in enumerate(zip(part.column("whole").to_pylist(), part.column("runs").to_pylist(), strict=True)):
                    text = raw[off[i]:off[i + 1]].tobytes()
                    n, out = 0, text
                    gone = 0
                    if whole and len(text) >= size:
                        n, out, gone = 1, b"", len(text)
                    elif runs:
                        keep, end, begin = [], 0, None
                        for a, b in sorted(zip(runs[::2], runs[1::2], strict=True)):
                            if begin is None or a > end:
                                keep.append(text[end:a])
                                gone -= end - (begin or 0)
                                begin = a
                                n += 1
                                end = b - 1 + size
                            else:
                                end = max(end, b - 1 + size)
                        keep.append(text[end:])
                        out = b"".join(keep)
                        gone = len(text) - len(out)
                    total.append(len(text))
                    removed.append(gone)
                    spans.append(n)
                    kept.append(out)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=schema.names)

    return frame.mapInArrow(run, schema)


def suffix_dedup(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES, hot: int = HOT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row``, n_bytes, n_removed, n_spans and ``kept`` (the remaining bytes) for every row of ``docs``.

    ``min_bytes`` is at least 32.
    """
    key = max(8, min(128, min_bytes // 3))
    base = docs.select(F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row"), docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].cast("string").alias("text"))
    base = base.withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit(1), "text"))
    found = materialise(repeated_runs(base, min_bytes, key, hot, block_bytes), "suffix-found")
    found = found.select(F.col("t1").alias("f1"), F.col("t2").alias("f2"), "whole", "runs")
    joined = base.join(found, (F.col("t1") == F.col("f1")) & (F.col("t2") == F.col("f2")), "left")
    return _remove(joined.select("row", "text", "whole", "runs"), min_bytes)


def as_text(frame: DataFrame) -> DataFrame:
    """Adds ``kept_text``: the remaining bytes as text, without the bytes of characters that were cut through."""
    schema = as_schema(frame, *frame.columns, "kept_text string")

    def run(batches):
        for batch in batches:
            texts = [b.as_py().decode("utf-8", "ignore") for b in batch.column("kept")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return frame.mapInArrow(run, schema)


def _digests(frame: DataFrame) -> DataFrame:
    return frame.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return _digests(suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"]))


def brute_force(texts: list[str | None], size: int) -> list[tuple[int, int, int, str]]:
    """The contract's rows, for small fixtures."""
    raw = [(t or "").encode() for t in texts]
    seen: dict = {}
    for r in raw:
        for i in range(len(r) - size + 1):
            seen[r[i:i + size]] = seen.get(r[i:i + size], 0) + 1
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - size + 1):
            if seen[r[i:i + size]] > 1:
                gone[i:i + size] = b"\x01" * size
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return out
