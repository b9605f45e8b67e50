"""Operator 3: quality rules with an n-gram language model.

Base rules count words, symbols, repeated lines and repeated three-word windows.
The language model is a modified Kneser-Ney model of 4-grams of code points, none folded
into another: Spark counts the 4-grams of all whole texts, exactly (three code points of 21
bits in a 64-bit number and the fourth beside them); the lower orders, down to pairs, use
continuation counts. Below the pairs, the class of a code point is foretold by the three
classes before it, and the code point among those of its class. For that order alone code
points have 64 classes (a-z, digits, blank, marks, other letters), so at most 64**4 = 2**24
grams and a share for each of 0x110000 code points are broadcast, whatever the corpus, in sorted
hash arrays (one per order: sorted 64-bit hashes, log-probability, back-off weight).

The grams of code points grow with the corpus and are never gathered: they stay a table, each with
its surprise in bits. Texts are cut into blocks of rows of about ``BLOCK_BYTES``; a block asks for each of its distinct grams once, by an equi-join, and
its texts and the answers meet in one task, the answers first (sorted arrays), then the texts as
a stream. What travels per block are its distinct grams, not its characters.

A text is kept if two things are as usual in its language: the log-perplexity, and the part of it that the
classes alone say (what kind of character follows; marks between words are common as such, their
patterns are not). Every language has its own band for each: median of the
documents that pass the base rules, plus and minus the reach of the text's length. The
reach comes from the data: the lengths of a language are cut into groups of ``MIN_GROUP``
documents at least, and a group's robust deviation (1.4826 times the median absolute
deviation, taken at the text's length by 1 / sqrt(characters)) is multiplied by the width
beyond which normal texts lie in ``CLEAN_LOST`` of all cases. Medians come from exact
histograms, so the band is the same however the rows are split.

Defined results: null and empty texts have no words, fail the base rules and have a
null perplexity; a null language is a language of its own; repeated rows are scored
row by row (and counted row by row); an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoping.llm.common import as_schema, buffers, materialise, mix64, once, ship, shipped, slices, with_held

ORDER = 4
CLASSES = 64
MIN_WORDS = 50
#: Share of the clean documents that the band may reject, and the robust deviations that this share asks for.
CLEAN_LOST = 0.001
BAND = NormalDist().inv_cdf(1 - CLEAN_LOST / 2)
#: Documents that the spread of a group of lengths is taken from, at least; length bins per doubling.
MIN_GROUP = 100
LENGTH_BINS = 4
#: Bits by which one character's surprise varies, at least: a floor under the spread of copies and of few documents.
MIN_SPREAD = 1.0
#: Bytes of text that are looked at at a time; of a block that asks for its grams together; of a task's share of the texts.
SLICE = 1 << 20
BLOCK_BYTES = 16 << 20
PART_BYTES = 16 << 20
#: Distinct grams that a task holds before it writes them.
HELD = 1 << 20
#: Bits of a code point, code points there are, and the one that stands ``ORDER - 1`` times before each text.
POINT_BITS = 21
POINTS = 0x110000
PAD = 0x20
#: Histogram bins per bit of log-perplexity.
BINS = 512
_SYMBOLS = frozenset(b"#*$%&|<>")
_BLANK, _DIGIT, _MARK = 0, 27, 28
_SYMBOL_TABLE = np.zeros(256, bool)
_SYMBOL_TABLE[list(_SYMBOLS)] = True


def class_table() -> np.ndarray:
    """Class of every code point below 65536; above: the same rule applied to the low 16 bits. For the lowest order of the model only."""
    out = np.empty(65536, np.uint8)
    point = np.arange(65536)
    out[:] = 31 + (point * 40503 >> 5) % 33  # other letters: 33 classes
    out[:128] = _MARK
    out[[9, 10, 11, 12, 13, 32]] = _BLANK
    out[48:58] = _DIGIT
    out[65:91] = np.arange(1, 27)
    out[97:123] = np.arange(1, 27)
    for sign in b"#*$%&|<>":
        out[sign] = 29
    out[[0x21, 0x3F, 0x2E, 0x2C, 0x3B, 0x3A]] = 30
    return out


_TABLE = class_table()
_CLASS_SIZE = np.bincount(_TABLE, minlength=CLASSES) * (POINTS >> 16)


def grams(off: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 4-grams of a batch of texts: ``h`` (three code points) and ``c``; which one ends at each character; where each document begins.

    Each text gets ``ORDER - 1`` blanks before it; runs of blanks count as they are.
    """
    heads = (raw & 0xC0) != 0x80
    before = np.concatenate(([0], np.cumsum(heads)))[off]
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) != before[-1]:  # not valid UTF-8: bytes, so that positions still agree
        points, before = raw, off
    points = points.astype(np.int64)
    at = np.arange(len(points), dtype=np.int64) - np.repeat(before[:-1], np.diff(before))
    h = np.zeros(len(points), np.int64)
    for k in range(1, ORDER):
        prior = np.full(len(points), PAD, np.int64)
        prior[k:] = points[:-k]
        prior[at < k] = PAD
        h |= prior << POINT_BITS * (k - 1)
    h = pa.array(h).dictionary_encode()
    both = pa.array(h.indices.to_numpy().astype(np.int64) << POINT_BITS | points).dictionary_encode()
    pairs = both.dictionary.to_numpy()
    return h.dictionary.to_numpy()[pairs >> POINT_BITS], pairs & ((1 << POINT_BITS) - 1), both.indices.to_numpy(), before


def folded(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Packed 4-grams of classes of 4-grams of code points."""
    code = _TABLE[c & 0xFFFF].astype(np.int64)
    for k in range(1, ORDER):
        code |= _TABLE[h >> POINT_BITS * (k - 1) & 0xFFFF].astype(np.int64) << 6 * k
    return code


def _added(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (h, c) of several parts and their counts added up."""
    h, c, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.lexsort((c, h))
    h, c, n = h[by], c[by], n[by]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))[:len(h)])
    return h[new], c[new], np.add.reduceat(n, new) if len(new) else n


def _runs(*columns: np.ndarray):
    """(from, to) of the stretches of rows in which no column changes."""
    edge = np.flatnonzero(np.any([x[1:] != x[:-1] for x in columns], axis=0)) + 1
    return zip([0, *edge.tolist()], [*edge.tolist(), len(columns[0])], strict=True)


def block_grams(frame: DataFrame, held: str | None = None) -> DataFrame:
    """(block, h, c, n): every 4-gram of all whole texts; a block has a few rows a gram at most, one for each task that reads of it."""
    def run(batches):
        parts, size, own = [], 0, None

        def flush():
            h, c, n = _added(parts)
            parts.clear()
            for i in range(0, len(h), 100_000):
                cut = [x[i:i + 100_000] for x in (np.full(len(h), own), h, c, n)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cut], names=["block", "h", "c", "n"])

        for batch in batches:
            block = batch.column("block").to_numpy()
            for start, stop in _runs(block) if batch.num_rows else ():
                if block[start] != own:
                    if parts:
                        yield from flush()
                    own, size = block[start], 0
                for part in slices(with_held(batch, held).slice(start, stop - start), "text", SLICE):
                    h, c, which, _ = grams(*buffers(part.column("text")))
                    parts.append((h, c, np.bincount(which, minlength=len(h))))
                    size += len(h)
                    if size > HELD:
                        parts[:] = [_added(parts)]
                        size = len(parts[0][0])
                        if size > HELD // 2:
                            yield from flush()
                            size = 0
        if parts:
            yield from flush()

    return frame.mapInArrow(run, "block bigint, h bigint, c bigint, n bigint")


def _folded_counts(counted: DataFrame) -> DataFrame:
    """(gram, n): counts of 4-grams of classes from those of 4-grams of code points."""
    def run(batches):
        for batch in batches:
            h, c, n = (batch.column(x).to_numpy() for x in ("h", "c", "n"))
            seen, which = np.unique(folded(h, c), return_inverse=True)
            total = np.zeros(len(seen), np.int64)
            np.add.at(total, which, n)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total)], names=["gram", "n"])

    return counted.select("h", "c", "n").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def _count(docs: DataFrame, text_col: str) -> DataFrame:
    """(gram, n): every 4-gram of classes of all whole texts."""
    return _folded_counts(block_grams(docs.select(F.lit(0).cast("bigint").alias("block"), docs[f"`{text_col}`"].cast("string").alias("text"))))


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more."""
    return _discounts_of([int((counts == k).sum()) for k in (1, 2, 3, 4)])


def _discounts_of(tally: list[int]) -> np.ndarray:
    """The same from how often counts 1 to 4 occur."""
    n1, n2, n3, n4 = (max(1, n) for n in tally)
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0, 0.05, 0.1, 0.15], [0, 0.95, 1.9, 2.85])


class KneserNey:
    """Interpolated model of classes in sorted hash arrays, one per order from 1 to ``ORDER``."""

    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray]]):
        """``orders``: per order the grams and their counts (continuation counts below the highest)."""
        self.arrays = []
        lower_probability = np.full(1, 1 / CLASSES)
        lower_grams = np.zeros(1, np.int64)
        for k, (keys, counts) in enumerate(orders, start=1):
            by = np.argsort(keys, kind="stable")
            keys, counts = keys[by], counts[by].astype(np.float64)
            history = keys >> 6
            d = _discounts(counts)
            used = d[np.minimum(counts, 3).astype(np.int64)]
            heads, inverse = np.unique(history, return_inverse=True)
            total = np.bincount(inverse, counts)
            weight = np.bincount(inverse, used) / total
            suffix = keys & ((1 << 6 * (k - 1)) - 1)
            at = np.searchsorted(lower_grams, suffix)
            p = (counts - used) / total[inverse] + weight[inverse] * lower_probability[np.minimum(at, len(lower_grams) - 1)]
            self.arrays.append((*self._hashed(keys, np.log2(p)), *self._hashed(heads, np.log2(np.maximum(weight, 1e-12)))))
            lower_grams, lower_probability = keys, p

    @staticmethod
    def _hashed(keys: np.ndarray, values: np.ndarray):
        h = mix64(keys.astype(np.uint64) + np.uint64(1))
        by = np.argsort(h)
        return h[by], values[by].astype(np.float32)

    @staticmethod
    def _find(hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix64(keys.astype(np.uint64) + np.uint64(1))
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        return at, hashes[at] == h

    def log2(self, codes: np.ndarray) -> np.ndarray:
        """log2 probability of the last class of each packed 4-gram given the others."""
        out = np.zeros(len(codes), np.float32)
        open_ = np.arange(len(codes))
        for k in range(ORDER, 0, -1):
            if not len(open_):
                return out
            gram_hash, gram_value, head_hash, head_value = self.arrays[k - 1]
            low = codes[open_] & ((1 << 6 * k) - 1)
            at, seen = self._find(gram_hash, low)
            out[open_[seen]] += gram_value[at[seen]]
            open_ = open_[~seen]
            if len(open_):
                at, seen = self._find(head_hash, low[~seen] >> 6)
                out[open_[seen]] += head_value[at[seen]]
        out[open_] -= np.log2(CLASSES)
        return out


def _class_model(counts: DataFrame) -> KneserNey | None:
    """Model of counted 4-grams of classes: at most 2**24 grams reach the driver. None without any text."""
    counts = materialise(counts, "kn-counts")

    def arrays(frame: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = frame.toArrow()
        return got.column("gram").to_numpy().astype(np.int64), got.column("n").to_numpy().astype(np.int64)

    orders = []
    current = counts
    for k in range(ORDER, 0, -1):
        orders.insert(0, arrays(current))
        if k > 1:  # continuation counts: in how many longer grams each shorter one ends
            current = current.groupBy(F.col("gram").bitwiseAND((1 << 6 * (k - 1)) - 1).alias("gram")).agg(F.count("*").alias("n"))
    return KneserNey(orders) if len(orders[-1][0]) else None


def train(docs: DataFrame, text_col: str = "text") -> KneserNey | None:
    """The class model of all whole texts of ``docs``."""
    return _class_model(_count(docs, text_col))


class Lowest:
    """The lowest order: a code point's class by the classes before it, and the code point among all of its class."""

    def __init__(self, classes: KneserNey, points: np.ndarray, counts: np.ndarray):
        """``points``, ``counts``: the code points seen, and after how many others each was."""
        by = np.argsort(points)
        self.classes, self.points, counts = classes, points[by], counts[by]
        own = _TABLE[self.points & 0xFFFF]
        used = _discounts(counts)[np.minimum(counts, 3)]
        total, left = np.bincount(own, counts, CLASSES), np.bincount(own, used, CLASSES)
        self.rest = np.where(total > 0, left, 1) / np.maximum(total, 1) / _CLASS_SIZE  # of a code point as such, seen or not
        self.share = (counts - used) / total[own] + self.rest[own]

    def class_bits(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Surprise of the class of each code point after the others."""
        return -self.classes.log2(folded(h, c)).astype(np.float64)

    def probability(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.points, c), len(self.points) - 1)
        share = np.where(self.points[at] == c, self.share[at], self.rest[_TABLE[c & 0xFFFF]])
        return share * np.exp2(-self.class_bits(h, c))


def _order(counted: DataFrame, below: DataFrame | None, k: int) -> DataFrame:
    """(h, c, a, w) of the seen grams of order ``k``: ``c`` after ``h`` has the probability a + w times that of the lowest order."""
    tally = counted.agg(*[F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)]).first()
    d = [float(x) for x in _discounts_of(list(tally))]
    of, n = Window.partitionBy("h"), F.col("n")
    total = F.sum("n").over(of)
    left = sum(F.count_if(is_n).over(of) * F.lit(d[i]) for i, is_n in ((1, n == 1), (2, n == 2), (3, n > 2)))
    used = F.when(n == 1, d[1]).when(n == 2, d[2]).otherwise(d[3])
    out = counted.select("h", "c", ((n - used) / total).alias("a"), (left / total).alias("w"))
    if below is None:
        return out
    below = below.select(F.col("h").alias("lower"), "c", F.col("a").alias("a0"), F.col("w").alias("w0"))
    out = out.withColumn("lower", F.col("h").bitwiseAND((1 << POINT_BITS * (k - 2)) - 1)).join(below, ["lower", "c"])
    return out.select("h", "c", (F.col("a") + F.col("w") * F.col("a0")).alias("a"), (F.col("w") * F.col("w0")).alias("w"))


def model_of(grams: DataFrame) -> tuple[DataFrame, Lowest | None]:
    """The model of counted grams (h, c, n): a table (h, c, bits) of the surprise of all of them and what is broadcast. None without any text."""
    counts = {ORDER: materialise(grams.groupBy("h", "c").agg(F.sum("n").alias("n")), "kn-grams")}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: in how many longer grams each shorter one ends
        shorter = F.col("h").bitwiseAND((1 << POINT_BITS * (k - 1)) - 1).alias("h")
        counts[k] = materialise(counts[k + 1].groupBy(shorter, "c").agg(F.count("*").alias("n")), f"kn-grams-{k}")
    below = None
    for k in range(2, ORDER + 1):
        below = _order(counts[k], below, k)
    classes = _class_model(_folded_counts(counts[ORDER]))
    single = counts[1].toArrow()  # a row per code point: at most 0x110000
    lowest = Lowest(classes, single.column("c").to_numpy(), single.column("n").to_numpy()) if classes else None
    sent = ship(grams.sparkSession, lowest)

    def run(batches):
        low = shipped(sent)
        for batch in batches:
            h, c, a, w = (batch.column(x).to_numpy() for x in ("h", "c", "a", "w"))
            if len(h):
                yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("c"), pa.array(-np.log2(a + w * low.probability(h, c)), pa.float32())], names=["h", "c", "bits"])

    return materialise(below.mapInArrow(run, "h bigint, c bigint, bits float"), "kn-model"), lowest


def base_rules(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    if not text:
        return 0, 0, 0, 0, 0, True
    raw = text.encode("utf-8", "replace")
    words = raw.split()  # splits at exactly \x20 and \x09-\x0D
    n = len(words)
    blanks = sum(raw.count(b) for b in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    symbols = sum(raw.count(bytes([b])) for b in _SYMBOLS)
    seen, again = set(), 0
    for line in raw.split(b"\n"):
        if line.split(None, 1):
            again += line in seen
            seen.add(line)
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        end = 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return n, len(text) - blanks, symbols, again, repeated, n < MIN_WORDS or 100 * repeated > 50 * n


def placed(docs: DataFrame, keep: list[str], text_col: str, lang_col: str) -> tuple[DataFrame, str | None, int]:
    """(row, language, text, block): ``block`` holds rows that follow each other in a file, the same in every read; where ``row`` holds the text; tasks for all texts."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:  # not a file read as it is
        docs = materialise(docs.select(*[docs[f"`{c}`"] for c in dict.fromkeys([*keep, text_col, lang_col])]), "quality-rows")
    text = docs[f"`{text_col}`"].cast("string")
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text).cast("bigint")), F.lit(0))).first()
    rows = max(1, BLOCK_BYTES * n // max(1, size))
    block = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / rows))  # blocks of the same hash would be one block
    frame = docs.select(F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row"), docs[f"`{lang_col}`"].cast("string").alias("language"), text.alias("text"), block.alias("block"))
    frame, held = once(frame, docs, text_col, keep)
    return frame, held, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)


class Answers:
    """Sorted grams of a block with their surprise."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        h, c, bits = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
        self.heads, rank = np.unique(h, return_inverse=True)
        keys = rank << POINT_BITS | c
        by = np.argsort(keys, kind="stable")
        self.keys, self.bits = keys[by], bits[by].astype(np.float64)

    def of(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        if not len(h):
            return np.zeros(0)
        keys = np.searchsorted(self.heads, h) << POINT_BITS | c
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        if not len(self.keys) or (self.keys[at] != keys).any() or (self.heads[self.keys[at] >> POINT_BITS] != h).any():
            raise RuntimeError("a text holds grams that were not counted: its rows changed between two reads")
        return self.bits[at]


def score(frame: DataFrame, held: str | None, parts: int, asked: DataFrame, model: DataFrame, lowest: Lowest | None) -> DataFrame:
    """``row``, ``language``, the base counts, base_failed, log_perplexity and class_perplexity (bits per character).

    ``frame``, ``held`` and ``parts`` as of ``placed``, ``asked`` the grams of its blocks, ``model`` and ``lowest`` as of ``model_of``.
    """
    schema = as_schema(frame, "row", "language", "n_words bigint", "word_chars bigint", "n_symbols bigint", "n_dup_lines bigint", "n_repeat_words bigint", "base_failed boolean", "log_perplexity double", "class_perplexity double", "n_chars bigint")
    sent = ship(frame.sparkSession, lowest)
    answers = asked.select("block", "h", "c").join(model, ["h", "c"]).withColumn("is_text", F.lit(False))
    both = answers.unionByName(frame.withColumn("is_text", F.lit(True)), allowMissingColumns=True)
    both = both.repartition(parts, "block").sortWithinPartitions("block", "is_text")

    def run(batches):
        low = shipped(sent)
        own, got, known = None, [], None
        for batch in batches:
            block, is_text = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("block", "is_text"))
            for start, stop in _runs(block, is_text) if batch.num_rows else ():
                if block[start] != own:
                    own, got, known = block[start], [], None
                rows = with_held(batch, held).slice(start, stop - start)
                if not is_text[start]:
                    got.append(tuple(rows.column(x).to_numpy().copy() for x in ("h", "c", "bits")))
                    continue
                if known is None:
                    known, got = Answers(got), []
                for part in slices(rows, "text", SLICE):
                    text = part.column("text")
                    base = list(zip(*(base_rules(t.as_py()) for t in text), strict=True)) or [[]] * 6
                    h, c, which, first = grams(*buffers(text))
                    size = np.diff(first)
                    values = []
                    for surprise in (known.of(h, c), low.class_bits(h, c) if len(h) else np.zeros(0)):
                        upto = np.concatenate(([0], np.cumsum(surprise[which])))
                        values.append(pa.array(np.diff(upto[first]) / np.maximum(size, 1), pa.float64(), mask=size == 0))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("row"), part.column("language"), *(pa.array(x, pa.int64()) for x in base[:5]), pa.array(base[5], pa.bool_()), *values, pa.array(size, pa.int64())],
                        names=schema.names)

    return both.mapInArrow(run, schema)


def _length_bin(n_chars):
    return F.floor(F.log2(F.greatest(n_chars, F.lit(1))) * LENGTH_BINS).cast("int")


def _groups(length: np.ndarray, gap: np.ndarray, n: np.ndarray) -> list[dict]:
    """Groups of length bins, shortest first: ``first`` bin, ``spread`` times sqrt(characters), and the length it shrinks to.

    A group is filled from the longest texts on; what is left at the short end belongs to the group above it.
    Beyond twice its shortest length the spread of a group no longer shrinks.
    """
    sizes, inverse = np.unique(length, return_inverse=True)
    per_size = np.bincount(inverse, n)
    out, stop = [], len(sizes)
    while stop:
        start = stop - 1
        while start and per_size[start:stop].sum() < MIN_GROUP:
            start -= 1
        if per_size[start:stop].sum() < MIN_GROUP and out:
            break
        cap = 2.0 ** (sizes[start] / LENGTH_BINS + 1)
        own = (inverse >= start) & (inverse < stop)
        value = gap[own] * np.sqrt(np.minimum(2.0 ** ((length[own] + 0.5) / LENGTH_BINS), cap))
        by = np.argsort(value, kind="stable")
        upto = np.cumsum(n[own][by])
        middle = value[by][np.searchsorted(upto, upto[-1] / 2)]
        out.insert(0, {"first": int(sizes[start]), "spread": float(max(1.4826 * middle, MIN_SPREAD)), "cap": float(cap)})
        stop = start
    out[0]["first"] = 0
    return out


def bands(scored: DataFrame, width: float = BAND, value: str = "log_perplexity") -> DataFrame:
    """(language, mid, groups) from exact histograms of ``value`` of the documents that pass the base rules.

    ``groups``: by length, ``reach`` times sqrt(characters) of the texts from length bin ``first`` on, up to ``cap`` characters.
    """
    hist = (scored.where(~F.col("base_failed") & F.col(value).isNotNull())
            .groupBy("language", _length_bin(F.col("n_chars")).alias("length"), F.round(F.col(value) * BINS).cast("int").alias("bin")).agg(F.count("*").alias("n")))
    kind = pa.list_(pa.struct([("first", pa.int32()), ("reach", pa.float64()), ("cap", pa.float64())]))

    def run(table):  # the histogram of a language: at most a row per length and value bin, however many documents
        length, bins, n = (table.column(c).to_numpy() for c in ("length", "bin", "n"))
        by = np.argsort(bins, kind="stable")
        upto = np.cumsum(n[by])
        mid = (bins[by][np.searchsorted(upto, upto[-1] / 2)] + bins[by][np.searchsorted(upto, upto[-1] / 2, side="right")]) / 2 / BINS
        groups = [{"first": g["first"], "reach": width * g["spread"], "cap": g["cap"]} for g in _groups(length, np.abs(bins / BINS - mid), n)]
        return pa.table({"language": table.column("language").slice(0, 1), "mid": pa.array([mid], pa.float64()), "groups": pa.array([groups], kind)})

    return hist.groupBy("language").applyInArrow(run, "language string, mid double, groups array<struct<first:int,reach:double,cap:double>>")


def quality_rules(docs: DataFrame, keep: list[str], text_col: str = "text", lang_col: str = "lang", width: float = BAND) -> DataFrame:
    """``row``, base counts, base_failed, log_perplexity, its band and ``kept`` for every row of ``docs``."""
    frame, held, parts = placed(docs, keep, text_col, lang_col)
    asked = materialise(block_grams(frame.select("block", "row" if held else "text"), held), "block-grams")
    model, lowest = model_of(asked)
    scored = materialise(score(frame, held, parts, asked, model, lowest), "quality")
    out = scored
    for value, low, high in (("class_perplexity", "class_low", "class_high"), ("log_perplexity", "low", "high")):
        band = materialise(bands(scored, width, value), "bands").select(F.col("language").alias("of"), "mid", "groups")
        out = out.join(band, out["language"].eqNullSafe(band["of"]), "left")
        out = out.withColumn("group", F.element_at(F.filter("groups", lambda g: g["first"] <= _length_bin(F.col("n_chars"))), -1))
        reach = F.col("group.reach") / F.sqrt(F.least(F.greatest(F.col("n_chars"), F.lit(1)).cast("double"), F.col("group.cap")))
        out = out.withColumn(low, F.col("mid") - reach).withColumn(high, F.col("mid") + reach).drop("of", "mid", "groups", "group")
    inside = F.col("log_perplexity").between(F.col("low"), F.col("high")) & F.col("class_perplexity").between(F.col("class_low"), F.col("class_high"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).drop("language", "class_perplexity", "class_low", "class_high", "n_chars")


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs, ["doc_id"]).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity", "low", "high")
