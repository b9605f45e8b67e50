"""Operator 12: periodic runs of words, by an online sparse diagonal DP.

A run is a stretch of consecutive words with smallest period q and a length of at least
``max(MIN_WORDS, MIN_POWER * q)`` that no neighbouring word extends keeping period q.

Words are read in order. A word and an earlier occurrence of it q words back lie on diagonal
q; while successive words match on it, the diagonal is active and its match length grows by
one; a diagonal that ends long enough emits its run at once. What makes the table sparse is
which earlier occurrences count: those of the word *with the words before it* at the scale of
the lag. Lags are cut into bands g <= q <= 1.5 g, and in a band the nearest earlier occurrence
of the last 3g words alone is followed. That loses nothing and adds nothing:

* In a run of smallest period q any stretch of 2q words has q as its smallest period, so the
  3g >= 2q words that end at a word of the run, 3g + q words or more into it (3g <= 3q, so there
  are such words in 4q), occur q words earlier and nowhere nearer: the band sees diagonal q.
* A diagonal found this way that covers 4q words has no smaller period: it would divide q, and
  the 3g words would occur nearer. And it ends where the run ends, as words stop matching.

So a word has one active diagonal a band at most, n log n steps in all, whatever repeats
("ha" 10^6 times, tables, nested repeats). Grams are named exactly by doubling (pairs of names
of half the length, counted inside the document), never by hashes, and a gram that occurs once
in its document drops out before the next doubling, so ordinary prose leaves the DP almost
nothing. Documents are independent: no shuffle, a batch is cut to 4 MB of text at a time.

Defined results: null, empty and blank texts have no words and no runs (a null text stays
null); rows with equal or null ids are rows like any other; the best run is the one of greatest
length / period, compared as fractions, then the first to start, then the smallest period.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoping.llm.common import SPACE_WORDS, as_schema, buffers, flat, slices, with_text

MIN_WORDS, MIN_POWER = 6, 4
_BLANKS = " \t\n\x0b\x0c\r"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def word_codes(off: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact code of every word ``[^\\x20\\x09-\\x0D]+`` of a batch of texts, and the number of words of each text."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    inside = SPACE_WORDS[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = off[:-1][off[:-1] < len(raw)]
    begins[heads] = inside[heads]
    start = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(start, off))
    before = np.concatenate(([0], np.cumsum(inside)))  # blanks left out, the words follow each other
    edges = np.append(before[start], before[-1]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(edges), pa.py_buffer(raw[inside])])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), counts


def _named(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which codes occur more than once, and dense names of those."""
    _, name, count = np.unique(code, return_inverse=True, return_counts=True)
    again = count > 1
    return again[name], (np.cumsum(again) - 1)[name]


def matches(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, lag, g): words whose last 3g words occurred ``lag`` words before, nearest first, g <= lag <= 1.5 g; by word."""
    n = len(words)
    found = []
    if n:
        _, size = np.unique(doc, return_counts=True)
        longest = int(size.max())
        base = int(words.max()) + 1
        at = np.arange(n)
        again, name = _named(doc * base + words)
        at, name = at[again], name[again]
        wide, scale, g = 1, n + 1, 1  # ``name`` holds names of the grams of ``wide`` words that begin at ``at``
        table = np.full(n, -1, np.int64)
        while len(at) and 3 * g + g <= longest:
            while 2 * wide <= 3 * g and len(at):
                table[:] = -1
                table[at] = name
                there = at + wide < n
                at, name = at[there], name[there]
                other = table[at + wide]
                there = (other >= 0) & (doc[np.minimum(at + 2 * wide - 1, n - 1)] == doc[at]) & (at + 2 * wide <= n)
                at, name, other = at[there], name[there], other[there]
                again, new = _named(name * scale + other)
                at, name = at[again], new[again]
                wide *= 2
            table[:] = -1
            table[at] = name
            rest = 3 * g - wide
            there = at + 3 * g <= n
            place, left = at[there], name[there]
            right = table[place + rest]
            there = (right >= 0) & (doc[place + 3 * g - 1] == doc[place])
            place, code = place[there], left[there] * scale + right[there]
            by = np.argsort(code, kind="stable")
            place, code = place[by], code[by]
            lag = np.diff(place)
            there = (np.diff(code) == 0) & (lag >= g) & (2 * lag <= 3 * g)
            found.append((place[1:][there] + 3 * g - 1, lag[there], np.full(int(there.sum()), g)))
            g = 3 * g // 2 + 1
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    word, lag, g = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.argsort(word, kind="stable")
    return word[by], lag[by], g[by]


def runs_of(steps) -> list[tuple[int, int, int]]:
    """The DP over the (word, lag, g) of one document, by word: (start, length, period), by start and period."""
    active: dict[int, list[int]] = {}  # lag: last word, words that match
    runs = []

    def end(lag: int) -> None:
        last, matched = active.pop(lag)
        if matched + lag >= max(MIN_WORDS, MIN_POWER * lag):
            runs.append((last - matched - lag + 1, matched + lag, lag))

    now = -1
    for word, lag, g in steps:
        if word != now:
            for old in [x for x, (last, _) in active.items() if last < word - 1]:
                end(old)
            now = word
        diagonal = active.get(lag)
        if diagonal is None:
            active[lag] = [word, 3 * g]
        else:
            diagonal[0] = word
            diagonal[1] += 1
    for old in list(active):
        end(old)
    return sorted((start, length, period) for start, length, period in runs)


def _exponent(run: tuple[int, int, int]):
    from fractions import Fraction

    return Fraction(run[1], run[2]), -run[0], -run[2]


def periodic_runs(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``row``, n_words, ``runs`` (by start, then period), ``best`` (a run or null) and ``kept``: the text's words, one blank
    between, without those that a run holds after its first ``period`` words."""
    base = with_text(docs, text_col, keep)
    run = "struct<start:bigint,length:bigint,period:bigint>"
    schema = as_schema(base, "row", "n_words bigint", f"runs array<{run}>", f"best {run}", "kept string")

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = flat(part.column("text"))
                off, raw = buffers(texts)
                codes, counts = word_codes(off, raw)
                first = np.concatenate(([0], np.cumsum(counts)))
                doc = np.repeat(np.arange(len(counts)), counts)
                word, lag, g = matches(codes, doc)
                edge = np.searchsorted(word, first)
                data = raw.tobytes()
                runs, best, kept = [], [], []
                for i, (lo, hi) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                    words, own = data[lo:hi].split(), []
                    if edge[i] < edge[i + 1]:
                        mine = slice(edge[i], edge[i + 1])
                        own = runs_of(zip((word[mine] - first[i]).tolist(), lag[mine].tolist(), g[mine].tolist(), strict=True))
                    if own:
                        stay = np.ones(len(words), bool)
                        for start, length, period in own:
                            stay[start + period:start + length] = False
                        words = [words[k] for k in np.flatnonzero(stay)]
                    named = [dict(zip(("start", "length", "period"), x, strict=True)) for x in own]
                    runs.append(named)
                    best.append(named[own.index(max(own, key=_exponent))] if own else None)
                    kept.append(b" ".join(words).decode("utf-8", "replace") if texts[i].is_valid else None)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(_RUN)),
                                                  pa.array(best, _RUN), pa.array(kept, pa.string())], names=schema.names)

    return base.mapInArrow(work, schema)


def with_periodic_tails(doc_id: Column, text: Column) -> Column:
    """The text with the periodic tail of the contract: for crc32(id) = 10 g, word i >= a = g % n becomes word
    a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8). A run of words, one blank between."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    bare = F.btrim(text, F.lit(_BLANKS))
    words = F.split(bare, "[ \\t-\\r]+")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    copies = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), copies)), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (bare != ""), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(text)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", with_periodic_tails(F.col("doc_id"), F.col("text")).alias("text"))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return periodic_runs(docs, ["doc_id"]).select(
        "row.doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("collapsed_sha256"))
