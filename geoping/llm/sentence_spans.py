"""Operator 10: substring dedup by sliding sentence spans.

A text is cut into sentences: at line ends, after ``.``, ``!`` or ``?`` with any closing
quotes and brackets that a blank follows, and after the stops of other scripts. From
every sentence on, and back from every sentence, the shortest run that holds ``span``
whole sentences or ``min_words`` words is hashed (96 bits over its words, so that blanks
and case do not count), the hashes of all documents are joined globally, and each sentence
that lies in a run which is not the first of its kind is removed. "First" is the smallest
(document order, sentence number): the first copy of a passage stays, all later ones go.

With ``min_words``, sentences of ``PIECE`` words and more are cut into pieces, which count as
sentences below except for ``span``: a cut follows the word of the smallest hash (the last of
equals) in each window of ``PIECE`` words of the sentence. Such cuts depend on nothing outside
their window, so copies are cut alike: in a passage that two texts share, the cuts agree from one
among its first ``PIECE`` words to one among its last ``PIECE`` words. Hence the guarantee: a later
copy of a passage of ``min_words + 2 * PIECE - 1`` words (51 as registered) loses all of it except
``PIECE`` words at most at its start and ``PIECE - 1`` at its end, whatever is around it. Characters
U+3000 to U+9FFF, written without blanks, are words of their own.

Repeats inside one document are found where the document is; the join carries one
row per document and distinct run. Hot runs cost little: the smallest id per run is
a partial aggregation, and a skew join splits the rows of a hot run.

Defined results: null and empty texts have no sentences; texts of fewer sentences
than ``span`` and fewer words than ``min_words`` are left alone; rows with equal ids (null ids
are one id, the last) count as one document and never remove each other's runs; sentences
without a word do not count: their bytes belong to the next one. The id must be an integer column.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoping.llm.common import Words, as_schema, buffers, flat, materialise, mix64, slices

SPAN = 3
#: Words of a run, and the words of a window that a long sentence is cut in, of the registered query.
MIN_WORDS, PIECE = 28, 12
_CLOSERS = "(?:" + "|".join(re.escape(c) for c in "\"')]}»›”’“」』）】》") + ")*"
_STOPS = "(?:" + "|".join("。！？｡．؟۔।॥።‼⁇⁈⁉") + ")+"
_END = re.compile(rf"\n|[.!?…]+{_CLOSERS}(?=[ \t])|{_STOPS}{_CLOSERS}".replace("[.!?…]", "(?:[.!?]|…)").encode())


def _sentences(off: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Sentence boundaries (byte positions, ends) of a batch of texts."""
    data, ends = raw.tobytes(), []
    for start, stop in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        ends.extend(m.end() for m in _END.finditer(data, start, stop))
        if stop > start and (not ends or ends[-1] != stop):
            ends.append(stop)
    return np.array(ends, np.int64)


def _cuts(words: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """Words after which a long sentence is cut: the last smallest hash of each window of ``PIECE`` words inside a sentence."""
    if len(words) < PIECE:
        return np.zeros(0, np.int64)
    inside = np.flatnonzero(sentence[PIECE - 1:] == sentence[:len(sentence) - PIECE + 1])
    least, at = words[inside], inside.copy()
    for k in range(1, PIECE):
        value = words[inside + k]
        lower = value <= least
        least[lower], at[lower] = value[lower], inside[lower] + k
    return at


def _spans(off: np.ndarray, raw: np.ndarray, span: int, min_words: int | None):
    """Per sentence (or piece) with a word: its end byte and the first of each document; per run: document, first and last sentence, hashes of 64 and 32 bits."""
    ends = _sentences(off, raw)
    wide = np.flatnonzero((raw >= 0xE3) & (raw <= 0xE9))
    words = Words(np.unique(np.concatenate((off, ends, wide, np.minimum(wide + 3, len(raw))))), raw)
    sentence = np.searchsorted(ends, words.start, side="right")
    last = np.ones(len(sentence), bool)  # last words of sentences
    last[:-1] = sentence[1:] != sentence[:-1]
    whole = last.copy()
    if min_words:
        last[_cuts(words.hash, sentence)] = True
    final = np.flatnonzero(last)
    pieces = len(final)
    ends = np.where(whole[final], ends[sentence[final]], words.end[final])
    doc = np.searchsorted(off, ends, side="left") - 1
    first = np.searchsorted(doc, np.arange(len(off)))
    upto = np.concatenate(([0], final + 1))  # words before each piece
    piece = np.arange(pieces)
    low, high = first[doc], first[doc + 1]  # pieces of the same document
    close = np.flatnonzero(whole[final])  # last and first pieces of the sentences
    open_ = np.concatenate(([0], close + 1))[:-1]
    far = np.append(close, np.full(span, pieces))
    stop = far[np.minimum(np.searchsorted(open_, piece) + span - 1, len(far) - 1)]
    near = np.concatenate((np.full(span, -1), open_))
    start = near[np.searchsorted(close, piece, side="right")]
    if min_words:
        stop = np.minimum(stop, np.searchsorted(upto, upto[:-1] + min_words) - 1)
        start = np.maximum(start, np.searchsorted(upto, upto[1:] - min_words, side="right") - 1)
    ahead, back = stop < high, start >= low
    from_ = np.maximum(start, 0)
    back &= ~(ahead[from_] & (stop[from_] == piece))  # those are there already
    begin, end = np.concatenate((piece[ahead], start[back])), np.concatenate((stop[ahead], piece[back]))
    by = np.argsort(begin, kind="stable")
    begin, end = begin[by], end[by]
    hashes = []
    for base in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95):
        up, down = (np.full(len(words.hash) + 1, np.uint64(x), np.uint64) for x in (base, pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words.hash * np.multiply.accumulate(up)[:-1], dtype=np.uint64)))
        total = (sums[upto[end + 1]] - sums[upto[begin]]) * np.multiply.accumulate(down)[upto[begin]]
        hashes.append(mix64(total + (upto[end + 1] - upto[begin]).astype(np.uint64)))
    return ends, first, doc[begin], begin, end, (hashes[0], hashes[1].astype(np.uint32))


def _span_lists(texts: DataFrame, span: int, min_words: int | None) -> DataFrame:
    """Per text: n_sentences, ``own`` (a run comes twice in it) and the hashes h1, h2 of its distinct runs, a list each."""
    schema = as_schema(texts, "id", "t1", "t2", "n_sentences bigint", "own boolean", "h1 array<bigint>", "h2 array<int>")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                off, raw = buffers(part.column("text"))
                _, first, doc, _, _, (h1, h2) = _spans(off, raw, span, min_words)
                n = len(off) - 1
                by = np.lexsort((h2, h1, doc))
                doc, h1, h2 = doc[by], h1[by], h2[by]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                own = np.bincount(doc[~new], minlength=n) > 0
                doc, h1, h2 = doc[new], h1[new].view(np.int64), h2[new].view(np.int32)
                ends = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("id", "t1", "t2")), pa.array(np.diff(first), pa.int64()), pa.array(own), pa.ListArray.from_arrays(ends, pa.array(h1)), pa.ListArray.from_arrays(ends, pa.array(h2))],
                    names=schema.names)

    return texts.select("id", "t1", "t2", "text").mapInArrow(run, schema)


def _cut(frame: DataFrame, span: int, min_words: int | None) -> DataFrame:
    """Remove the sentences under runs listed in ``gone`` (first hashes) or seen before in the text (``own``); other texts pass as they are."""
    schema = as_schema(frame, "row", "n_sentences bigint", "n_removed bigint", "removed_bytes bigint", "kept string")

    def run(batches):
        for batch in batches:
            hit = pc.or_(pc.fill_null(batch.column("own"), False), pc.is_valid(batch.column("gone")))
            rest = batch.filter(pc.invert(hit))
            none = pa.array(np.zeros(rest.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays([rest.column("row"), rest.column("n_sentences"), none, none, rest.column("text")], names=schema.names)
            for part in slices(batch.filter(hit), "text"):
                texts = flat(part.column("text"))
                off, raw = buffers(texts)
                ends, first, doc, begin, end, (h1, h2) = _spans(off, raw, span, min_words)
                own_span = np.searchsorted(doc, np.arange(len(off)))
                by = np.argsort(h1 ^ mix64(doc), kind="stable")  # the first of each kind in a text leads
                again = np.zeros(len(doc), bool)
                again[by[1:]] = (doc[by[1:]] == doc[by[:-1]]) & (h1[by[1:]] == h1[by[:-1]]) & (h2[by[1:]] == h2[by[:-1]])
                gone = part.column("gone")
                total, removed, size, kept = [], [], [], []
                for i in range(len(texts)):
                    own = ends[first[i]:first[i + 1]] - off[i]
                    mine = slice(own_span[i], own_span[i + 1])
                    bad = again[mine]
                    if len(bad) and gone[i].is_valid:
                        bad = bad | np.isin(h1[mine].view(np.int64), gone[i].values.to_numpy())
                    drop = np.zeros(len(own), bool)
                    if bad.any():
                        edge = np.zeros(len(own) + 1, np.int64)
                        np.add.at(edge, begin[mine][bad] - first[i], 1)
                        np.add.at(edge, end[mine][bad] - first[i] + 1, -1)
                        drop = np.cumsum(edge)[:-1] > 0
                    text = raw[off[i]:off[i + 1]].tobytes()
                    out = text
                    if drop.any():
                        edges = np.concatenate(([0], own))
                        out = b"".join(text[x:y] for x, y, cut in zip(edges[:-1].tolist(), own.tolist(), drop.tolist(), strict=True) if not cut) + text[own[-1]:]
                    total.append(len(own))
                    removed.append(int(drop.sum()))
                    size.append(len(text) - len(out))
                    kept.append(out.decode("utf-8", "replace") if texts[i].is_valid else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(size, pa.int64()), pa.array(kept, pa.string())],
                    names=schema.names)

    return frame.mapInArrow(run, schema)


def sentence_dedup(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, min_words: int | None = None) -> DataFrame:
    """``row``, n_sentences, n_removed, removed_bytes and ``kept`` (the remaining text) for every row of ``docs``."""
    last = (1 << 63) - 1
    base = docs.select(F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row"),
                       F.coalesce(docs[f"`{id_col}`"].cast("bigint"), F.lit(last)).alias("id"), docs[f"`{text_col}`"].cast("string").alias("text"))
    base = base.withColumn("t1", F.coalesce(F.xxhash64("text"), F.lit(0))).withColumn("t2", F.coalesce(F.xxhash64(F.lit(1), "text"), F.lit(0)))
    lists = materialise(_span_lists(base, span, min_words), "sentence-runs")  # hashed once, read twice
    rows = lists.select("id", F.explode(F.arrays_zip("h1", "h2")).alias("h")).select("id", "h.h1", "h.h2")
    firsts = rows.groupBy("h1", "h2").agg(F.min("id").alias("head"), F.max("id").alias("tail")).where("tail > head").drop("tail")
    firsts = materialise(firsts, "sentence-heads")
    later = rows.join(firsts.hint("merge"), ["h1", "h2"]).where("id > head").groupBy(F.col("id").alias("of")).agg(F.collect_set("h1").alias("gone"))
    later = materialise(later, "sentence-gone")
    # equal rows (id and text) are told alike: one answer for all of them
    told = lists.select("id", "t1", "t2", "n_sentences", "own").groupBy("id", "t1", "t2").agg(F.max("n_sentences").alias("n_sentences"), F.max("own").alias("own"))
    told = told.join(later, told["id"] == later["of"], "left").drop("of")
    joined = base.join(told.hint("merge"), ["id", "t1", "t2"])
    return _cut(joined.select("row", "text", "n_sentences", "own", "gone"), span, min_words)


def op10_sentence_spans(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sentence_dedup(docs, ["doc_id"], min_words=MIN_WORDS).select("row.doc_id", "n_sentences", "n_removed", "removed_bytes", F.col("kept").alias("text"))
