"""Operator 4: language identification by nearest centroids.

A text is the TF-IDF vector of its hashed character n-grams (one to three letters
inside words, ``DIMENSIONS`` features), scaled to length one. Document frequencies are
counted over all training rows. Every language gets up to ``CENTROIDS`` centroids by
spherical k-means over a bounded sample of its training rows (``SAMPLE`` per
language, the smallest by a hash of the id and text). A text gets the language of the
centroid with the largest cosine.

Distance-based rejection: each centroid has a radius, the largest distance but
``OUTSIDE`` of its own sample rows, widened by half; a text farther from its centroid
than that is marked ``rejected`` (its nearest language is still reported).

The model has at most languages x centroids x dimensions numbers; languages beyond
``MAX_LANGUAGES`` raise an error instead of being dropped.

Defined results: null texts and texts without a letter are ``und`` with score 0;
training rows with a null language or without a letter teach nothing; without any
training row every prediction is ``und``; repeated rows count as often as they occur;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoping.llm.common import as_schema, buffers, flat, materialise, mix64, ship, shipped, slices

DIMENSIONS = 4096
CENTROIDS = 4
SAMPLE = 2000
MAX_LANGUAGES = 500
OUTSIDE = 0.01
ROUNDS = 12


def letters(points: np.ndarray) -> np.ndarray:
    """Which code points are letters (by Python's ``isalpha``), from a table of those present."""
    present = np.unique(points)
    table = np.fromiter((chr(p).isalpha() for p in present.tolist()), bool, len(present))
    return table[np.searchsorted(present, points)]


def features(off: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse counts of a batch: document, feature and count arrays (sorted), and the number of letters per document."""
    heads = (raw & 0xC0) != 0x80
    first = np.concatenate(([0], np.cumsum(heads)))[off]
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)
    if len(points) != first[-1]:  # lower-casing changed the length: lower-case the code points one by one
        points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        present, inverse = np.unique(points, return_inverse=True)
        points = np.array([ord(chr(p).lower()[0]) for p in present.tolist()], np.uint32)[inverse] if len(present) else points
    n_docs = len(off) - 1
    if not len(points):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(n_docs, np.int64)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    is_letter = letters(points)
    count = np.bincount(doc[is_letter], minlength=n_docs)
    # a blank stands for everything that is not a letter
    code = np.where(is_letter, points, 0).astype(np.uint64)
    keys = []
    gram = np.zeros(len(code), np.uint64)
    live = np.ones(len(code), bool)
    for width in (1, 2, 3):
        back = width - 1
        shifted = np.zeros_like(code)
        shifted[back:] = code[:len(code) - back]
        if back:
            live[back:] &= doc[back:] == doc[:-back]
            live[:back] = False
        gram = gram * np.uint64(0x110001) + shifted
        inside = live & (is_letter if width == 1 else (gram != 0))
        if width == 3:  # the middle is a letter
            middle = np.zeros(len(code), bool)
            middle[1:] = is_letter[:-1]
            inside &= middle
        hashed = mix64(gram[inside] * np.uint64(4) + np.uint64(width)) % np.uint64(DIMENSIONS)
        keys.append(doc[inside].astype(np.int64) * DIMENSIONS + hashed.astype(np.int64))
    key = np.concatenate(keys)
    if n_docs * DIMENSIONS <= 1 << 24:
        table = np.bincount(key, minlength=n_docs * DIMENSIONS)
        seen = np.flatnonzero(table)
        times = table[seen]
    else:
        seen, times = np.unique(key, return_counts=True)
    return seen // DIMENSIONS, seen % DIMENSIONS, times, count


def vectors(off: np.ndarray, raw: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense unit TF-IDF vectors of a batch and the number of letters per document."""
    doc, feature, times, count = features(off, raw)
    out = np.zeros((len(off) - 1, DIMENSIONS), np.float32)
    out[doc, feature] = (1 + np.log(times)) * idf[feature] if len(doc) else 0
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))
    out /= np.maximum(norm, 1e-12)[:, None]
    return out, count


def _document_frequencies(train: DataFrame) -> DataFrame:
    """(feature, n) over all training rows, -1 for the number of rows; summed in each task before the shuffle."""

    def run(batches):
        total = np.zeros(DIMENSIONS + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                _, feature, _, count = features(*buffers(part.column("text")))
                total[:DIMENSIONS] += np.bincount(feature, minlength=DIMENSIONS)
                total[DIMENSIONS] += int((count > 0).sum())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(at == DIMENSIONS, -1, at), pa.int32()), pa.array(total[at], pa.int64())], names=["feature", "n"])

    return train.select("text").mapInArrow(run, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))


def cluster(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means with k-means++ starts: unit centroids (fewer if the rows are fewer)."""
    rng = np.random.default_rng(seed)
    centres = x[[int(rng.integers(len(x)))]]
    while len(centres) < min(k, len(x)):
        gap = np.maximum(1 - (x @ centres.T).max(axis=1), 0) ** 2
        if gap.sum() <= 1e-9:
            break
        centres = np.vstack([centres, x[int(rng.choice(len(x), p=gap / gap.sum()))]])
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1)
        live = norm > 0
        new = sums[live] / norm[live, None]
        if new.shape == centres.shape and np.allclose(new, centres, atol=1e-6):
            break
        centres = new
    return centres


class Centroids:
    def __init__(self, idf: np.ndarray, languages: list[str], centres: np.ndarray, owner: np.ndarray, radius: np.ndarray):
        self.idf, self.languages, self.centres, self.owner, self.radius = idf, languages, centres, owner, radius

    def predict(self, off: np.ndarray, raw: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection per document."""
        x, count = vectors(off, raw, self.idf)
        cosine = x @ self.centres.T
        near = cosine.argmax(axis=1)
        best = np.clip(cosine[np.arange(len(near)), near], 0, 1)
        live = count > 0
        names = [self.languages[self.owner[k]] if ok else "und" for k, ok in zip(near.tolist(), live.tolist(), strict=True)]
        return names, np.where(live, best, 0.0), ~live | (1 - best > self.radius[near])


def train(rows: DataFrame, id_col: str = "id", sample: int = SAMPLE) -> Centroids | None:
    """``rows``: id, text, lang of the training rows."""
    rows = rows.where("text is not null and lang is not null")
    counts = {r["feature"]: r["n"] for r in _document_frequencies(rows).collect()}
    total = counts.pop(-1, 0)
    if not total:
        return None
    df = np.zeros(DIMENSIONS)
    df[list(counts)] = list(counts.values())
    idf = np.log((1 + total) / (1 + df)) + 1
    tongues = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(tongues) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(r["lang"] for r in tongues)
    size = {r["lang"]: r["n"] for r in tongues}
    # a hash decides who may enter the sample; the share is small for large languages, so that little is moved
    draw = F.pmod(F.xxhash64(F.lit(17), id_col, "text"), F.lit(1 << 40)) / float(1 << 40)
    centres, owner, radius = [], [], []
    for number, lang in enumerate(languages):
        share = min(1.0, 2.0 * sample / size[lang] + 50 / max(size[lang], 1))
        own = rows.where((F.col("lang") == lang) & (draw < share)).select("text", draw.alias("draw"), id_col).orderBy("draw", id_col).limit(sample)
        x = _sample_vectors(own, idf)
        if not len(x):
            continue
        found = cluster(x, CENTROIDS)
        cosine = x @ found.T
        near = cosine.argmax(axis=1)
        gap = 1 - cosine.max(axis=1)
        for k in range(len(found)):
            mine = gap[near == k]
            radius.append(1.5 * float(np.quantile(mine, 1 - OUTSIDE)) if len(mine) else 1.0)
        centres.append(found)
        owner += [number] * len(found)
    if not centres:
        return None
    return Centroids(idf, languages, np.vstack(centres).astype(np.float32), np.array(owner), np.array(radius))


def _sample_vectors(own: DataFrame, idf: np.ndarray) -> np.ndarray:
    """Vectors of the sample rows, made on the executors: SAMPLE x DIMENSIONS half-precision numbers at most reach the driver."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                x, count = vectors(*buffers(part.column("text")), idf)
                live = np.flatnonzero(count > 0)
                blobs = [x[i].astype(np.float16).tobytes() for i in live]
                yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary())], names=["x"])

    got = own.select("text").mapInArrow(run, "x binary").toArrow().column("x").to_pylist()
    x = np.frombuffer(b"".join(got), np.float16).reshape(-1, DIMENSIONS).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if len(x) else x


def identify(docs: DataFrame, model: Centroids | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """``row``, lang_pred, score and rejected for every row of ``docs``."""
    frame = docs.select(F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row"), docs[f"`{text_col}`"].cast("string").alias("text"))
    schema = as_schema(frame, "row", "lang_pred string", "score double", "rejected boolean")
    sent = ship(docs.sparkSession, model)

    def run(batches):
        known = shipped(sent)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                n = part.num_rows
                if known is None:
                    names, score, out = ["und"] * n, np.zeros(n), np.ones(n, bool)
                else:
                    names, score, out = [], [], []
                    # a dense vector per text: a bounded number of texts at a time
                    for i in range(0, n, 1024):
                        a, b, c = known.predict(*buffers(flat(part.column("text").slice(i, 1024))))
                        names += a
                        score.append(b)
                        out.append(c)
                    score, out = np.concatenate(score), np.concatenate(out)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], names=schema.names)

    return frame.mapInArrow(run, schema)


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.where(fold(F.col("doc_id"), 3) != 1).select(F.col("doc_id").alias("id"), "text", "lang")
    out = identify(docs, train(rows), ["doc_id"])
    return out.select("row.doc_id", (fold(F.col("row.doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")
