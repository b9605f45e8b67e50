"""Operator 7: quality classifier by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w x), with one shared weight vector over hashed
text and ordered thresholds (each is the one before plus an exponential). x are the
hashed words and character 4-grams of the whole text (log counts, scaled to length
one) and a few shares (capitals, digits, marks, repeated words, line lengths). Training is
stochastic gradient descent with decay over a bounded sample of rated rows (``SAMPLE`` per
grade, smallest by a hash); grades are weighted by their number among all rated rows.

Each text gets its expected grade and the tail probability of the highest grade; it is
selected when that probability is at least ``SELECT``.

Defined results: null, empty and wordless texts have grade 0, tail 0 and are not
selected; rows with a null rating teach nothing; with fewer than two grades among the rated
rows every text gets that grade (0 without any); a document with several ratings counts
with each; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoping.llm.common import LOWER, SPACE_WORDS, Words, as_schema, buffers, flat, materialise, mix64, ship, shipped, slices
from geoping.llm.language_id import fold

BUCKETS = 1 << 15
SHARES = 8
SAMPLE = 2500
EPOCHS = 12
SELECT = 0.5


def features(off: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of a batch: where each document begins, columns, values; and the number of words."""
    n = len(off) - 1
    words = Words(off, raw, SPACE_WORDS, lower=False)
    doc_of_word = np.repeat(np.arange(n), words.counts)
    keys = [doc_of_word * (2 * BUCKETS) + (words.hash % np.uint64(BUCKETS)).astype(np.int64)]
    low = LOWER[raw].astype(np.uint64)
    doc = np.repeat(np.arange(n), np.diff(off))
    if len(raw) >= 4:
        code = low[:-3] | low[1:-2] << np.uint64(8) | low[2:-1] << np.uint64(16) | low[3:] << np.uint64(24)
        same = doc[:-3] == doc[3:]
        keys.append(doc[:-3][same] * (2 * BUCKETS) + BUCKETS + (mix64(code[same] + np.uint64(7)) % np.uint64(BUCKETS)).astype(np.int64))
    key, times = np.unique(np.concatenate(keys), return_counts=True)
    row, column, value = key // (2 * BUCKETS), key % (2 * BUCKETS), np.log1p(times)
    norm = np.sqrt(np.bincount(row, value ** 2, minlength=n))
    value = value / np.maximum(norm, 1e-9)[row]
    size = np.maximum(np.diff(off), 1)
    share = lambda mask: np.bincount(doc[mask], minlength=n) / size
    distinct = np.bincount(np.unique(doc_of_word * np.int64(1 << 40) + (words.hash >> np.uint64(24)).astype(np.int64)) >> 40, minlength=n) if len(words.hash) else np.zeros(n)
    marks = np.isin(raw, np.frombuffer(b"#*$%&|<>!", np.uint8))
    extra = np.stack([
        np.ones(n), share((raw >= 65) & (raw <= 90)), share((raw >= 48) & (raw <= 57)), share(marks), share(raw == 10),
        distinct / np.maximum(words.counts, 1), np.log1p(words.counts) / 10, share(raw == 124)], axis=1)
    rows = np.concatenate([row, np.repeat(np.arange(n), SHARES)])
    columns = np.concatenate([column, np.tile(2 * BUCKETS + np.arange(SHARES), n)])
    values = np.concatenate([value, extra.ravel()])
    by = np.argsort(rows, kind="stable")
    return np.searchsorted(rows[by], np.arange(n + 1)), columns[by], values[by].astype(np.float32), words.counts


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class CumulativeLink:
    """Shared weights and ordered thresholds for the grades ``0 .. levels - 1``."""

    def __init__(self, levels: int):
        self.levels = levels
        self.w = np.zeros(2 * BUCKETS + SHARES)
        self.free = np.concatenate([[-(levels - 2) / 2], np.zeros(max(0, levels - 2))])

    def thresholds(self) -> np.ndarray:
        return np.concatenate([self.free[:1], self.free[0] + np.cumsum(np.exp(self.free[1:]))])

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        """P(grade) by row."""
        below = _sigmoid(self.thresholds()[None, :] - z[:, None])
        edge = np.concatenate([np.zeros((len(z), 1)), below, np.ones((len(z), 1))], axis=1)
        return np.maximum(np.diff(edge, axis=1), 1e-12)

    def slopes(self, z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the negative log-likelihood: by z, and by each threshold, per row."""
        below = _sigmoid(self.thresholds()[None, :] - z[:, None])
        dense = below * (1 - below)
        p = self.probabilities(z)[np.arange(len(z)), y]
        up, down = np.zeros(len(z)), np.zeros(len(z))
        has_up, has_down = y < self.levels - 1, y > 0
        rows = np.arange(len(z))
        up[has_up] = dense[rows[has_up], y[has_up]]
        down[has_down] = dense[rows[has_down], y[has_down] - 1]
        t = np.zeros_like(dense)
        t[rows[has_up], y[has_up]] -= up[has_up] / p[has_up]
        t[rows[has_down], y[has_down] - 1] += down[has_down] / p[has_down]
        return (up - down) / p, t

    def dot(self, ptr, columns, values) -> np.ndarray:
        return np.add.reduceat(values * self.w[columns], ptr[:-1]) if len(ptr) > 1 else np.zeros(0)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, seed: int = 9, rate: float = 0.5, decay: float = 1e-5) -> None:
        rng = np.random.default_rng(seed)
        square, square_t = np.full(len(self.w), 1e-6), np.full(len(self.free), 1e-6)
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), 64):
                pick = order[i:i + 64]
                ptr = np.concatenate(([0], np.cumsum([len(rows[j][0]) for j in pick])))
                columns, values = (np.concatenate([rows[j][k] for j in pick]) for k in (0, 1))
                z = self.dot(ptr, columns, values)
                dz, dt = self.slopes(z, y[pick])
                dz, dt = dz * weight[pick] / len(pick), (dt * weight[pick][:, None]).sum(axis=0) / len(pick)
                touched, inverse = np.unique(columns, return_inverse=True)
                g = np.bincount(inverse, values * np.repeat(dz, np.diff(ptr))) + decay * self.w[touched]
                square[touched] += g ** 2
                self.w[touched] -= rate * g / np.sqrt(square[touched])
                # thresholds: the first one moves all, every later step those from it on
                down = np.cumsum(dt[::-1])[::-1]
                g = np.concatenate([down[:1], down[1:] * np.exp(self.free[1:])])
                square_t += g ** 2
                self.free -= 0.1 * g / np.sqrt(square_t)


def train(rated: DataFrame, sample: int = SAMPLE) -> CumulativeLink | int:
    """``rated``: id, text, grade (0, 1, ...). The model, or the only grade there is."""
    rated = rated.where("text is not null and grade is not null and grade >= 0")
    counts = {r["grade"]: r["n"] for r in rated.groupBy("grade").agg(F.count("*").alias("n")).orderBy("grade").limit(101).collect()}
    if len(counts) > 100 or max(counts, default=0) > 99:
        raise ValueError("grades are 0 to 99")
    if len(counts) < 2:
        return next(iter(counts), 0)
    draw = F.pmod(F.xxhash64(F.lit(29), "id", "text"), F.lit(1 << 40)) / float(1 << 40)
    parts = None
    for grade, n in sorted(counts.items()):
        share = min(1.0, (2.0 * sample + 50) / n)
        part = rated.where((F.col("grade") == grade) & (draw < share)).withColumn("draw", draw).orderBy("draw", "id").limit(sample).select("text", "grade")
        parts = part if parts is None else parts.unionByName(part)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ptr, columns, values, _ = features(*buffers(flat(part.column("text"))))
                blobs = [columns[a:b].astype(np.int32).tobytes() + values[a:b].tobytes() for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), part.column("grade").cast(pa.int32())], names=["x", "y"])

    got = parts.mapInArrow(run, "x binary, y int").toArrow()
    blobs = got.column("x").to_pylist()
    order = sorted(range(len(blobs)), key=blobs.__getitem__)  # whatever order the tasks came in
    rows = [(np.frombuffer(blobs[i], np.int32, len(blobs[i]) // 8).astype(np.int64), np.frombuffer(blobs[i], np.float32, len(blobs[i]) // 8, len(blobs[i]) // 2)) for i in order]
    y = got.column("y").to_numpy().astype(np.int64)[order]
    taken = np.bincount(y, minlength=max(counts) + 1)
    weight = np.array([counts.get(k, 0) / max(taken[k], 1) for k in range(len(taken))])
    weight = np.sqrt(weight / weight[taken > 0].mean())  # between the true shares and equal ones
    model = CumulativeLink(max(counts) + 1)
    model.fit(rows, y, weight[y])
    return model


def grade(docs: DataFrame, model: CumulativeLink | int, keep: list[str], text_col: str = "text") -> DataFrame:
    """``row``, expected_grade, tail_probability (of the highest grade), grade_pred and selected for every row of ``docs``."""
    frame = docs.select(F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row"), docs[f"`{text_col}`"].cast("string").alias("text"))
    schema = as_schema(frame, "row", "expected_grade double", "tail_probability double", "grade_pred int", "selected boolean")
    sent = ship(docs.sparkSession, model)

    def run(batches):
        known = shipped(sent)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ptr, columns, values, words = features(*buffers(flat(part.column("text"))))
                n = part.num_rows
                if isinstance(known, int):
                    p = np.zeros((n, known + 1))
                    p[:, known] = 1
                else:
                    p = known.probabilities(known.dot(ptr, columns, values))
                p[words == 0] = 0
                mean, tail = p @ np.arange(p.shape[1]), p[:, -1]
                best = np.where(words > 0, p.argmax(axis=1), 0)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(mean, pa.float64()), pa.array(tail, pa.float64()), pa.array(best, pa.int32()), pa.array(tail >= SELECT, pa.bool_())], names=schema.names)

    return frame.mapInArrow(run, schema)


def rating(quality, toxic):
    """Three grades from the given labels: 0 bad quality, 1 good but toxic, 2 good and not toxic."""
    return F.when(quality == 0, 0).when((quality == 1) & (toxic == 1), 1).when((quality == 1) & (toxic == 0), 2)


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Learns from rated rows whose crc32(doc_id) modulo 5 is not 0; grades all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("of"), rating(F.col("quality"), F.col("toxic")).alias("grade"))
    rated = docs.select(F.col("doc_id").alias("id"), "text").where(fold(F.col("doc_id"), 5) != 0).join(labels.hint("merge"), F.col("id") == F.col("of")).select("id", "text", "grade")  # one plan at every size
    out = grade(docs, train(materialise(rated, "quality-rated")), ["doc_id"])
    return out.select("row.doc_id", (fold(F.col("row.doc_id"), 5) == 0).alias("held_out"), "expected_grade", "tail_probability", "grade_pred", "selected")
