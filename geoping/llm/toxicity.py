"""Operator 5: toxicity by a bidirectional gated recurrent network with attention pooling.

A text is scored in overlapping windows of ``WINDOW`` words, ``STRIDE`` apart, all of
them; the document's score is that of its highest window. Each word enters as

* a word input: a learned embedding of its hash, and the log-odds of its hash, and
* a character input: the mean of learned embeddings of its character 3- and 5-grams, and the
  largest and the mean log-odds of these,

where the log-odds (toxic against other documents) are counted over all labelled
training rows (a training window's are those without its own row). The network is trained in numpy on the driver over windows of a bounded
sample of labelled rows (``SAMPLE`` toxic and twice as many others, smallest by a
hash): of a toxic document the window with the largest log-odds, of another one that
window and one chosen by a hash. Labels, language, source and id are no inputs.

Defined results: null, empty and wordless texts score the share of toxic rows in
training; without training rows of both classes every text scores 0; labels that are null
are left out, a document with several labels counts with each; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoping.llm.common import BYTE_CODES, LOWER, Words, as_schema, buffers, flat, materialise, mix64, ship, shipped, slices
from geoping.llm.language_id import fold

WINDOW = 64
STRIDE = 32
SAMPLE = 1500
BUCKETS = 1 << 18
EMBEDDINGS = 1 << 12
WIDTH = 6
HIDDEN = 8
EPOCHS = 8
BATCH = 128
#: Words are runs of letters, digits and all bytes beyond ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[48:58] = WORD_BYTES[65:91] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True


def grams(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 3- and 5-grams of bytes of each word, with marks at its ends, and where each word begins."""
    size = end - start + 2
    ptr = np.concatenate(([0], np.cumsum(size)))
    total = int(ptr[-1])
    word = np.repeat(np.arange(len(start)), size)
    at = np.arange(total) - ptr[word]
    code = np.zeros(total, np.uint64)
    inner = (at > 0) & (at < size[word] - 1)
    code[inner] = BYTE_CODES[LOWER][raw[(start[word] + at - 1)[inner]]]
    code[at == 0], code[at == size[word] - 1] = np.uint64(0x51ED270B0A1F39C1), np.uint64(0xA24BAED4963EE407)
    out, owner = [], []
    for width in (3, 5):
        fits = np.flatnonzero(at + width <= size[word])
        h = np.zeros(len(fits), np.uint64)
        for k in range(width):
            h = h * np.uint64(0x9E3779B97F4A7C15) + code[fits + k]
        out.append(mix64(h + np.uint64(width)))
        owner.append(word[fits])
    owner = np.concatenate(owner)
    by = np.argsort(owner, kind="stable")
    return np.concatenate(out)[by], np.searchsorted(owner[by], np.arange(len(start) + 1))


class Batch:
    """Distinct words of a batch of texts and its windows as numbers of these (-1: no word)."""

    def __init__(self, off: np.ndarray, raw: np.ndarray):
        words = Words(off, raw, WORD_BYTES)
        self.counts = words.counts
        self.hash, first, token = np.unique(words.hash, return_index=True, return_inverse=True)
        self.gram, self.ptr = grams(raw, words.start[first], words.end[first])
        n = words.counts
        per = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1, 0)
        self.doc = np.repeat(np.arange(len(n)), per)
        begin = (np.arange(len(self.doc)) - np.repeat(np.cumsum(per) - per, per)) * STRIDE
        place = begin[:, None] + np.arange(WINDOW)[None, :]
        inside = place < n[self.doc][:, None]
        flat_place = np.where(inside, place + words.first[self.doc][:, None], 0)
        self.index = np.where(inside, token[flat_place] if len(token) else 0, -1).astype(np.int32)
        self.token, self.first = token, words.first


def _odds(labelled: DataFrame):
    """Log-odds of word and gram buckets over all labelled rows; the same for the training rows of each class
    (without the row itself); the numbers of toxic and other rows."""

    def run(batches):
        total = np.zeros((2, 2, BUCKETS), np.int64)
        rows = np.zeros(2, np.int64)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
                b = Batch(*buffers(part.column("text")))
                rows += np.bincount(toxic, minlength=2)
                for i, y in enumerate(toxic.tolist()):
                    own = np.unique(b.token[b.first[i]:b.first[i + 1]])
                    total[y, 0][np.unique((b.hash[own] % np.uint64(BUCKETS)).astype(np.int64))] += 1
                    spots = np.concatenate([b.gram[b.ptr[w]:b.ptr[w + 1]] for w in own]) if len(own) else np.zeros(0, np.uint64)
                    total[y, 1][np.unique((spots % np.uint64(BUCKETS)).astype(np.int64))] += 1
        flat_total = total.reshape(-1)
        at = np.flatnonzero(flat_total)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i:i + 100_000], pa.int64()), pa.array(flat_total[at[i:i + 100_000]], pa.int64())], names=["at", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2], pa.int64()), pa.array(rows, pa.int64())], names=["at", "n"])

    got = labelled.select("text", "toxic").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = got.column("at").to_numpy(), got.column("n").to_numpy()
    table = np.zeros(4 * BUCKETS)
    table[at[at >= 0]] = n[at >= 0]
    rows = [int(n[at == k].sum()) for k in (-1, -2)]
    table = table.reshape(2, 2, BUCKETS)

    def odds(without: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds; ``without``: as a row of that class sees them that is not counted itself."""
        counts = [np.maximum(table[y] - (y == without), 0) for y in (0, 1)]
        share = [(counts[y] + 0.5) / (rows[y] + 1) for y in (0, 1)]
        # a bucket that few documents have says little
        value = (np.log(share[1]) - np.log(share[0])) * np.minimum(1, (counts[0] + counts[1]) / 10)
        return value[0].astype(np.float32), value[1].astype(np.float32)

    return odds(None), [odds(0), odds(1)], rows[1], rows[0]


def prior(batch: Batch, odds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Three fixed inputs per distinct word."""
    if not len(batch.hash):
        return np.zeros((0, 3), np.float32)
    value = odds[1][(batch.gram % np.uint64(BUCKETS)).astype(np.int64)]
    high = np.maximum.reduceat(value, batch.ptr[:-1])
    mean = np.add.reduceat(value, batch.ptr[:-1]) / np.diff(batch.ptr)
    return np.stack([odds[0][(batch.hash % np.uint64(BUCKETS)).astype(np.int64)], high, mean], axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Bidirectional GRU, attention pooling and a logistic output."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        inputs = 3 + 2 * WIDTH
        near = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"words": 0.1 * rng.standard_normal((EMBEDDINGS, WIDTH)).astype(np.float32), "chars": 0.1 * rng.standard_normal((EMBEDDINGS, WIDTH)).astype(np.float32)}
        for side in "fb":
            self.p |= {f"W{side}": near(inputs, 3 * HIDDEN), f"U{side}": near(HIDDEN, 3 * HIDDEN), f"b{side}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": near(2 * HIDDEN, HIDDEN), "a": np.zeros(HIDDEN, np.float32), "v": near(HIDDEN), "o": near(2 * HIDDEN), "c": np.zeros(1, np.float32)}

    def inputs(self, word: np.ndarray, char: np.ndarray, ptr: np.ndarray, fixed: np.ndarray) -> np.ndarray:
        """Input vectors of distinct words."""
        if not len(word):
            return np.zeros((0, 3 + 2 * WIDTH), np.float32)
        mean = np.add.reduceat(self.p["chars"][char], ptr[:-1], axis=0) / np.diff(ptr)[:, None]
        return np.concatenate([0.5 * fixed, self.p["words"][word], mean], axis=1).astype(np.float32)

    def _run(self, x: np.ndarray, index: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        u, h_size = self.p[f"U{side}"], HIDDEN
        projected = np.vstack([x @ self.p[f"W{side}"] + self.p[f"b{side}"], np.zeros((1, 3 * h_size), np.float32)])
        n, steps = index.shape
        h = np.zeros((n, h_size), np.float32)
        out = np.zeros((steps, n, h_size), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            here = index[:, t] >= 0
            g = projected[index[:, t]]
            hu = h @ u
            zr = _sigmoid(g[:, :2 * h_size] + hu[:, :2 * h_size])
            z, r = zr[:, :h_size], zr[:, h_size:]
            new = np.tanh(g[:, 2 * h_size:] + r * hu[:, 2 * h_size:])
            nxt = np.where(here[:, None], new + z * (h - new), h)
            if keep is not None:
                keep.append((t, here, h, hu, z, r, new))
            h = nxt
            out[t] = h
        return out

    def forward(self, x: np.ndarray, index: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; ``x``: input vectors of the distinct words."""
        f, b = ([], []) if keep is not None else (None, None)
        h = np.concatenate([self._run(x, index, "f", f), self._run(x, index, "b", b)], axis=2)
        u = np.tanh(h @ self.p["A"] + self.p["a"])
        e = np.where(index.T >= 0, u @ self.p["v"], -1e9)
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", alpha, h)
        if keep is not None:
            keep.update(f=f, b=b, h=h, u=u, alpha=alpha, pooled=pooled)
        return pooled @ self.p["o"] + self.p["c"][0]

    def gradients(self, x: np.ndarray, index: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean logistic loss; also that of ``x`` (each place of the windows has its own row)."""
        k: dict = {}
        logit = self.forward(x, index, k)
        g = {}
        d = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
        g["o"], g["c"] = k["pooled"].T @ d, np.array([d.sum()], np.float32)
        d_pool = d[:, None] * self.p["o"]
        d_alpha = np.einsum("nh,tnh->tn", d_pool, k["h"])
        d_h = k["alpha"][:, :, None] * d_pool[None]
        d_e = k["alpha"] * (d_alpha - (k["alpha"] * d_alpha).sum(axis=0))
        g["v"] = np.einsum("tn,tna->a", d_e, k["u"])
        d_u = d_e[:, :, None] * self.p["v"] * (1 - k["u"] ** 2)
        g["a"] = d_u.sum(axis=(0, 1))
        g["A"] = np.einsum("tnh,tna->ha", k["h"], d_u)
        d_h += d_u @ self.p["A"].T
        d_x = np.zeros_like(x)
        for side, part in (("f", d_h[:, :, :HIDDEN]), ("b", d_h[:, :, HIDDEN:])):
            u = self.p[f"U{side}"]
            g_u, d_g_all = np.zeros_like(u), np.zeros((len(x) + 1, 3 * HIDDEN), np.float32)
            back = np.zeros_like(part[0])
            for t, here, h, hu, z, r, new in reversed(k[side]):
                total = back + part[t]
                on = total * here[:, None]
                d_new = on * (1 - z) * (1 - new ** 2)
                d_z = on * (h - new) * z * (1 - z)
                d_r = d_new * hu[:, 2 * HIDDEN:] * r * (1 - r)
                d_g = np.concatenate([d_z, d_r, d_new], axis=1)
                d_hu = np.concatenate([d_z, d_r, d_new * r], axis=1)
                g_u += h.T @ d_hu
                back = total * ~here[:, None] + on * z + d_hu @ u.T
                d_g_all[index[here, t]] += d_g[here]  # every place is a row of its own
            d_g_all = d_g_all[:-1]
            g[f"U{side}"], g[f"W{side}"], g[f"b{side}"] = g_u, x.T @ d_g_all, d_g_all.sum(axis=0)
            d_x += d_g_all @ self.p[f"W{side}"].T
        return g, d_x

    def fit(self, windows: list[tuple], y: np.ndarray, seed: int = 5, rate: float = 0.01) -> None:
        """``windows``: per window (word ids, char ids, ptr, fixed inputs), one entry per place."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), BATCH):
                pick = order[i:i + BATCH]
                word, char, ptr, fixed, index = pack([windows[j] for j in pick])
                x = self.inputs(word, char, ptr, fixed)
                g, d_x = self.gradients(x, index, y[pick])
                g["words"], g["chars"] = np.zeros_like(self.p["words"]), np.zeros_like(self.p["chars"])
                np.add.at(g["words"], word, d_x[:, 3:3 + WIDTH])
                per = d_x[:, 3 + WIDTH:] / np.diff(ptr)[:, None]
                np.add.at(g["chars"], char, np.repeat(per, np.diff(ptr), axis=0))
                step += 1
                for k, v in self.p.items():
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    v -= (rate * 0.5 ** (epoch / 2) * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)


def pack(windows: list[tuple]):
    """Windows side by side: their words one after the other, and the index matrix."""
    index = np.full((len(windows), WINDOW), -1, np.int32)
    ptr, n_words, n_chars = [np.zeros(1, np.int64)], 0, 0
    for i, (word, char, own, _) in enumerate(windows):
        index[i, :len(word)] = n_words + np.arange(len(word))
        ptr.append(n_chars + own[1:])
        n_words += len(word)
        n_chars += len(char)
    word, char, _, fixed = zip(*windows, strict=True)
    return np.concatenate(word), np.concatenate(char), np.concatenate(ptr), np.concatenate(fixed), index


def _ids(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    return ((batch.hash >> np.uint64(20)) % np.uint64(EMBEDDINGS)).astype(np.int64), ((batch.gram >> np.uint64(20)) % np.uint64(EMBEDDINGS)).astype(np.int64)


def _training_windows(rows: DataFrame, odds) -> tuple[list[tuple], np.ndarray]:
    """Windows of the sampled rows, cut on the executors: a few KB each reach the driver."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                b = Batch(*buffers(flat(part.column("text"))))
                by_class = [prior(b, odds[y]) for y in (0, 1)]
                word, char = _ids(b)
                blobs, label = [], []
                for i, y in enumerate(part.column("toxic").to_pylist()):
                    own = np.arange(*np.searchsorted(b.doc, [i, i + 1]))
                    if not len(own):
                        continue
                    fixed = by_class[y]
                    heat = np.where(b.index[own] >= 0, fixed[b.index[own], 1], -1e9).max(axis=1)
                    chosen = {int(own[heat.argmax()])}
                    if not y:
                        chosen.add(int(own[int(b.counts[i]) * 7919 % len(own)]))
                    for k in chosen:
                        at = b.index[k][b.index[k] >= 0]
                        pieces = [char[b.ptr[w]:b.ptr[w + 1]] for w in at]
                        size = np.array([len(q) for q in pieces], np.int32)
                        blobs.append(np.concatenate([np.array([len(at)], np.int32), word[at].astype(np.int32), size, np.concatenate(pieces).astype(np.int32)]).tobytes() + fixed[at].tobytes())
                        label.append(int(y))
                yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(label, pa.int32())], names=["w", "y"])

    got = rows.select("text", "toxic").mapInArrow(run, "w binary, y int").toArrow()
    windows = []
    for blob in got.column("w").to_pylist():
        n = int(np.frombuffer(blob, np.int32, 1)[0])
        size = np.frombuffer(blob, np.int32, n, 4 + 4 * n)
        ptr = np.concatenate(([0], np.cumsum(size)))
        windows.append((np.frombuffer(blob, np.int32, n, 4).astype(np.int64), np.frombuffer(blob, np.int32, int(ptr[-1]), 4 + 8 * n).astype(np.int64), ptr, np.frombuffer(blob, np.float32, 3 * n, 4 + 8 * n + 4 * int(ptr[-1])).reshape(n, 3)))
    order = sorted(range(len(windows)), key=lambda i: got.column("w")[i].as_py())  # whatever order the tasks came in
    return [windows[i] for i in order], got.column("y").to_numpy().astype(np.float32)[order]


def train(labelled: DataFrame, sample: int = SAMPLE):
    """``labelled``: id, text, toxic (0 or 1). (odds, network, share of toxic rows); None without rows of both classes."""
    labelled = labelled.where("text is not null and toxic in (0, 1)")
    odds, own_odds, n_toxic, n_other = _odds(labelled)
    if not n_toxic or not n_other:
        return None
    draw = F.pmod(F.xxhash64(F.lit(23), "id", "text"), F.lit(1 << 40)) / float(1 << 40)
    parts = None
    for y, limit, n in ((1, sample, n_toxic), (0, 2 * sample, n_other)):
        share = min(1.0, (2.0 * limit + 50) / n)
        part = labelled.where((F.col("toxic") == y) & (draw < share)).withColumn("draw", draw).orderBy("draw", "id").limit(limit).select("text", "toxic")
        parts = part if parts is None else parts.unionByName(part)
    windows, y = _training_windows(parts, own_odds)
    if not len(windows):
        return None
    network = Network()
    network.fit(windows, y)
    return odds, network, n_toxic / (n_toxic + n_other)


def score(docs: DataFrame, model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``row``, score (of the highest window) and n_windows for every row of ``docs``."""
    frame = docs.select(F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row"), docs[f"`{text_col}`"].cast("string").alias("text"))
    schema = as_schema(frame, "row", "score double", "n_windows bigint")
    sent = ship(docs.sparkSession, model)

    def run(batches):
        known = shipped(sent)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                n = part.num_rows
                best, per = np.zeros(n), np.zeros(n, np.int64)
                if known is not None:
                    odds, network, base = known
                    b = Batch(*buffers(flat(part.column("text"))))
                    word, char = _ids(b)
                    x = network.inputs(word, char, b.ptr, prior(b, odds))
                    per = np.bincount(b.doc, minlength=n)
                    best[per == 0] = base
                    for i in range(0, len(b.doc), 4096):
                        p = _sigmoid(network.forward(x, b.index[i:i + 4096]))
                        np.maximum.at(best, b.doc[i:i + 4096], p)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(best, pa.float64()), pa.array(per, pa.int64())], names=schema.names)

    return frame.mapInArrow(run, schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("of"), F.col("toxic").cast("int").alias("toxic"))
    labelled = docs.select(F.col("doc_id").alias("id"), "text").where(fold(F.col("doc_id"), 5) != 0).join(labels.hint("merge"), F.col("id") == F.col("of")).select("id", "text", "toxic")  # one plan at every size
    out = score(docs, train(materialise(labelled, "toxicity-labelled")), ["doc_id"])
    return out.select("row.doc_id", (fold(F.col("row.doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_windows")
