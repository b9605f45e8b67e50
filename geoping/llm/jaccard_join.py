"""Operator 9: exact n-gram Jaccard self-join in metric space, as components.

The metric is the Jaccard distance of the documents' sets of five-word shingles; two
documents link at a distance of at most 1 - ``PERCENT`` / 100. Documents of equal sets are
one class (they link at distance 0); all further work is on classes.

1. Prefixes. Linked sets share at least k shingles among the first ``n - ceil(0.8 n) + k`` of
   each in hash order (k: a tenth of the size, of the smaller one; one at least). A class with
   fewer shared prefix shingles has no link. Then every shingle of the classes left is counted:
   a class with fewer than ``ceil(0.8 n)`` shingles that other classes have too has no link either.
2. Pivots and regions. Among the classes that have a shingle in their prefixes the smallest
   is a pivot. A class belongs to the region of each pivot it shares a prefix shingle with, so
   any two linked classes meet in a region. Its distances to its pivots are exact.
   So the regions are the posting lists of an inverted index over prefixes, not Voronoi cells:
   no nearest pivot is sought, and no window decides which regions a class is copied to. At a
   radius of 0.2 most unlinked classes are at distance 1 from each other and from every pivot they
   share nothing with, where a cell's window d(x, q) - d(x, p) <= 0.4 tells nothing; shared prefix
   shingles do, and exactly. The triangle inequality is used inside a region only (3 and 4).
3. Sketches and windows. A set's sketch (`sketch`) has a bit for an element, not 64: two sets differ
   in as many elements at least as their sketches in bits. Only members whose sketch allows a link
   to p, then to a member of another component, go on with their sets. In the region of p, x and y
   can link only if |d(x, p) - d(y, p)| is at most the radius (triangle inequality) and their sizes
   allow it. Classes within the radius of p link to p; a region of one component is done.
4. Recursion. Elsewhere the members that are not in the pivot's component are compared with
   all members of other components. A member travels as the bits of the pivot's elements it has
   and the list of its other elements; large regions travel in blocks of bounded size. Inside a
   block pair the members are split again and again at the median distance to one of them, with
   the window on both sides, as long as that saves work; what is connected on the way is not
   compared any more. Only links that connect two components leave the task. Every pair not
   compared is excluded by an inequality or already connected, so the components are exact.

Counting runs on packed arrays: each task first merges what it has, so a shingle that is
in many documents costs a task one entry. Members of a region are rows, never gathered.

Classes are 64-bit hashes of the sets, shingles 64-bit hashes of the words.

Defined results: A-Z are lower-cased; words are ``[^\x20\x09-\x0D]+``; with fewer than five
words the whole sequence is the one shingle; null, empty and wordless texts have an empty
set and are their own component; repeated rows are in one class; a null id never is a
component id unless all ids of the component are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoping.llm.common import as_schema, buffers, components, materialise, mix64, once, slices, with_held, Words

WIDTH = 5
PERCENT = 80
#: Entries (16 bytes each) that a task holds before it hands them on, and entries of one bucket.
UNIT = 1_000_000
#: Bytes of the members of a region that are compared with another block at a time.
BLOCK_BYTES = 16 << 20
#: Bytes of text whose words are hashed at a time.
TEXT_BYTES = 1 << 20
_MANY = 0


def sets(off: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document in ascending order, where each document begins, and its class."""
    shingles, first = Words(off, raw, sound=True).shingles(WIDTH)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    by = np.lexsort((shingles, doc))
    doc, shingles = doc[by], shingles[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (shingles[1:] != shingles[:-1])
    doc, shingles = doc[new], shingles[new]
    first = np.searchsorted(doc, np.arange(len(off)))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(shingles ^ np.uint64(0xD1342543DE82EF95)))))
    classes = mix64((sums[first[1:]] - sums[first[:-1]]) * np.uint64(3) + np.diff(first).astype(np.uint64))
    classes[classes == _MANY] = 1
    return shingles, first, classes


def prefix_size(n: np.ndarray, percent: int, shared: np.ndarray | int = 1) -> np.ndarray:
    """Length of the prefixes in which linked sets share ``shared`` shingles."""
    return n - (percent * n + 99) // 100 + shared * (n > 0)


def _tenth(n: np.ndarray) -> np.ndarray:
    return np.maximum(1, n // 10)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start..start+size-1 of every range, one after the other."""
    total = int(size.sum())
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)


def _classes(base: DataFrame, held: str | None) -> DataFrame:
    """``row``, id, t1, t2, n (set size) and c (class, null for an empty set). ``held``: the text's name in ``row``, if it is there."""
    schema = as_schema(base, "row", "id", "t1", "t2", "n bigint", "c bigint")

    def run(batches):
        for batch in batches:
            for part in slices(with_held(batch, held), "text", TEXT_BYTES):
                _, first, classes = sets(*buffers(part.column("text")))
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("row", "id", "t1", "t2")), pa.array(n, pa.int64()), pa.array(classes.view(np.int64), pa.int64(), mask=n == 0)], names=schema.names)

    return base.mapInArrow(run, schema)


class _Packed:
    """Collects (shingle, class) entries and hands them on by bucket, merged as far as they are known."""

    def __init__(self, n_buckets: int):
        self.n_buckets, self.held, self.size = n_buckets, [], 0

    def add(self, s: np.ndarray, c: np.ndarray):
        self.held.append((s, c))
        self.size += len(s)
        if self.size >= UNIT:
            yield from self.flush()

    def flush(self):
        """Rows (bucket, entries, counts): a shingle of several classes goes on as one entry without a class,
        and those classes learn here that they share it (bucket -1: pairs of class and number)."""
        if not self.held:
            return
        s, c = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        s, c, _ = _distinct(s, c)
        lead, shared = _groups(s)
        known = c[shared]
        out_s, out_c = s[lead], np.where(shared[lead], np.uint64(_MANY), c[lead])
        bucket = (out_s % np.uint64(self.n_buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        out_s, out_c, bucket = out_s[by], out_c[by], bucket[by]
        edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else []
        numbers, blobs = [], []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            numbers.append(int(bucket[a]))
            blobs.append(np.concatenate((out_s[a:b], out_c[a:b])).tobytes())
        if len(known):
            who, times = np.unique(known, return_counts=True)
            numbers.append(-1)
            blobs.append(np.concatenate((who, times.astype(np.uint64))).tobytes())
        for i in range(0, len(numbers), 500):
            yield pa.RecordBatch.from_arrays([pa.array(numbers[i:i + 500], pa.int32()), pa.array(blobs[i:i + 500], pa.binary())], names=["bucket", "entries"])


def _distinct(s: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    by = np.lexsort((c, s))
    s, c = s[by], c[by]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])
    return s[new], c[new], by[new]


def _groups(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted ``s``: the first index of each value, and which entries have a value that occurs more than once."""
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    lead = np.flatnonzero(new)
    size = np.diff(np.append(lead, len(s)))
    return lead, np.repeat(size > 1, size)


def _shared(packed: DataFrame, n_buckets: int) -> DataFrame:
    """(c, k): how many of its entries each class shares with another class, one row per class. One bucket is sorted at a time."""

    def count(blobs: list[bytes]):
        pairs = [np.frombuffer(b, np.uint64).reshape(2, -1) for b in blobs]
        s, c, _ = _distinct(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
        lead, shared = _groups(s)
        size = np.diff(np.append(lead, len(s)))
        # an entry without a class stands for several classes, which know it already
        shared |= np.repeat(c[lead] == _MANY, size)
        who, times = np.unique(c[shared & (c != _MANY)], return_counts=True)
        return who, times

    def hand_on(who, times):
        """Counts by the place where those of a class meet, packed."""
        place = (who % np.uint64(n_buckets)).astype(np.int64)
        by = np.argsort(place, kind="stable")
        who, times, place = who[by], times[by], place[by]
        edges = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1], [True]))) if len(place) else np.zeros(1, int)
        blobs = [np.concatenate((who[a:b], times[a:b].astype(np.uint64))).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(place[edges[:-1]], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "entries"])

    def sort_buckets(batches):
        held, last = [], None
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("entries"), strict=True):
                if bucket != last and held:
                    yield hand_on(*count(held))
                    held = []
                last = bucket
                if bucket < 0:
                    yield hand_on(*np.frombuffer(blob.as_buffer(), np.uint64).reshape(2, -1))
                else:
                    held.append(blob.as_py())
        if held:
            yield hand_on(*count(held))

    def add_up(batches):
        who, times = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for batch in batches:
            pairs = [np.frombuffer(b.as_buffer(), np.uint64).reshape(2, -1) for b in batch.column("entries")]
            own = np.concatenate([who, *(p[0] for p in pairs)])
            n = np.concatenate([times, *(p[1] for p in pairs)])
            who, inverse = np.unique(own, return_inverse=True)
            times = np.bincount(inverse, n, minlength=len(who)).astype(np.uint64)
        for i in range(0, len(who), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(who[i:i + 100_000].view(np.int64)), pa.array(times[i:i + 100_000].astype(np.int64))], names=["c", "k"])

    # what is known already needs no meeting place: it is dealt out evenly
    place = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.pmod(F.xxhash64("entries"), F.lit(n_buckets)).cast("int"))
    counted = packed.repartition(n_buckets, place).sortWithinPartitions("bucket").mapInArrow(sort_buckets, "bucket int, entries binary")
    return counted.repartition(n_buckets, "bucket").mapInArrow(add_up, "c bigint, k bigint")


def _pack_texts(base: DataFrame, n_buckets: int, percent: int) -> DataFrame:
    """Prefix entries of all texts."""

    def run(batches):
        packed = _Packed(n_buckets)
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                s, first, classes = sets(*buffers(part.column("text")))
                n = np.diff(first)
                size = prefix_size(n, percent, _tenth(n))
                yield from packed.add(s[_ranges(first[:-1], size)], np.repeat(classes, size))
        yield from packed.flush()

    return base.select("text").mapInArrow(run, "bucket int, entries binary")


def _pack_sets(members: DataFrame, n_buckets: int) -> DataFrame:
    """All entries of stored sets."""

    def run(batches):
        packed = _Packed(n_buckets)
        for batch in batches:
            for part in slices(batch, "elements"):
                off, raw = buffers(part.column("elements"))
                if len(raw):
                    classes = part.column("c").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                    yield from packed.add(raw.view(np.uint64), np.repeat(classes, np.diff(off) // 8))
        yield from packed.flush()

    return members.select("c", "elements").mapInArrow(run, "bucket int, entries binary")


def _store(leads: DataFrame) -> DataFrame:
    """(c, n, elements): the sets of the leading texts, as sorted arrays of 8-byte hashes."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                s, first, classes = sets(*buffers(part.column("text")))
                blobs = [s[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(classes.view(np.int64)), pa.array(np.diff(first), pa.int64()), pa.array(blobs, pa.binary())], names=["c", "n", "elements"])

    return leads.select("text").mapInArrow(run, "c bigint, n bigint, elements binary")


def _prefixes(members: DataFrame, percent: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "elements"):
                off, raw = buffers(part.column("elements"))
                s = raw.view(np.uint64) if len(raw) else np.zeros(0, np.uint64)
                size = prefix_size(np.diff(off) // 8, percent)
                at = _ranges(off[:-1] // 8, size)
                take = pa.array(np.repeat(np.arange(part.num_rows), size))
                for i in range(0, len(at), 100_000):
                    cut = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(s[at[cut]].view(np.int64)), part.column("c").take(take[i:i + 100_000])], names=["s", "c"])

    return members.select("c", "elements").mapInArrow(run, "s bigint, c bigint")


def _places(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(p, x, np, nx, common, bits, rest) for pairs (p, x): which elements of p are in x, and those of x that are not in p.

    The set of p joins first, on thin rows, as p may be hot.
    """
    one = members.select(F.col("c").alias("p"), F.col("n").alias("np"), F.col("elements").alias("a"))
    two = members.select(F.col("c").alias("x"), F.col("n").alias("nx"), F.col("elements").alias("b"))

    def run(batches):
        for batch in batches:
            common, bits, rest = [], [], []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                inside = np.isin(a, b, assume_unique=True)
                common.append(int(inside.sum()))
                bits.append(np.packbits(inside).tobytes())
                rest.append(np.setdiff1d(b, a, assume_unique=True).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("p", "x", "np", "nx")), pa.array(common, pa.int64()), pa.array(bits, pa.binary()), pa.array(rest, pa.binary())],
                names=["p", "x", "np", "nx", "common", "bits", "rest"])

    schema = "p bigint, x bigint, np bigint, nx bigint, common bigint, bits binary, rest binary"
    return pairs.select("p", "x").join(one, "p").join(two, "x").select("p", "x", "np", "nx", "a", "b").mapInArrow(run, schema)


class Region:
    """Members of a region, or of two blocks of it, with their sets as seen from the pivot."""

    def __init__(self, rows: dict[str, list], percent: int):
        self.percent, self.radius = percent, 1 - percent / 100 + 1e-9
        self.x, self.label = np.array(rows["x"], np.int64), np.array(rows["label"], np.int64)
        self.n, common = np.array(rows["nx"], np.int64), np.array(rows["common"], np.int64)
        n_pivot = int(rows["np"][0])
        self.gap = 1 - common / (n_pivot + self.n - common)
        width = -(-n_pivot // 64)
        self.bits = np.zeros((len(self.x), width), np.uint64)
        whole = np.packbits(np.ones(n_pivot, bool)).tobytes()
        for i, b in enumerate(rows["bits"]):
            self.bits[i] = np.frombuffer((whole if b is None else b).ljust(8 * width, b"\0"), np.uint64)
        self.rest = [np.frombuffer(r, np.uint64) if r else np.zeros(0, np.uint64) for r in rows["rest"]]
        self.n_rest = np.array([len(r) for r in self.rest])
        self.links: list[tuple[int, int]] = []

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections with ``i`` as far as they can matter (elements outside the pivot only where they decide)."""
        out = np.bitwise_count(self.bits[others] & self.bits[i]).sum(axis=1).astype(np.int64)
        most = out + np.minimum(self.n_rest[others], self.n_rest[i])
        for k in np.flatnonzero((100 * most >= self.percent * (self.n[others] + self.n[i] - most)) & (most > out)):
            out[k] += len(np.intersect1d(self.rest[others[k]], self.rest[i], assume_unique=True))
        return out

    def distance(self, i: int, others: np.ndarray) -> np.ndarray:
        out = np.bitwise_count(self.bits[others] & self.bits[i]).sum(axis=1).astype(np.int64)
        if self.n_rest[i]:
            for k in np.flatnonzero(self.n_rest[others]):
                out[k] += len(np.intersect1d(self.rest[others[k]], self.rest[i], assume_unique=True))
        return 1 - out / (self.n[others] + self.n[i] - out)

    def join(self, left: np.ndarray, right: np.ndarray, depth: int = 0) -> None:
        """Link every pair of ``left`` and ``right`` that is not connected yet.

        Large sides are split at the median distance to one of their members; the window of the
        triangle inequality goes to both halves. Where windows do not shrink the work, rows are compared.
        """
        if depth < 6 and len(left) > 256 and len(right) > 256:
            pivot = int(left[len(left) // 2])
            a, b = self.distance(pivot, left), self.distance(pivot, right)
            cut = float(np.median(a))
            halves = [(left[a <= cut], right[b <= cut + self.radius]), (left[a > cut], right[b > cut - self.radius])]
            if sum(len(x) * len(y) for x, y in halves) < 0.75 * len(left) * len(right):
                for x, y in halves:
                    self.join(x, y, depth + 1)
                return
        for i in left.tolist():
            others = right[self.label[right] != self.label[i]]
            if not len(others):
                continue
            small, large = np.minimum(self.n[others], self.n[i]), np.maximum(self.n[others], self.n[i])
            others = others[(100 * small >= self.percent * large) & (np.abs(self.gap[others] - self.gap[i]) <= self.radius)]
            if not len(others):
                continue
            common = self.common(i, others)
            for k in others[100 * common >= self.percent * (self.n[others] + self.n[i] - common)].tolist():
                if self.label[k] != self.label[i]:
                    self.links.append((int(self.x[i]), int(self.x[k])))
                    self.label[self.label == self.label[k]] = self.label[i]


def _region_links(rows: DataFrame, percent: int) -> DataFrame:
    """(p, x): links that connect different labels, found block pair by block pair (p, i, j)."""
    fields = ("x", "np", "nx", "common", "bits", "rest", "label", "own")

    def run(batches):
        held, last = {f: [] for f in fields}, None

        def flush():
            region = Region(held, percent)
            own, (_, i, j) = np.array(held["own"]), last
            region.join(np.flatnonzero(own == i), np.flatnonzero(own == j))
            links = region.links
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["p", "x"])

        for batch in batches:
            columns = batch.to_pydict()
            for k, key in enumerate(zip(columns["p"], columns["i"], columns["j"], strict=True)):
                if key != last and last is not None:
                    yield flush()
                    held = {f: [] for f in fields}
                last = key
                for f in fields:
                    held[f].append(columns[f][k])
        if last is not None:
            yield flush()

    return rows.repartition("p", "i", "j").sortWithinPartitions("p", "i", "j").mapInArrow(run, "p bigint, x bigint")


def _merge(labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Labels (c, label) after joining the components of ``links`` (p, x)."""
    one = labels.select(F.col("c").alias("p"), F.col("label").alias("a"))
    two = labels.select(F.col("c").alias("x"), F.col("label").alias("b"))
    edges = materialise(links.select("p", "x").join(one, "p").join(two, "x").select("a", "b").where("a <> b").distinct(), f"{name}-links")
    if not edges.limit(1).count():
        return labels
    found = components(edges, name)
    return materialise(labels.join(found.withColumnRenamed("node", "label"), "label", "left").select("c", F.coalesce("component", "label").alias("label")), f"{name}-labels")


def sketch(elements: np.ndarray) -> bytes:
    """Which of a power of two of places, as many as elements at least, an odd number of the elements fall on."""
    width = max(64, 1 << (len(elements) - 1).bit_length())
    times = np.bincount((elements & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((times & 1).astype(bool), bitorder="little").tobytes()


def _sketches(members: DataFrame) -> DataFrame:
    """(c, n, sketch) of stored sets."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "elements"):
                off, raw = buffers(part.column("elements"))
                s, off = raw.view(np.uint64) if len(raw) else np.zeros(0, np.uint64), off // 8
                out = [sketch(s[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("c"), pa.array(np.diff(off), pa.int64()), pa.array(out, pa.binary())], names=["c", "n", "sketch"])

    return members.select("c", "elements").mapInArrow(run, "c bigint, n bigint, sketch binary")


def fold(sketch: bytes, words: int) -> np.ndarray:
    """A sketch on a smaller number of places."""
    out = np.frombuffer(sketch, np.uint64)
    while len(out) > words:
        out = out[:len(out) // 2] ^ out[len(out) // 2:]
    return out


def may_link(n: np.ndarray, sketches: list[bytes], label: np.ndarray, own: np.ndarray, percent: int) -> np.ndarray:
    """Which sets may link to one of another label here (of another block, if there are two).

    Sets differ in as many elements at least as their sketches in places, and linked sets in at most
    (100 - percent) / (100 + percent) of the sum of their sizes: what is left out has no link here.
    """
    by = np.argsort(n, kind="stable")
    n, label, own, sketches = n[by], label[by], own[by], [sketches[i] for i in by.tolist()]
    found = np.zeros(len(n), bool)
    words = np.array([len(s) // 8 for s in sketches])
    two = bool((own != own[0]).any())
    stop = np.searchsorted(n, 100 * n // percent, side="right")
    for w in np.unique(words).tolist():
        rows = np.flatnonzero(words == w)
        base, end = int(rows[0]), int(stop[rows[-1]])
        grid = np.stack([fold(sketches[k], w) for k in range(base, end)])
        for i in rows.tolist():
            others = np.arange(i + 1, stop[i])
            keep = label[others] != label[i]
            if two:
                keep &= own[others] != own[i]
            if found[i]:
                keep &= ~found[others]
            others = others[keep]
            if len(others):
                apart = np.bitwise_count(grid[others - base] ^ grid[i - base]).sum(axis=1, dtype=np.int64)
                near = others[apart * (100 + percent) <= (n[others] + n[i]) * (100 - percent)]
                found[near] = True
                found[i] |= len(near) > 0
    out = np.zeros(len(n), bool)
    out[by] = found
    return out


def _near_pivots(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (p, x) whose sketches allow a link."""
    one, two = (sketches.select(F.col("c").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "px")

    def run(batches):
        for batch in batches:
            apart = []
            for a, b in zip(batch.column("sp"), batch.column("sx"), strict=True):
                a, b = a.as_buffer(), b.as_buffer()
                words = min(a.size, b.size) // 8
                apart.append(int(np.bitwise_count(fold(a, words) ^ fold(b, words)).sum()))
            sizes = batch.column("np").to_numpy() + batch.column("nx").to_numpy()
            near = np.array(apart, np.int64) * (100 + percent) <= sizes * (100 - percent)
            yield pa.RecordBatch.from_arrays([batch.column("p"), batch.column("x")], names=["p", "x"]).filter(pa.array(near, pa.bool_()))

    thin = pairs.join(one, "p").join(two.select("x", "nx"), "x").where(f"100 * least(np, nx) >= {percent} * greatest(np, nx)")
    return thin.join(two.select("x", "sx"), "x").select("p", "x", "np", "nx", "sp", "sx").mapInArrow(run, "p bigint, x bigint")


def _far_members(pairs: DataFrame, sketches: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """The pairs (p, x) where x may link to a member of another label in the region of p, sought block pair by block pair."""
    rows = pairs.join(labels.select(F.col("c").alias("x"), "label"), "x")
    size = F.sum(F.lit(64) + F.greatest(F.col("n") / 4, F.lit(8)))
    rows = rows.join(sketches.select(F.col("c").alias("x"), "n"), "x")
    mixed = rows.groupBy(F.col("p").alias("of")).agg(F.min("label").alias("low"), F.max("label").alias("high"), size.alias("size")).where("low < high")
    mixed = mixed.select("of", F.ceil(F.col("size") / F.lit(max(BLOCK_BYTES // 8, 1))).cast("int").alias("blocks"))
    rows = rows.join(mixed, F.col("p") == F.col("of")).join(sketches.select(F.col("c").alias("x"), "sketch"), "x")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("p", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "x", "n", "label", "own", "sketch")

    def run(batches):
        held, last = [], None

        def flush():
            x, n, label, own = (np.array([r[k] for r in held], np.int64) for k in range(4))
            keep = may_link(n, [r[4] for r in held], label, own, percent)
            return pa.RecordBatch.from_arrays([pa.array(np.full(int(keep.sum()), last[0]), pa.int64()), pa.array(x[keep], pa.int64())], names=["p", "x"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != last and last is not None:
                    yield flush()
                    held = []
                last = row[:3]
                held.append(row[3:])
        if last is not None:
            yield flush()

    return rows.repartition("p", "i", "j").sortWithinPartitions("p", "i", "j").mapInArrow(run, "p bigint, x bigint").distinct()


def class_components(members: DataFrame, percent: int) -> DataFrame:
    """(c, label) over the links of the stored classes."""
    entries = _prefixes(members, percent)
    pivots = entries.groupBy("s").agg(F.min("c").alias("p"), F.max("c").alias("q")).where("p < q").drop("q")
    pairs = materialise(entries.join(pivots, "s").where("c <> p").select("p", F.col("c").alias("x")).distinct(), "jaccard-pairs")
    sketches = materialise(_sketches(members), "jaccard-sketches")
    # sets travel only where sketches allow a link: first to the pivots, then to members of other labels
    near = _places(materialise(_near_pivots(pairs, sketches, percent), "jaccard-close"), members)
    labels = materialise(members.select("c", F.col("c").alias("label")).distinct(), "jaccard-labels")
    labels = _merge(labels, near.where(f"100 * common >= {percent} * (np + nx - common)"), "jaccard-near")
    near = materialise(_places(materialise(_far_members(pairs, sketches, labels, percent), "jaccard-open"), members), "jaccard-regions")
    # who is in the component of the region's pivot (inner), who is not (outer); a region without outer members is done
    of_x = labels.select(F.col("c").alias("x"), "label")
    of_p = labels.select(F.col("c").alias("p"), F.col("label").alias("head"))
    thin = near.select("p", "x", "np", (F.octet_length("bits") + F.octet_length("rest") + 64).alias("size")).join(of_x, "x").join(of_p, "p")
    thin = materialise(thin.withColumn("outer", F.col("label") != F.col("head")), "jaccard-thin")
    blocks = thin.groupBy(F.col("p").alias("of")).agg(
        F.sum(F.when(F.col("outer"), F.col("size")).otherwise(0)).alias("far"), F.sum(F.when(F.col("outer"), 0).otherwise(F.col("size"))).alias("close"),
        F.first("np").alias("np"), F.first("head").alias("label")).where("far > 0")
    count = lambda c: F.ceil(F.col(c) / F.lit(BLOCK_BYTES)).cast("int")
    blocks = materialise(blocks.select("of", "np", "label", count("far").alias("outer_blocks"), F.greatest(count("close"), F.lit(1)).alias("inner_blocks")), "jaccard-blocks")
    nothing = F.lit(None).cast("binary")
    pivot_rows = blocks.select(F.col("of").alias("p"), F.col("of").alias("x"), "np", F.col("np").alias("nx"), F.col("np").alias("common"), nothing.alias("bits"), nothing.alias("rest"), "label", F.lit(False).alias("outer"), "outer_blocks", "inner_blocks")
    wanted = (thin.select("p", F.col("x").alias("member"), "label", "outer")
              .join(blocks.select("of", "outer_blocks", "inner_blocks"), F.col("p") == F.col("of")).drop("p"))
    rows = near.join(wanted, (F.col("p") == F.col("of")) & (F.col("x") == F.col("member"))).drop("of", "member").unionByName(pivot_rows)
    # every block of outer members meets every block of the region; inner blocks need not meet each other
    outer = F.col("outer_blocks")
    own = F.when(F.col("outer"), F.pmod(F.xxhash64("x"), outer)).otherwise(outer + F.pmod(F.xxhash64("x"), F.col("inner_blocks"))).cast("int")
    partners = F.when(F.col("outer"), F.sequence(F.lit(0), outer + F.col("inner_blocks") - 1)).otherwise(F.sequence(F.lit(0), outer - 1))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(partners))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    links = _region_links(rows.select("p", "i", "j", "x", "np", "nx", "common", "bits", "rest", "label", "own"), percent)
    return _merge(labels, links, "jaccard-far")


def jaccard_join(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``row``, n_shingles, component_id (smallest id reachable by links) and ``leads`` for every row of ``docs``.

    ``leads`` marks one row of each component (of its smallest id, the first of repeated
    rows); a document with an empty set leads itself.
    """
    base = docs.select(F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row"), docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].cast("string").alias("text"))
    base = base.withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit(1), "text"))
    rows = materialise(_classes(*once(base, docs, text_col, keep)).withColumn("nr", F.monotonically_increasing_id()), "jaccard-classes")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    first = _shared(_pack_texts(base, n := max(partitions, total // (4 * UNIT) + 1), percent), n)
    first = materialise(first, "jaccard-candidates")
    # the partner may be smaller by the similarity: so many shared shingles are sure
    enough = F.expr(f"k >= greatest(1, (({percent} * n + 99) div 100) div 10)")
    leads = (rows.join(first, "c").where(enough).groupBy("c").agg(F.min(F.struct("t1", "t2", F.col("id").isNull().alias("no_id"), "id")).alias("lead"))
             .select(F.col("lead.t1").alias("u1"), F.col("lead.t2").alias("u2"), F.col("lead.id").alias("lead_id")))
    texts = leads.hint("shuffle_hash").join(base, (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")) & F.col("id").eqNullSafe(F.col("lead_id")))
    members = materialise(_store(texts), "jaccard-sets")
    total = members.agg(F.sum("n")).first()[0] or 0
    again = _shared(_pack_sets(members, n := max(partitions, total // UNIT + 1)), n)
    members = materialise(members.join(again, "c").where(F.expr(f"100 * k >= {percent} * n")).select("c", "n", "elements"), "jaccard-members")
    labels = class_components(members, percent)
    lowest = rows.where("c is not null").groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "nr")).alias("low"))
    lowest = materialise(lowest.join(labels, "c", "left").withColumn("label", F.coalesce("label", "c")), "jaccard-lowest")
    component = lowest.groupBy("label").agg(F.min("low").alias("head"))
    component = materialise(lowest.join(component, "label").select(F.col("c").alias("of"), F.col("head.id").alias("component_id"), F.col("head.nr").alias("head")), "jaccard-components")
    out = rows.join(component, rows["c"] == component["of"], "left")
    alone = F.col("c").isNull()
    return out.select("row", F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), (alone | (F.col("nr") == F.col("head"))).alias("leads"))


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"]).select("row.doc_id", "n_shingles", "component_id")


ORACLE_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS s
  FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(p) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
commons AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM commons JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
  WHERE 100 * common >= 80 * (a.n + b.n - common)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT y, root FROM reach JOIN both_ways ON x = node)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) m ON m.node = d.doc_id
"""
