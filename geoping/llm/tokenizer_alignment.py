"""Operator 11: alignment of two tokenizers by external spill counting.

Every text, with one blank in front, is encoded by a byte-level BPE (A) and by a piece BPE with
byte fallback (B). Where tokens of both end, the text falls into groups; an A and a B token whose
byte ranges overlap are linked. The corpus-wide count of a pair of ids is the number of documents
that hold it linked; a link is best if its count is the highest of its A id.

1. *Spill.* Tasks encode texts and gather pair-document records (pair, document, links) in runs of
   about ``RUN_BYTES`` of text. A run is sorted by pair, A id first, radix-partitioned by the low
   digits of the A id, and spilled as zstd blobs: per partition a directory (pairs and their
   numbers of documents) and a body (the documents and links of each pair).
2. *Merge.* Directories, one entry per pair and run however many documents hold it, are shuffled by
   partition. A task reads those of a partition one after the other and merges them, a fan-in of
   runs at a time, by a k-way heap merge into one sorted run of totals: counts by pair, A-major, so the
   maximum of an A id is known when its pairs have passed. A partition's totals hold at most
   (A ids / partitions) x B ids pairs, which bounds their memory whatever the input.
3. *Back.* Totals meet the directories again, totals first, and every directory streams back to its
   run as (count, best) per entry; runs add them up by document. A text's tokens never leave its task.

A pair that every document holds is one entry per run and so is a hot A id per B id: nothing
grows with the documents of a pair but the bodies, which go back to their own run.

Words are encoded once and remembered: both tokenizations fall apart at a blank that follows
a character which is not white space, and so do groups and links. That is checked on the vocabularies
(``cuts_at_blanks``); others are encoded whole text by whole text.

Defined results: null and empty texts and texts whose joined token bytes differ from blank + text in A
or B (a U+2581 in the text, bytes that are not UTF-8) have no tokens: zeros and ''. Every row counts as a
document of its own, whatever its id. Special tokens in a text are ordinary text. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoping.llm.common import as_schema, buffers, flat, materialise, ship, shipped, slices, with_text

TOKENIZERS = "/opt/tokenizers"
#: Text of a run, partitions of the A ids, directories merged at once, words remembered by a task (of at most so many bytes).
RUN_BYTES, PARTS, FAN_IN, CACHE, CACHE_BYTES = 16 << 20, 256, 64, 300_000, 96
_BLOCK = 4096
#: Documents of a run are numbered in so many bits, beside the pair; a run ends at ``_RUN_DOCS`` documents at the latest.
_DOC_BITS, _RUN_DOCS = 24, 1 << 20


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def cuts_at_blanks(spec: dict, pieces: list[str]) -> bool:
    """Whether both tokenizers treat what follows a blank after a visible character on its own."""
    pre = spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    return bool(plain) and not any(re.search("[^▁]▁", p) for p in pieces)


class Aligner:
    """Both tokenizers, made from the bytes of their files, and the words met so far."""

    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        spec, byte_of = json.loads(a_file), _byte_of()
        self.n_a = max([*spec["model"]["vocab"].values(), *[t["id"] for t in spec["added_tokens"]]]) + 1
        self.a_bytes = [b""] * self.n_a
        for token, k in spec["model"]["vocab"].items():
            self.a_bytes[k] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token in spec["added_tokens"]:
            self.a_bytes[token["id"]] = token["content"].encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.n_b = len(pieces)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.cuts = cuts_at_blanks(spec, pieces)
        self.known: dict[bytes, tuple] = {}

    def words(self, parts: list[bytes]) -> list[tuple]:
        """(A tokens, B tokens, groups, groups as text, links as a * n_b + b) of each part; no text where bytes differ."""
        new = [p for p in parts if p not in self.known]
        found = {}
        if new:
            texts = [p.decode("utf-8", "replace") for p in new]
            a_ids = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
            b_ids = self.b.encode([t[1:] for t in texts], num_threads=1)
            found = {p: self._align(p, a, b) for p, a, b in zip(new, a_ids, b_ids, strict=True)}
        out = [found[p] if p in found else self.known[p] for p in parts]
        if len(self.known) + len(found) > CACHE:
            self.known = {}
        self.known.update((p, x) for p, x in found.items() if len(p) <= CACHE_BYTES)
        return out

    def _align(self, part: bytes, a: list[int], b: list[int]) -> tuple:
        a_bytes, b_bytes, n_b = self.a_bytes, self.b_bytes, self.n_b
        n, m = len(a), len(b)
        if not n or b"".join([a_bytes[x] for x in a]) != part or b"".join([b_bytes[x] for x in b]) != part:
            return 0, 0, 0, None, ()
        if m == 1:  # one token spans the part: one group
            k = b[0]
            return n, 1, 1, ("%s|%d" % (",".join([str(x) for x in a]), k)).encode(), tuple([x * n_b + k for x in a])
        if n == 1:
            base = a[0] * n_b
            return 1, m, 1, ("%d|%s" % (a[0], ",".join([str(x) for x in b]))).encode(), tuple([base + x for x in b])
        x, y = a[0], b[0]
        i = j = 0
        a_end, b_end = len(a_bytes[x]), len(b_bytes[y])
        left, right, links, groups = str(x), str(y), [], []
        while True:
            links.append(x * n_b + y)
            if a_end == b_end:
                groups.append(f"{left}|{right}")
                i += 1
                if i == n:
                    break
                j += 1
                x, y = a[i], b[j]
                left, right = str(x), str(y)
                a_end += len(a_bytes[x])
                b_end += len(b_bytes[y])
            elif a_end < b_end:
                i += 1
                x = a[i]
                left += f",{x}"
                a_end += len(a_bytes[x])
            else:
                j += 1
                y = b[j]
                right += f",{y}"
                b_end += len(b_bytes[y])
        return n, m, len(groups), ";".join(groups).encode(), tuple(links)


def _edges(off: np.ndarray, raw: np.ndarray, cuts: bool) -> np.ndarray:
    """Where the parts of a batch of texts begin: at every text, and at a blank after a character that is surely not white space."""
    if not cuts or not len(raw):
        return off[:-1]
    visible = (raw >= 0x21) & (raw != 0x7F)
    high = raw >= 0x80  # U+0085, U+00A0, U+1680, U+2000 to U+3000 and what shares their lead bytes: not cut after
    visible[1:] &= ~(high[1:] & (raw[:-1] == 0xC2))
    visible[2:] &= ~(high[2:] & (raw[:-2] >= 0xE1) & (raw[:-2] <= 0xE3))
    cut = raw == 0x20
    cut[0] = False
    cut[1:] &= visible[:-1]
    cut[off[1:] - 1] = False  # a single blank at the end stays with the word before it
    cut[off[:-1]] = True
    return np.flatnonzero(cut)


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    """``kinds`` of equal number of entries each."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = len(data) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


class _Run:
    """Records of the texts of one run: key = pair << ``_DOC_BITS`` | document, pairs in the order of partition, A id, B id."""

    def __init__(self, n_a: int, n_b: int, parts: int):
        self.name, self.parts, self.docs, self.size = uuid.uuid4().hex, parts, 0, 0
        self.n_b, self.each = n_b, -(-n_a // parts) * n_b  # pairs of a partition
        if (parts * self.each).bit_length() + _DOC_BITS > 63:
            raise ValueError("vocabularies too large for 64-bit keys")
        self.keys: list[np.ndarray] = []
        self.links: list[np.ndarray] = []

    def add(self, pair: np.ndarray, doc: np.ndarray, docs: int, size: int) -> None:
        a, b = pair // self.n_b, pair % self.n_b
        key = (((a % self.parts) * self.each + (a // self.parts) * self.n_b + b) << _DOC_BITS) | (doc + self.docs)
        key, count = np.unique(key, return_counts=True)
        self.keys.append(key)
        self.links.append(count.astype(np.uint32))
        self.docs += docs
        self.size += size

    def blobs(self):
        """(partition, directory, body) of the partitions that have records."""
        key, links = np.concatenate(self.keys), np.concatenate(self.links)
        by = np.argsort(key, kind="stable")
        key, links = key[by], links[by]
        pair, doc = key >> _DOC_BITS, (key & ((1 << _DOC_BITS) - 1)).astype(np.uint32)
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        pairs, sizes = pair[first], np.diff(np.append(first, len(pair))).astype(np.uint32)
        part = pairs // self.each
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for lo, hi in zip(starts.tolist(), np.append(starts[1:], len(part)).tolist(), strict=True):
            records = slice(first[lo], first[hi] if hi < len(first) else len(pair))
            yield int(part[lo]), _pack(pairs[lo:hi], sizes[lo:hi]), _pack(doc[records], links[records])


def _encoded(texts: DataFrame, sent, run_bytes: int, parts: int) -> DataFrame:
    """Rows of documents (part null) and of the partitions of runs (row null)."""
    counts = ["n_a", "n_b", "n_groups", "n_links"]
    schema = as_schema(texts, "run string", "part int", "doc int", "row", *[f"{c} bigint" for c in counts], "groups_sha256 string",
                       "directory binary", "body binary")

    def work(batches):
        aligner = Aligner(*shipped(sent))

        def spilled(run, row_type):
            if not run.keys or not sum(map(len, run.keys)):
                return
            found, size = [], 0
            for blob in chain(run.blobs(), [None]):
                if found and (blob is None or size > 8 << 20):
                    n = len(found)
                    empty = pa.nulls(n, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([run.name] * n), pa.array([x[0] for x in found], pa.int32()), pa.nulls(n, pa.int32()),
                                                      pa.nulls(n, row_type), *[empty] * 4, pa.nulls(n, pa.string()),
                                                      pa.array([x[1] for x in found], pa.binary()), pa.array([x[2] for x in found], pa.binary())], names=schema.names)
                    found, size = [], 0
                if blob is not None:
                    found.append(blob)
                    size += len(blob[1]) + len(blob[2])

        run = _Run(aligner.n_a, aligner.n_b, parts)
        for batch in batches:
            for piece in slices(batch, "text"):
                off, raw = buffers(flat(piece.column("text")))
                n, size = len(off) - 1, len(raw)
                empty = np.diff(off) == 0
                raw, off = np.insert(raw, off[:-1], 0x20), off + np.arange(n + 1)
                edges = _edges(off, raw, aligner.cuts)
                coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges), [None, pa.py_buffer(np.append(edges, len(raw)).astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
                word = coded.indices.to_numpy(zero_copy_only=False)
                found = aligner.words(coded.dictionary.to_pylist())
                first = np.searchsorted(edges, off)
                doc = np.repeat(np.arange(n), np.diff(first))
                bad = np.array([x[3] is None for x in found], bool)
                live = ~empty & (np.bincount(doc[bad[word]], minlength=n) == 0)
                sums = []
                for k in range(3):
                    upto = np.concatenate(([0], np.cumsum(np.array([x[k] for x in found], np.int64)[word])))
                    sums.append((upto[first[1:]] - upto[first[:-1]]) * live)
                n_links = np.array([len(x[4]) for x in found], np.int64)
                flat_links = np.fromiter(chain.from_iterable(x[4] for x in found), np.int64, int(n_links.sum()))
                begin = np.concatenate(([0], np.cumsum(n_links)))[:-1]
                used = live[doc]
                many = n_links[word[used]]
                ends = np.cumsum(many)
                at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin[word[used]] - (ends - many), many)
                of = np.repeat(doc[used], many)
                sums.append(np.bincount(of, minlength=n))
                written = [x[3] for x in found]
                order, digests = word.tolist(), []
                for i, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    digests.append(hashlib.sha256(b";".join([written[k] for k in order[lo:hi]])).hexdigest() if live[i] else "")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([run.name] * n, pa.string()), pa.nulls(n, pa.int32()), pa.array(np.arange(run.docs, run.docs + n), pa.int32()), piece.column("row"),
                     *[pa.array(s, pa.int64()) for s in sums], pa.array(digests, pa.string()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=schema.names)
                run.add(flat_links[at], of, n, size)
                row_type = piece.column("row").type
                if run.size >= run_bytes or run.docs >= _RUN_DOCS:
                    yield from spilled(run, row_type)
                    run = _Run(aligner.n_a, aligner.n_b, parts)
        if run.docs:
            yield from spilled(run, row_type)

    return texts.mapInArrow(work, schema)


def heap_merge(runs: list[tuple[np.ndarray, np.ndarray]]):
    """Sorted runs of (keys, counts), merged a block at a time: the heap names the run whose block ends first."""
    at = [0] * len(runs)
    heap = [(int(keys[min(_BLOCK, len(keys)) - 1]), k) for k, (keys, _) in enumerate(runs) if len(keys)]
    heapq.heapify(heap)
    while heap:
        limit = heap[0][0]
        keys, counts, back = [], [], []
        while heap:  # all runs whose next key is in reach
            last, k = heap[0]
            if last > limit:
                break
            heapq.heappop(heap)
            back.append(k)
        for k, (own, count) in enumerate(runs):
            stop = at[k] + int(np.searchsorted(own[at[k]:at[k] + _BLOCK], limit, side="right"))
            if stop > at[k]:
                keys.append(own[at[k]:stop])
                counts.append(count[at[k]:stop])
                at[k] = stop
        for k in back:
            own = runs[k][0]
            if at[k] < len(own):
                heapq.heappush(heap, (int(own[min(at[k] + _BLOCK, len(own)) - 1]), k))
        key, count = np.concatenate(keys), np.concatenate(counts)
        by = np.argsort(key, kind="stable")
        key = key[by]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        yield key[first], np.add.reduceat(count[by], first)


def _merged(runs):
    blocks = list(heap_merge(runs))
    return tuple(np.concatenate(x) for x in zip(*blocks, strict=True)) if blocks else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _by_part(batches, *columns):
    """Rows of sorted batches as (part, values...), one at a time."""
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in ("part", *columns)], strict=True)


def _totals(spilled: DataFrame, n_b: int) -> DataFrame:
    """(part, seq, totals): pairs of a partition in A-major order with their counts (times two, plus one where the count is best)."""
    def work(batches):
        def out(part, total, open_runs):
            keys, counts = _merged([total, *open_runs])
            first = np.flatnonzero(np.diff(keys // n_b, prepend=-1))
            best = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(keys))))
            value = 2 * counts + (counts == best)
            size = 1 << 16
            for seq, k in enumerate(range(0, len(keys), size)):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()),
                                                  pa.array([_pack(keys[k:k + size], value[k:k + size])], pa.binary())], names=["part", "seq", "totals"])

        now, total, open_runs = None, None, []
        for part, directory in _by_part(batches, "directory"):
            if part != now:
                if now is not None:
                    yield from out(now, total, open_runs)
                now, total, open_runs = part, (np.zeros(0, np.int64), np.zeros(0, np.int64)), []
            keys, sizes = _unpack(directory, np.int64, np.uint32)
            open_runs.append((keys, sizes.astype(np.int64)))
            if len(open_runs) == FAN_IN:
                total, open_runs = _merged([total, *open_runs]), []
        if now is not None:
            yield from out(now, total, open_runs)

    return spilled.select("part", "directory").repartition("part").sortWithinPartitions("part").mapInArrow(work, "part int, seq int, totals binary")


def _answers(spilled: DataFrame, totals: DataFrame) -> DataFrame:
    """(run, part, answer): the value of the totals for every entry of a directory."""
    def work(batches):
        now, keys, values = None, [], []
        for part, run, totals_blob, directory in _by_part(batches, "run", "totals", "directory"):
            if part != now:
                now, keys, values = part, [], []
            if directory is None:
                key, value = _unpack(totals_blob, np.int64, np.int64)
                keys.append(key)
                values.append(value)
                continue
            if len(keys) > 1:
                keys, values = [np.concatenate(keys)], [np.concatenate(values)]
            own, sizes = _unpack(directory, np.int64, np.uint32)
            answer = _pack(values[0][np.searchsorted(keys[0], own)], sizes)
            yield pa.RecordBatch.from_arrays([pa.array([run]), pa.array([part], pa.int32()), pa.array([answer], pa.binary())], names=["run", "part", "answer"])

    rows = totals.select("part", "seq", F.lit("").alias("run"), "totals", F.lit(None).cast("binary").alias("directory")).unionByName(
        spilled.select("part", F.lit(1 << 30).alias("seq"), "run", F.lit(None).cast("binary").alias("totals"), "directory"))
    return rows.repartition("part").sortWithinPartitions("part", "seq").mapInArrow(work, "run string, part int, answer binary")


def _added(encoded: DataFrame, answers: DataFrame, keep_row) -> DataFrame:
    """Documents with their sums: a run's documents come first, then body and answer of each of its partitions."""
    columns = ["n_a", "n_b", "n_groups", "n_links"]
    schema = as_schema(encoded, "row", *columns, "n_best bigint", "count_sum bigint", "groups_sha256")
    rows = encoded.select("run", "part", "doc", "row", *columns, "groups_sha256", "body", F.lit(None).cast("binary").alias("answer")).unionByName(
        answers.select("run", "part", F.lit(None).cast("int").alias("doc"), F.lit(None).cast(keep_row).alias("row"),
                       *[F.lit(None).cast("bigint").alias(c) for c in columns], F.lit(None).cast("string").alias("groups_sha256"),
                       F.lit(None).cast("binary").alias("body"), "answer"))
    rows = rows.repartition("run").sortWithinPartitions("run", F.col("part").asc_nulls_first(), "doc", F.col("answer").isNotNull())

    def work(batches):
        now, held, best, total, body = None, [], None, None, None

        def out():
            for at, part in held:
                yield pa.RecordBatch.from_arrays([part.column("row"), *[part.column(c) for c in columns], pa.array(best[at:at + part.num_rows]),
                                                  pa.array(total[at:at + part.num_rows]), part.column("groups_sha256")], names=schema.names)

        for batch in batches:
            runs, n = batch.column("run").to_pylist(), batch.num_rows
            is_doc = np.array(batch.column("part").is_null())
            k = 0
            while k < n:
                if runs[k] != now:
                    if now is not None:
                        yield from out()
                    now, held, best, total = runs[k], [], np.zeros(0, np.int64), np.zeros(0, np.int64)
                if is_doc[k]:
                    stop = k
                    while stop < n and is_doc[stop] and runs[stop] == now:
                        stop += 1
                    held.append((len(best), batch.slice(k, stop - k)))
                    best, total = np.zeros(len(best) + stop - k, np.int64), np.zeros(len(best) + stop - k, np.int64)
                    k = stop
                    continue
                if batch.column("answer")[k].is_valid:
                    doc, links = body
                    value, sizes = _unpack(batch.column("answer")[k].as_py(), np.int64, np.uint32)
                    value = np.repeat(value, sizes)
                    np.add.at(best, doc, links * (value & 1))
                    np.add.at(total, doc, links * (value >> 1))
                else:
                    doc, links = _unpack(batch.column("body")[k].as_py(), np.uint32, np.uint32)
                    body = doc.astype(np.int64), links.astype(np.int64)
                k += 1
        if now is not None:
            yield from out()

    return rows.mapInArrow(work, schema)


def tokenizer_alignment(docs: DataFrame, keep: list[str], a_path: str, b_path: str, text_col: str = "text",
                        run_bytes: int = RUN_BYTES, parts: int = PARTS) -> DataFrame:
    """``row``, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for every row of ``docs``.

    ``a_path`` and ``b_path`` are read by the driver; the vocabularies (a few MB) travel by broadcast.
    """
    files = [open(p, "rb").read() for p in (a_path, b_path)]
    spark = docs.sparkSession
    texts = with_text(docs, text_col, keep)
    encoded = materialise(_encoded(texts, ship(spark, tuple(files)), run_bytes, parts), "alignment-runs")
    spilled = encoded.where("part is not null")
    totals = materialise(_totals(spilled, Aligner(*files).n_b), "alignment-totals")
    answers = materialise(_answers(spilled, totals), "alignment-answers")
    return _added(encoded, answers, encoded.schema["row"].dataType)


def op11_tokenizer_alignment(spark, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = tokenizer_alignment(docs, ["doc_id"], f"{tokenizers}/byte_bpe_50k.json", f"{tokenizers}/piece_bpe_32k.model")
    return out.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
