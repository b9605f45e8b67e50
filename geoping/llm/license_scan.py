"""Operator 1: licence scan by MinHash bands over overlapping text windows, verified by exact containment.

Templates are sets of three-word shingles. Templates of similar length form a class. The
shingles of a text are cut into blocks of half a class's largest template, and every
three neighbouring blocks are a window, so each occurrence of a template lies whole in a
window (templates of fewer than eight shingles: a window starts at every shingle and has the
template's length). A window that contains at least ``CONTAINMENT`` of a template has
a Jaccard similarity s to it that the lengths bound from below; the class takes so many
bands (of one MinHash row) that such a window shares a band with its template with a
probability of at least 1 - ``MISS``: bands = ln(MISS) / ln(1 - s). Windows that
share a band with a template are candidates; the exact share of the template's shingles in the
window then decides.

Templates are few and bounded (``MAX_TEMPLATES``); they are sent to every task.
Documents are scanned where they are: no shuffle.

Defined results: null, empty and wordless texts have no windows and no licences; texts
of fewer than three words have their whole sequence as one shingle; templates without a word
are left out; no templates: no licences; repeated rows are scanned row by row; extra
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoping.llm.common import Words, as_schema, buffers, flat, mix64, slices
from geoping.llm.toxicity import WORD_BYTES

WIDTH = 3
CONTAINMENT = 0.8
MISS = 1e-4
MAX_TEMPLATES = 10_000

#: Short forms and opening paragraphs of public licence notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-line": "Released under the MIT License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def text_shingles(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    return Words(np.array([0, len(raw)]), raw, WORD_BYTES).shingles(WIDTH)[0]


class Class:
    """Templates of similar length: block length, blocks per window, bands, and the templates' MinHash values."""

    def __init__(self, names: list[str], sets: list[np.ndarray], lengths: list[int], containment: float, miss: float):
        self.names, self.sets = names, sets
        longest = max(lengths)
        if longest < 8:
            self.block, self.blocks = 1, longest
        else:
            self.block, self.blocks = -(-longest // 2), 3
        window = self.block * self.blocks
        least = min(math.ceil(containment * len(s)) / (len(s) + window - math.ceil(containment * len(s))) for s in sets)
        self.bands = 1 if least >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - least)))
        self.masks = mix64(np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(longest))
        self.values = np.array([[int(self.hashed(s, j).min()) for j in range(self.bands)] for s in sets], np.uint64)

    def hashed(self, shingles: np.ndarray, band: int) -> np.ndarray:
        return (shingles ^ self.masks[band]) * (self.masks[band] | np.uint64(1))

    def candidates(self, shingles: np.ndarray, first: np.ndarray):
        """Windows of a batch (document, first and last+1 shingle) and the (window, template) pairs that share a band."""
        n = np.diff(first)
        per = -(-n // self.block)
        doc = np.repeat(np.arange(len(n)), per)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        start = first[doc] + nth * self.block
        end = np.minimum(start + self.block * self.blocks, first[doc + 1])
        pairs = set()
        if len(start):
            last = np.repeat(np.cumsum(per), per)
            for j in range(self.bands):
                low = np.minimum.reduceat(self.hashed(shingles, j), start)
                least = low.copy()
                for k in range(1, self.blocks):
                    live = np.arange(len(low)) + k < last
                    np.minimum(least[:len(low) - k], low[k:], out=least[:len(low) - k], where=live[:len(low) - k])
                order = np.argsort(self.values[:, j])
                known = self.values[order, j]
                spot = np.minimum(np.searchsorted(known, least), len(known) - 1)
                for w in np.flatnonzero(known[spot] == least).tolist():
                    for t in np.flatnonzero(self.values[:, j] == least[w]).tolist():
                        pairs.add((w, t))
        return doc, start, end, sorted(pairs)


def classes(templates: dict[str, str], containment: float = CONTAINMENT, miss: float = MISS) -> list[Class]:
    """Templates of up to seven shingles by length, longer ones by powers of two."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    groups: dict = {}
    for name, text in sorted(templates.items()):
        own = text_shingles(text or "")
        if len(own):
            groups.setdefault(len(own) if len(own) < 8 else 1 << len(own).bit_length(), []).append((name, np.unique(own), len(own)))
    return [Class([g[0] for g in group], [g[1] for g in group], [g[2] for g in group], containment, miss) for _, group in sorted(groups.items())]


def scan(docs: DataFrame, templates: dict[str, str], keep: list[str], text_col: str = "text", containment: float = CONTAINMENT, miss: float = MISS) -> DataFrame:
    """``row``, n_shingles, n_candidates, licences (names with their best containment) for every row of ``docs``."""
    frame = docs.select(F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row"), docs[f"`{text_col}`"].cast("string").alias("text"))
    schema = as_schema(frame, "row", "n_shingles bigint", "n_candidates bigint", "licences map<string,double>")
    classes(templates, containment, miss)  # errors show here

    def run(batches):
        known = classes(templates, containment, miss)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                shingles, first = Words(*buffers(flat(part.column("text"))), WORD_BYTES).shingles(WIDTH)
                n = part.num_rows
                tried, found = np.zeros(n, np.int64), [{} for _ in range(n)]
                for c in known:
                    doc, start, end, pairs = c.candidates(shingles, first)
                    for w, t in pairs:
                        d = int(doc[w])
                        tried[d] += 1
                        share = int(np.isin(c.sets[t], shingles[start[w]:end[w]]).sum()) / len(c.sets[t])
                        if share >= containment and share > found[d].get(c.names[t], 0):
                            found[d][c.names[t]] = share
                licences = pa.array([sorted(f.items()) for f in found], pa.map_(pa.string(), pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(np.diff(first), pa.int64()), pa.array(tried, pa.int64()), licences], names=schema.names)

    return frame.mapInArrow(run, schema)


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = scan(docs, TEMPLATES, ["doc_id"])
    names = F.array_sort(F.map_keys("licences"))
    return out.select("row.doc_id", "n_shingles", "n_candidates", F.size(names).cast("bigint").alias("n_licences"), F.array_join(names, ",").alias("licences"),
                      F.array_max(F.map_values("licences")).alias("best_containment"))


def brute_force(text: str | None, templates: dict[str, str], containment: float = CONTAINMENT) -> dict[str, bool]:
    """Licences whose occurrence the method must find: the window of the template's own length with the largest containment."""
    own = text_shingles(text or "")
    out = {}
    for name, template in templates.items():
        seq = text_shingles(template)
        want = set(seq.tolist())
        best = max((len(want & set(own[i:i + len(seq)].tolist())) / len(want) for i in range(max(1, len(own) - len(seq) + 1))), default=0) if len(own) and want else 0
        out[name] = best >= containment
    return out
