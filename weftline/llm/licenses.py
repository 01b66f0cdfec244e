"""License scan: MinHash bands over overlapping windows find templates, exact containment verifies them.

For each size class (a power of two of 5-word shingles, 1.5 times a template's at least) a text is seen in windows of twice that size
that overlap by half, so any run of up to that size, a notice with words put in too, lies whole in one window. Windows and templates
meet in a band of one row: a template that has 0.8 of its shingles in a window agrees with it in at least
0.8 t / (2 s + 0.2 t), over 0.129, of its shingles; 192 bands miss such a pair with probability under
0.871 ** 192 < 1e-11. Each pair that meets is verified on the words themselves, over the best stretch of the window
and one size on either side.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import spread, written

SHINGLE, SIMILARITY = 5, 0.8
#: Bands of one row each.
BANDS = 192
#: As much text as the templates of one pass may have, so that they can go to every task; more templates take more passes.
TEMPLATE_BYTES = 4 << 20
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_RNG = np.random.default_rng(5)
_A = _RNG.integers(1, 2**63, BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, BANDS, np.uint64)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it
will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
_GPL2 = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it
will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
_LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published
by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that
it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
_AGPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published
by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it
will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""

#: Public notices: license and text. A license may have several.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", _MIT), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This project is licensed under the MIT License."),
    ("BSD", _BSD), ("BSD", "Licensed under the BSD 3-Clause License."), ("BSD", "Released under the BSD License."),
    ("Apache-2.0", _APACHE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License 2.0."),
    ("GPL-3.0", _GPL), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License v3."),
    ("GPL-2.0", _GPL2), ("LGPL-2.1", _LGPL), ("AGPL-3.0", _AGPL), ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."), ("ISC", _ISC), ("MPL-2.0", _MPL),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def words_of(text: str | None) -> list[bytes]:
    """Digits, letters a-z (A-Z lower-cased) and all that isn't ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def shingle_hashes(words: list[bytes], n: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash for each run of n words; of fewer words, one for all."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if 0 < len(h) < n:
        n = len(h)
    if not len(h):
        return h
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[i : len(h) - n + 1 + i]
    return (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def minhash(hashes: np.ndarray) -> np.ndarray:
    return np.array([(hashes * a + b).min() for a, b in zip(_A, _B)]) if len(hashes) else np.zeros(0, np.uint64)


class Templates:
    """Templates by size class, with their bands and exact shingles; scan keeps them within TEMPLATE_BYTES."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names, self.shingles, self.length, self.classes, lone = [], [], [], {}, []
        for name, text in templates:
            words = words_of(text)
            if not words:
                continue
            n, at = min(SHINGLE, len(words)), len(self.names)
            h = np.unique(shingle_hashes(words))
            self.names.append(name)
            self.length.append(n)
            self.shingles.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)})
            size = 1 << ((3 * (len(words) - n + 1) + 1) // 2 - 1).bit_length()
            self.classes.setdefault((n, size), []).append((at, minhash(h)))
            lone += [h[np.argmin(h * a + b)] for a, b in zip(_A, _B)]
        #: The shingles that are the least of some template in some band: a window without one of them meets none.
        self.least = np.unique(np.array(lone, np.uint64))

    def find(self, text: str | None) -> dict[str, tuple[float, int, int]]:
        """License: greatest containment, and the words first and end of the first window that has it."""
        words, found, which = words_of(text), {}, {}
        by_n = {}
        for n, size in self.classes:
            if n not in by_n:
                h = shingle_hashes(words, n) if len(words) >= n else np.zeros(0, np.uint64)
                by_n[n] = h, np.flatnonzero(np.isin(h, self.least)) if len(h) else h
            h, hits = by_n[n]
            if not len(hits):
                continue
            starts = np.unique(np.r_[hits // size * size, np.maximum(hits // size - 1, 0) * size])
            for start in starts.tolist():
                window = np.unique(h[start : start + 2 * size])
                signature = minhash(window)
                for at, bands in self.classes[n, size]:
                    if (signature == bands).any():
                        # a notice may begin before the window or end after it: one size more on either side is looked at
                        begin, last = max(0, start - size), min(start + 3 * size, len(h))
                        share, first, end = self._best(at, [tuple(words[i : i + n]) for i in range(begin, last)], 2 * size)
                        if share >= SIMILARITY and share > found.get(self.names[at], (0.0,))[0]:
                            found[self.names[at]] = (share, begin + first, begin + end + n - 1)
                            which[self.names[at]] = at
        # of notices that are mostly the same words, the best one has the place
        beaten = [x for x in found if any(found[y][0] > found[x][0] and self._alike(which[x], which[y]) and found[x][1] < found[y][2] and found[y][1] < found[x][2] for y in found)]
        return {x: v for x, v in found.items() if x not in beaten}

    def _alike(self, a: int, b: int) -> bool:
        return 2 * len(self.shingles[a] & self.shingles[b]) >= min(len(self.shingles[a]), len(self.shingles[b]))

    def _best(self, at: int, own: list[tuple], width: int) -> tuple[float, int, int]:
        """The greatest containment of a template in width shingles in a row of own, and the first and end of those that have it."""
        wanted, inside, best = self.shingles[at], Counter(), (0, 0, 0)
        for i, s in enumerate(own):
            if s in wanted:
                inside[s] += 1
            if i >= width and (gone := own[i - width]) in wanted:
                inside[gone] -= 1
                if not inside[gone]:
                    del inside[gone]
            if len(inside) > best[0]:
                best = len(inside), max(0, i - width + 1), i + 1
        return best[0] / len(wanted), best[1], best[2]


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """Licenses whose template has 0.8 or more of its 5-word shingles in a window of a document, the better one of notices that share most words.

    Returns doc_id, license, containment, first_word, end_word (the window, exclusive end): a row for each license of
    each row of docs. Templates of fewer than five words are one shingle of all their words, those
    without words are left out. Null and empty texts have none; rows are judged one by one, so repeats and null ids
    change nothing; an empty table gives no rows; extra columns are ignored. Whole texts, no shuffle.
    """
    pairs, groups, size = TEMPLATES if templates is None else templates, [[]], 0
    for name, text in pairs:  # a pass over docs for each group of templates that a task can hold
        if groups[-1] and size + len(text.encode()) > TEMPLATE_BYTES:
            groups.append([])
            size = 0
        groups[-1].append((name, text))
        size += len(text.encode())
    if len(groups) == 1:
        return _scan(docs, groups[0])
    # a license of several groups is one row of a document still: rows are told apart by a number that a written table fixes
    docs = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.monotonically_increasing_id()), "licenses-documents")
    rows = docs.select(F.col("row").alias("doc_id"), "text")
    every = _scan(rows, groups[0])
    for g in groups[1:]:
        every = every.unionByName(_scan(rows, g))
    order = Window.partitionBy("doc_id", "license").orderBy(F.col("containment").desc(), "first_word", "end_word")
    every = every.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r").withColumnRenamed("doc_id", "row")
    return docs.select("row", "doc_id").join(every, "row").select("doc_id", "license", "containment", "first_word", "end_word")


def _scan(docs: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    made: list[Templates] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Templates(pairs))
        for batch in batches:
            rows = []
            for i in range(0, batch.num_rows, 500):
                b = batch.slice(i, 500)
                for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                    rows += [(doc_id, name, *v) for name, v in made[0].find(text).items()]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()))], names=["doc_id", "license", "containment", "first_word", "end_word"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, license string, containment double, first_word long, end_word long")


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
