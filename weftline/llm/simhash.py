"""SimHash near-dedup by segment popcounts.

A fingerprint becomes the vector of the bit counts of its 16 segments of 4 bits. Manhattan distance
between two vectors is a lower bound of the Hamming distance of the fingerprints, so links lie within
distance 2 on that grid. Two grid points within distance 2 have a common point within 1 of both:
every distinct fingerprint enters the cells within 1 of its own (33 at most), cells are joined, and
the pairs that meet are verified on the fingerprints themselves.

With a similarity asked for, documents link by the Jaccard similarity of their shingles instead. The
grid's links are compared exactly. At 0.8 64-bit fingerprints differ in 10 bits or so, at times in 20, a
radius at which most of a large corpus meets; so MinHash bands tell which further fingerprints, of 512
bits, are held against each other, and pairs within their radius are compared exactly as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LAST_ID, components, fresh, merged, spread, written

SEGMENTS, WIDTH = 16, 4
#: A cell of more fingerprints than this is joined by three exact bit bands inside the cell: of two
#: fingerprints within 2 bits, one band at least is equal. Nothing is dropped.
CROWDED = 256
BANDS = ((0, 22), (22, 21), (43, 21))

#: Bands of the MinHash signature and rows of each: of two texts with similarity 0.8, no band is equal with
#: probability (1 - 0.8 ** 4) ** 40 < 1e-9.
MIN_BANDS, MIN_ROWS = 40, 4

#: 64-bit words of the fingerprint that pairs of the bands are held against, the first one being the grid's. A pair may differ in as many bits as
#: expected at the similarity and DEVIATIONS standard deviations more; sets of under FEW shingles, whose votes are no normal variables, aren't filtered.
WORDS, DEVIATIONS, FEW = 8, 6, 32

_MIX = np.uint64(0xBF58476D1CE4E5B9)
_HASH = partial(xxhash.xxh64_intdigest, seed=42)
_RNG = np.random.default_rng(7)
_A = _RNG.integers(1, 2**63, MIN_BANDS * MIN_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, MIN_BANDS * MIN_ROWS, np.uint64)
_C = _RNG.integers(1, 2**63, WORDS - 1, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles_of(text: str | None, shingle: int) -> list[bytes]:
    """Runs of words, with repeats; of fewer words, one for all, and none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    return list(map(b" ".join, zip(*[words[i:] for i in range(shingle)]))) if len(words) >= shingle else [b" ".join(words)]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits as a signed long; a text without words has 0."""
    parts = shingles_of(text, shingle)
    if not parts:
        return 0
    h = np.fromiter(map(_HASH, parts), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (long) of each row, by an Arrow-batched function: whole texts, no shuffle."""

    @F.pandas_udf("long")
    def fp(text: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in text], dtype="int64")

    return docs.select("doc_id", fp("text").alias("fp"))


def links(fps: DataFrame) -> DataFrame:
    """fps: distinct fp. Returns the pairs fa, fb at 1 or 2 differing bits, each once or more."""
    counts = [F.bit_count(F.shiftrightunsigned("fp", WIDTH * i).bitwiseAND(F.lit(2**WIDTH - 1).cast("long"))).cast("long") for i in range(SEGMENTS)]
    home = counts[0]
    for i in range(1, SEGMENTS):
        home = home + F.shiftleft(counts[i], 3 * i)
    at = fps.select("fp", home.alias("home"))
    seg = [F.shiftrightunsigned("home", 3 * i).bitwiseAND(F.lit(7).cast("long")) for i in range(SEGMENTS)]
    near = [F.col("home")]
    for i in range(SEGMENTS):
        near += [F.when(seg[i] < WIDTH, F.col("home") + (1 << 3 * i)), F.when(seg[i] > 0, F.col("home") - (1 << 3 * i))]
    cells = at.select("fp", F.explode(F.array(*near)).alias("cell")).where("cell is not null")
    crowded = cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("cell")

    def pairs(entries: DataFrame, *keys: str) -> DataFrame:
        a, b = entries.withColumnRenamed("fp", "fa"), entries.withColumnRenamed("fp", "fb")
        return a.join(merged(b), list(keys)).where((F.col("fa") < F.col("fb")) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= 2)).select("fa", "fb")

    bands = [F.struct(F.lit(n).alias("band"), F.shiftrightunsigned("fp", at_).bitwiseAND(F.lit((1 << bits) - 1)).alias("bits")) for n, (at_, bits) in enumerate(BANDS)]
    dense = cells.join(merged(crowded), "cell", "left_semi").select("fp", "cell", F.explode(F.array(*bands)).alias("x")).select("fp", "cell", "x.band", "x.bits")
    return pairs(cells.join(merged(crowded), "cell", "left_anti"), "cell").union(pairs(dense, "cell", "band", "bits"))


def set_key(hashes: np.ndarray) -> int:
    """64 bits of a sorted set of shingle hashes, as a signed long; 0 for none."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64)) if len(hashes) else 0


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A long for each MinHash band; none without shingles."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(len(_A), 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 1 << 7):  # stays in a core's cache
        h = hashes[i : i + (1 << 7), None] * _A + _B
        np.minimum(least, (h ^ (h >> np.uint64(32))).min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), seed=n) for n, b in enumerate(least.reshape(MIN_BANDS, MIN_ROWS))], np.uint64).view(np.int64)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WORDS longs of a set of shingle hashes: the SimHash of the hashes, then of other hashes of them; zeros for none."""
    ones = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(hashes), 255):
        h = hashes[i : i + 255, None]
        more = h * _C
        more ^= more >> np.uint64(32)
        more *= _MIX
        more ^= more >> np.uint64(29)
        ones += np.add.reduce(np.unpackbits(np.concatenate([h, more], axis=1).view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)


def _hashes(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(np.fromiter(map(_HASH, shingles_of(text, shingle)), np.uint64))


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, fp (long: key of the set of shingles), n (its size), wide (its fingerprint), bands and text of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                b = batch.slice(i, 500)
                own = [_hashes(t, shingle) for t in b["text"].to_pylist()]
                columns = {"fp": pa.array(map(set_key, own), pa.int64()), "n": pa.array(map(len, own), pa.int64()), "wide": pa.array(map(wide_fingerprint, own), longs), "bands": pa.array(map(band_keys, own), longs)}
                yield pa.record_batch({"doc_id": b["doc_id"], **columns, "text": b["text"]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long, n long, wide array<long>, bands array<long>, text string")


def bits_apart(similarity: float) -> float:
    """Bits of 64 * WORDS in which sets of that Jaccard similarity may differ: their vectors' cosine is 2s / (1 + s) at least."""
    share = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return 64 * WORDS * share + DEVIATIONS * math.sqrt(64 * WORDS * share * (1 - share))


def similar(sets: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """sets: from shingle_sets; nodes: fp, n, wide, bands of each distinct set. Returns links fa, fb of sets with that Jaccard
    similarity, by which the same sets are connected as by all such links.

    First the grid's links and each cell's and band's sets with its smallest one, which is a number of pairs in proportion to
    the sets; then all pairs of a band that these links haven't connected yet.
    """
    sims = nodes.groupBy(F.col("wide")[0].alias("fp")).agg(F.min("fp").alias("of"))
    sims = written(sims, "simhash-sims")
    grid = written(links(sims.select("fp")).distinct(), "simhash-grid")
    grid = grid.join(merged(sims.select(F.col("fp").alias("fa"), F.col("of").alias("a"))), "fa").join(merged(sims.select(F.col("fp").alias("fb"), F.col("of").alias("b"))), "fb")
    cell = nodes.select("fp", F.col("wide")[0].alias("sim")).join(merged(sims.withColumnRenamed("fp", "sim")), "sim")
    bucket = Window.partitionBy("bits")
    own = nodes.select("fp", F.explode("bands").alias("bits"))
    met = written(own.select("bits", "fp", F.min("fp").over(bucket).alias("of"), F.max("fp").over(bucket).alias("last")).where("of < last").drop("last"), "simhash-met")
    stars = written(_ordered(grid.select("a", "b").union(cell.select("fp", "of")).union(met.select("fp", "of"))), "simhash-stars")
    first = written(_alike(sets, nodes, stars, shingle, similarity), "simhash-links")
    comp = components(first.select(F.col("fa").alias("a"), F.col("fb").alias("b")), "simhash-near")
    at = met.join(merged(comp), met.fp == comp.node, "left").select("bits", "fp", F.coalesce("root", "fp").alias("root"))
    open_ = at.select("*", F.min("root").over(bucket).alias("low"), F.max("root").over(bucket).alias("high")).where("low < high")
    open_ = written(open_.select("bits", "fp", "root"), "simhash-open")
    a, b = (open_.select("bits", F.col("fp").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    rest = written(_ordered(a.join(merged(b), "bits").where("ra < rb").select("a", "b")).join(merged(stars), ["fa", "fb"], "left_anti"), "simhash-rest")
    return first.union(written(_alike(sets, nodes, rest, shingle, similarity), "simhash-links"))


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs a, b of unlike ones as distinct fa < fb."""
    a, b = pairs.columns
    return pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("fa"), F.greatest(a, b).alias("fb")).distinct()


def _alike(sets: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Of pairs fa < fb those of that similarity: by sizes, then by fingerprints, then exactly."""
    known = [nodes.select(F.col("fp").alias(f"f{x}"), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"w{x}")) for x in "ab"]
    both = pairs.join(merged(known[0]), "fa").join(merged(known[1]), "fb").where(F.least("na", "nb") >= similarity * F.greatest("na", "nb"))
    apart = sum((F.bit_count(F.col("wa")[i].bitwiseXOR(F.col("wb")[i])) for i in range(WORDS)), F.lit(0))
    near_ = written(both.where((F.least("na", "nb") < FEW) | (apart <= bits_apart(similarity))).select("fa", "fb"), "simhash-pairs")
    asked = near_.select(F.col("fa").alias("fp")).union(near_.select("fb")).distinct()
    text = written(sets.join(merged(asked), "fp", "left_semi").groupBy("fp").agg(F.first("text").alias("text")), "simhash-texts")

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        known = lru_cache(16)(lambda t: set(shingles_of(t, shingle)))

        def one(s: str, t: str) -> bool:
            p, q = known(s), known(t)
            both = len(p & q)
            return both >= similarity * (len(p) + len(q) - both)

        return pd.Series([one(s, t) for s, t in zip(x, y)], dtype="bool")

    texts = near_.join(merged(text.select(F.col("fp").alias("fa"), F.col("text").alias("ta"))), "fa").join(merged(text.select(F.col("fp").alias("fb"), F.col("text").alias("tb"))), "fb")
    return texts.where(near("ta", "tb")).select("fa", "fb")


def near_groups(docs: DataFrame, shingle: int = 3, similarity: float | None = None) -> DataFrame:
    """Near-duplicate groups: documents whose fingerprints link, directly or through others.

    similarity: least Jaccard similarity of the sets of shingles by which documents link; fp is then the
    key of the set. By default fingerprints link at 2 bits at most.
    Returns a row for each row of docs: doc_id, fp (long), component_id (smallest doc_id reachable).
    A null or empty text has fingerprint 0 and links like any other. A null doc_id comes after every
    id: its component_id is null only if no id is reachable. Rows that repeat an id share the
    component of all texts of that id's fingerprints; an empty table gives no rows; extra columns are
    ignored. Copies meet as one fingerprint before any join, so a group of thousands costs one node.
    """
    each = written(fingerprints(docs, shingle) if similarity is None else shingle_sets(docs, shingle), "simhash")
    more = [] if similarity is None else [F.first(c).alias(c) for c in ("n", "wide", "bands")]
    nodes = written(each.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(LAST_ID))).alias("rep"), *more), "simhash-nodes")
    found = written(links(nodes.select("fp")).distinct(), "simhash-links") if similarity is None else similar(each, nodes, shingle, similarity)
    comp = components(found.select(F.col("fa").alias("a"), F.col("fb").alias("b")), "simhash-components")
    group = nodes.join(merged(comp), nodes.fp == comp.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = group.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_fp = group.join(merged(least), "root").select("fp", "component_id")
    return each.join(merged(of_fp), "fp").select("doc_id", "fp", F.when(F.col("component_id") < LAST_ID, F.col("component_id")).alias("component_id"))


def deduplicate(docs: DataFrame, shingle: int = 3, similarity: float | None = None) -> DataFrame:
    """docs without the near copies: of each group the document with the smallest id stays
    (one row of it, where the id repeats); rows with a null id stay only where no id is in their group, one
    for each fingerprint."""
    groups = written(near_groups(docs, shingle, similarity), "simhash-groups")
    ids = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    kept = docs.join(merged(ids.select("doc_id")), "doc_id", "left_semi").select(*docs.columns)
    if not ids.where("n > 1").isEmpty():
        again = merged(ids.where("n > 1").select("doc_id"))
        kept = kept.join(again, "doc_id", "left_anti").select(*docs.columns).union(kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))
    (own,) = fresh(docs.columns, "fp")
    lone = groups.where("doc_id is null and component_id is null").select(F.col("fp").alias(own)).distinct()
    if lone.isEmpty():
        return kept

    @F.pandas_udf("long")
    def fp(text: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) if similarity is None else set_key(_hashes(t, shingle)) for t in text], dtype="int64")

    none = docs.where("doc_id is null").withColumn(own, fp("text")).join(merged(lone), own, "left_semi").dropDuplicates([own])
    return kept.union(none.select(*docs.columns))


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    g = near_groups(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
