"""Candidate structures: inverted and prefix index, MinHash with bands, Bloom filter."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import PRIME, WORD, polynomial
from ..functions.text import SPACE


def postings(docs: DataFrame) -> DataFrame:
    """id, term, once for each pair."""
    return docs.select("id", F.explode_outer(F.array_distinct("tokens")).alias("term")).where("term is not null")


def prefixes(text: Column, size: int = 3) -> Column:
    """First size characters of each word that has as many, in lower case; words are cut at white space only."""
    words = F.filter(F.split(F.lower(text), f"[{SPACE}]+"), lambda w: F.length(w) >= size)
    return F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, size)))


def prefix_postings(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.explode_outer(prefixes(F.col("text"))).alias("term")).where("term is not null")


def search_all(index: DataFrame, terms: list[str]) -> DataFrame:
    """Ids that have every known one of terms; terms that no document has are ignored, none known finds nothing.

    The filter reaches the scan, and counting per id is combined before the shuffle.
    """
    hits = index.where(F.col("term").isin(*terms)) if terms else index.where(F.lit(False))
    known = hits.select("term").distinct().agg(F.count("*").alias("known"))
    counts = hits.groupBy("id").agg(F.count_distinct("term").alias("n"))
    return counts.join(F.broadcast(known), (F.col("n") == F.col("known")) & (F.col("known") > 0)).select("id")


# ---- MinHash


#: Characters of a term that count.
DIGITS = 256


@dataclass(frozen=True)
class LshConfig:
    hashes: int = 128
    bands: int = 16
    #: As the design was first written, every signature is zero and all documents are candidates.
    degenerate: bool = False


def term_values(terms: list[str]) -> np.ndarray:
    """The terms' part of every hash: the first 256 codes as a base-31 number of that many digits, zeros at its end, modulo the prime."""
    codes = [t[:DIGITS].encode("utf-32-le", "surrogatepass") for t in terms]
    size = np.fromiter((len(c) // 4 for c in codes), np.int64, len(codes))
    flat, first = np.frombuffer(b"".join(codes), np.uint32).astype(np.uint64), np.cumsum(size) - size
    value, prime = np.zeros(len(terms), np.uint64), np.uint64(PRIME)
    for i in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > i)
        value[on] = (value[on] * np.uint64(31) + flat[first[on] + i]) % prime
    power = np.array([pow(31, i, PRIME) for i in range(DIGITS + 1)], np.uint64)[DIGITS - size]
    return (value * (power >> np.uint64(16)) % prime * np.uint64(1 << 16) + value * (power & np.uint64(0xFFFF))) % prime


def signatures(docs: DataFrame, config: LshConfig = LshConfig()) -> DataFrame:
    """id, sig (array): for each seed 31 (i + 1) the least hash of the terms; documents (id, tokens) without terms have none.

    A term is hashed once a batch and a seed only shifts it, so a document's signature is a few array operations where it is: no
    shuffle, one pass.
    """
    docs = docs.select("id", "tokens")
    if config.degenerate:
        return docs.where(F.size("tokens") > 0).select("id", F.array_repeat(F.lit(0).cast("long"), config.hashes).alias("sig"))
    shift = np.array([31 * (i + 1) * pow(31, DIGITS, PRIME) % PRIME for i in range(config.hashes)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                lists = b["tokens"]
                d = lists.flatten().dictionary_encode()
                value = term_values(d.dictionary.to_pylist())
                code, size = d.indices.to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                first = np.cumsum(size) - size
                rows = np.flatnonzero(size)
                sig = np.empty((len(rows), config.hashes), np.int64)
                for j, r in enumerate(rows):
                    v = value[np.unique(code[first[r] : first[r] + size[r]])]
                    least = np.full(config.hashes, 2**63, np.uint64)
                    for i in range(0, len(v), 4096):
                        h = v[i : i + 4096, None] + shift  # both are under the prime, so one subtraction is the modulo
                        h -= (h >= np.uint64(PRIME)) * np.uint64(PRIME)
                        np.minimum(least, (h & np.uint64(WORD - 1)).min(axis=0), out=least)
                    sig[j] = least
                flat = pa.array(sig.ravel(), pa.int64())
                yield pa.record_batch([b["id"].take(pa.array(rows)), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * config.hashes, pa.int32()), flat)], names=["id", "sig"])

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, sig array<bigint>")


def bands(signed: DataFrame, config: LshConfig = LshConfig()) -> DataFrame:
    """id, bucket: a row for each band of each signature."""
    rows = config.hashes // config.bands
    keys = [F.concat_ws(":", F.lit(str(i)), F.array_join(F.slice("sig", i * rows + 1, rows).cast("array<string>"), ",")) for i in range(config.bands)]
    return signed.select("id", F.explode(F.array(*keys)).alias("bucket"))


def candidates(queries: DataFrame, signed: DataFrame, config: LshConfig = LshConfig()) -> DataFrame:
    """query, id of signatures (id, sig) that share a bucket with one of queries (id, sig): a join on buckets, whose hot ones AQE splits."""
    q = bands(queries, config).select(F.col("id").alias("query"), "bucket")
    return q.join(bands(signed, config), "bucket").select("query", "id").distinct()


def lsh_candidates(queries: DataFrame, docs: DataFrame, config: LshConfig = LshConfig()) -> DataFrame:
    """candidates of documents (id, tokens)."""
    return candidates(signatures(queries, config), signatures(docs, config), config)


def index_stats(docs: DataFrame, config: LshConfig = LshConfig()) -> DataFrame:
    return docs.agg(F.count("*").alias("n_docs"), F.lit(config.hashes).cast("long").alias("n_hashes"), F.lit(config.bands).cast("long").alias("n_bands"), F.avg(F.size(F.array_distinct("tokens"))).alias("avg_terms"))


# ---- Bloom filter


@dataclass(frozen=True)
class BloomConfig:
    items: int
    rate: float = 0.01

    @property
    def bits(self) -> int:
        return math.ceil(-(self.items * math.log(self.rate)) / math.log(2) ** 2)

    @property
    def hashes(self) -> int:
        return max(1, min(math.ceil(self.bits / self.items * math.log(2)), 16))


def positions(value: Column, config: BloomConfig) -> Column:
    return F.array(*[F.pmod(polynomial(value, i + 1, WORD), F.lit(config.bits)) for i in range(config.hashes)])


def fitting(values: DataFrame, rate: float = 0.01) -> BloomConfig:
    """The filter's size for as many values as there are."""
    return BloomConfig(items=max(1, values.count()), rate=rate)


def bloom_bits(values: DataFrame, config: BloomConfig) -> DataFrame:
    """The filter: its set bits (pos); at most config.bits rows."""
    return values.select(F.explode(positions(F.col("value"), config)).alias("pos")).distinct()


def bloom_probe(values: DataFrame, bits: DataFrame, config: BloomConfig) -> DataFrame:
    """value, maybe: whether all its bits are set."""
    each = values.select("value").distinct().select("value", F.explode(F.array_distinct(positions(F.col("value"), config))).alias("pos"))
    return each.join(bits.withColumn("set", F.lit(True)), "pos", "left").groupBy("value").agg(F.bool_and(F.coalesce("set", F.lit(False))).alias("maybe"))


def bloom_rate(bits: DataFrame, config: BloomConfig) -> DataFrame:
    """The estimated share of false positives."""
    return bits.agg(F.pow(F.count("*") / F.lit(float(config.bits)), F.lit(float(config.hashes))).alias("rate"))
