"""Shared pieces: key columns, connected components, and the cluster's shared folder (sources.shared)."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path, open_input, open_output, parquet_files, spread, written

__all__ = ["LAST_ID", "components", "fresh", "merged", "new_path", "open_input", "open_output", "parquet_files", "release", "spread", "text_of", "written"]

#: Stands for a null doc_id wherever ids are ordered: a null comes after every id.
LAST_ID = 2**63 - 1


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now: it does so when the driver collects its garbage."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """names, each with underscores after it until no column of taken has it (case apart): helper columns that can't clash."""
    known, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        out.append(name)
    return out


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def merged(df: DataFrame) -> DataFrame:
    """df for a join by sorting both sides. Of a side that grows with the input Spark's size check sees compressed bytes, and the hash table that
    it then builds in the driver to send it to all executors takes many times as much."""
    return df.hint("merge")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges: columns a, b (long, not null; loops and repeats allowed). Returns node, root: the
    smallest node of its component, for every node that has an edge to another. Hubs are only
    aggregated (min) and joined, never gathered; every round is a written table.
    """
    e = written(_oriented(edges.select("a", "b")), label)
    state = _signature(e)
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(merged(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _oriented(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(merged(least), "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
        e = written(_oriented(small.select(F.col("x.b").alias("a"), F.col("x.m").alias("b"))), label)
        if (now := _signature(e)) == state:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b")).distinct())
        state = now


def _oriented(e: DataFrame) -> DataFrame:
    return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _signature(e: DataFrame) -> tuple:
    """Tells two sets of edges apart: their number, and sums of parts of their hashes that stay far from overflow (2**20 x 2**43 rows)."""
    one = F.xxhash64("a", "b")
    return tuple(e.agg(F.count("*"), F.bit_xor(one), F.sum(F.shiftrightunsigned(one, 44)), F.sum(one.bitwiseAND(F.lit((1 << 20) - 1).cast("long")))).first())
