"""TF-IDF over (id, tokens): counts, document frequencies, inverse ones, weights, norms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written
from .groups import by_key


@dataclass(frozen=True)
class TfidfConfig:
    log_tf: bool = True
    smooth_idf: bool = True
    min_count: int = 1


def term_counts(docs: DataFrame, config: TfidfConfig = TfidfConfig()) -> DataFrame:
    """id, term, n (count in the document), n_tokens: map-side combined before the one shuffle.

    The outer explode keeps Spark from inferring filters on tokens, which would compute them again below.
    """
    each = docs.select("id", F.size("tokens").alias("n_tokens"), F.explode_outer("tokens").alias("term")).where("term is not null")
    counts = each.groupBy("id", "term").agg(F.count("*").alias("n"), F.first("n_tokens").alias("n_tokens"))
    return counts.where(F.col("n") >= config.min_count) if config.min_count > 1 else counts


def tf(config: TfidfConfig = TfidfConfig()) -> Column:
    return 1 + F.log(F.col("n").cast("double")) if config.log_tf else F.col("n") / F.col("n_tokens")


def document_frequency(counts: DataFrame) -> DataFrame:
    """term, df of counts, one row for each id and term; blank terms don't count."""
    return counts.where(F.trim("term") != "").groupBy("term").agg(F.count("*").alias("df"))


def vocabulary(counts: DataFrame) -> DataFrame:
    """term, index: distinct terms, numbered from 0 in their order. No single task sees all: numbers are those within a range partition plus what is before it."""
    parts = written(counts.select("term").distinct().repartitionByRange("term").withColumn("part", F.spark_partition_id()), "vocabulary")
    offsets, before = [F.lit(-1), F.lit(0).cast("long")], 0
    for part, n in sorted(map(tuple, parts.groupBy("part").agg(F.count("*").alias("n")).collect())):  # a row for each shuffle partition
        offsets += [F.lit(part), F.lit(before).cast("long")]
        before += n
    at = F.row_number().over(Window.partitionBy("part").orderBy("term")) - 1 + F.create_map(*offsets)[F.col("part")]
    return parts.select("term", at.cast("long").alias("index"))


def idf(frequency: DataFrame, n_docs: DataFrame, config: TfidfConfig = TfidfConfig()) -> DataFrame:
    """term, df, idf; n_docs is one row with column n, joined to every term."""
    value = F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1 if config.smooth_idf else F.log(F.col("n") / F.greatest("df", F.lit(1)))
    return frequency.join(F.broadcast(n_docs.select(F.col("n").cast("double").alias("n")).limit(1)), how="cross").select("term", "df", value.alias("idf"))


def n_documents(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n"))


def weights(counts: DataFrame, inverse: DataFrame, config: TfidfConfig = TfidfConfig()) -> DataFrame:
    """id, term, w: only terms of the vocabulary that idf covers."""
    return counts.join(inverse.select("term", "idf").hint("shuffle_hash"), "term").select("id", "term", (tf(config) * F.col("idf")).alias("w"))


def norms(weights: DataFrame) -> DataFrame:
    return weights.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def normalised(weights: DataFrame) -> DataFrame:
    """Vectors of length 1 (a zero vector stays)."""
    return weights.join(norms(weights), "id").select("id", "term", F.when(F.col("norm") > 0, F.col("w") / F.col("norm")).otherwise(F.col("w")).alias("w"))


def unit_lengths(weights: DataFrame) -> DataFrame:
    """id, n_terms, norm, unit: the length of each vector, and that of what normalised makes of it, from one shuffle of the weights."""

    def run(rows, first):
        import numpy as np
        import pyarrow as pa

        w, n = rows["w"].to_numpy(), np.diff([*first, rows.num_rows])
        norm = np.sqrt(np.add.reduceat(w * w, first))
        unit = np.sqrt(np.add.reduceat((w / np.repeat(np.where(norm > 0, norm, 1.0), n)) ** 2, first))
        yield pa.record_batch([rows["id"].take(first).combine_chunks(), pa.array(n), pa.array(norm), pa.array(unit)], names=["id", "n_terms", "norm", "unit"])

    return by_key(weights.select("id", "w"), "id", run, f"id {dict(weights.dtypes)['id']}, n_terms long, norm double, unit double")


def vectors(sources: DataFrame, targets: DataFrame, config: TfidfConfig = TfidfConfig()) -> tuple[DataFrame, DataFrame]:
    """id, terms (array of numbers of terms), weights (array) of sources and of targets (id, tokens): a row for each that has a term of the targets.

    A term's number is the same on both sides; it stands for the term, so terms meet by equality, not by a hash.
    """
    same = sources is targets
    t_counts = written(term_counts(targets, config), "counts")
    inverse = written(idf(document_frequency(t_counts), n_documents(targets), config), "idf").withColumn("n_term", F.monotonically_increasing_id())
    inverse = written(inverse, "idf-numbered")

    def lists(rows, first):
        import pyarrow as pa

        ends = pa.array([*first, rows.num_rows], pa.int32())
        own = lambda c: pa.ListArray.from_arrays(ends, rows[c].combine_chunks())
        yield pa.record_batch([rows["id"].take(first).combine_chunks(), own("n_term"), own("w")], names=["id", "terms", "weights"])

    def side(counts: DataFrame) -> DataFrame:
        w = counts.join(inverse.hint("shuffle_hash"), "term").select("id", "n_term", (tf(config) * F.col("idf")).alias("w"))
        return by_key(w, "id", lists, f"id {dict(w.dtypes)['id']}, terms array<long>, weights array<double>")

    t = side(t_counts)
    return (t if same else side(term_counts(sources, config))), t


# ---- dense vectors


def cosine(a: Column, b: Column, checked: bool = False) -> Column:
    """Cosine of two arrays of doubles, within -1 and 1; 0 if one is empty or zero. Unlike sizes: 0, or an error if checked."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when((F.size(a) > 0) & (length > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / length))).otherwise(F.lit(0.0))
    other = F.raise_error(F.lit("vectors of different dimensions")).cast("double") if checked else F.lit(0.0)
    return F.when(F.size(a) != F.size(b), other).otherwise(value)


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    length = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))
    return F.when(length > 0, F.transform(a, lambda v: v / length)).otherwise(a)


def unit_dot(a: Column, b: Column) -> Column:
    """Cosine of arrays that already have length 1; the shorter one ends the sum."""
    dot = F.aggregate(F.zip_with(a, b, lambda p, q: F.coalesce(p * q, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))
