"""Mixing sources to target weights, in DataFrame functions only.

Sizes are summed per source before anything is shuffled; shares are settled over that small table
and every document is emitted floor(rate) times, plus one copy if a uniform number drawn from the
hash of its id falls below the fraction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, spread, written

#: A word: anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes: source, source_size (a row for each source). Adds rank, weight and target (double).

    Sources by code point, a null last, take the weights in turn; together they get share times all
    sizes; a target stops at cap times its source's size and the excess goes to the others by weight,
    again and again until none is above. Ranks come from range partitions, so no task sorts all
    sources; each round of resharing is one aggregation whose result is two numbers.
    """
    order = F.col("source").asc_nulls_last()
    parts = written(sizes.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "mix-sources")
    before, offsets = 0, []
    for part, n in sorted((r["part"], r["n"]) for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()):
        offsets += [F.lit(part), F.lit(before)]
        before += n
    offset = F.create_map(*offsets)[F.col("part")] if offsets else F.lit(0)
    rank = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + offset
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = written(parts.withColumn("rank", rank.cast("long")).withColumn("weight", weight).drop("part"), "mix-ranks")

    full = F.lit(float(cap)) * F.col("source_size")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    per_weight, capped = 0.0, -1
    while True:
        above = full < F.lit(per_weight) * F.col("weight") if capped >= 0 else F.lit(False)
        n, held, rest = ranked.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)), F.sum(F.when(~above, F.col("weight")))).first()
        if n == capped or not rest:
            break
        capped, per_weight = n, (share * total - cap * held) / rest
    return ranked.withColumn("target", F.least(full, F.lit(per_weight) * F.col("weight")))


def mix_plan(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """How often the mix takes each document.

    Returns a row for each row of docs: doc_id, size (words), source, source_size, target, rate, copies,
    taken (copies times size). A null text has size 0; a null source is a source of its own; rows that
    repeat an id draw the same number; a source without words gets rate 0; an empty table gives none.
    Other columns of docs are ignored.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = written(docs.select("doc_id", "source", size.alias("size")), "mix-sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    t = targets.select(F.col("source").alias("__of"), "source_size", "target")
    both = _by_source(sized, t, "__of")
    return both.withColumn("rate", _rate()).withColumn("copies", _copies(F.col("rate"), seed)).withColumn("taken", F.col("copies") * F.col("size"))


#: Rows of one source are joined in so many parts, so that a source of a third of all rows is no single task.
SALTS = 8


def _by_source(rows: DataFrame, of_source: DataFrame, of: str) -> DataFrame:
    """rows with the other columns of of_source (a row for each source, in column of); broadcast only if Spark finds it small."""
    part, salt = fresh([*rows.columns, *of_source.columns], "part", "salt")
    of_source = written(of_source, "mix-targets").withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn(part, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return salted.join(of_source, (F.col(part) == F.col(salt)) & F.col("source").eqNullSafe(F.col(of))).drop(part, salt, of)


def _rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))


def _copies(rate: Column, seed: int) -> Column:
    named = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    drawn = F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    return F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """The mix itself: docs with every row as often as mix_plan says, all columns kept, whatever their names; a text of any length is counted where it is."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = docs.select("source", size.alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    of, rate, copy = fresh(docs.columns, "of", "rate", "copy")
    rates = source_targets(sizes, weights, share, cap).select(F.col("source").alias(of), _rate().alias(rate))
    return _by_source(docs, rates, of).withColumn(copy, F.explode(F.array_repeat(F.lit(1), _copies(F.col(rate), seed).cast("int")))).select(*docs.columns)


def op10_mix(spark, sf_dir: str) -> DataFrame:
    return mix_plan(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS r FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE r WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM src
), steps AS (
  SELECT *, 2.0::DOUBLE * source_size / w AS full_at,
    coalesce(sum(source_size) OVER before, 0) AS held, sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    sum(source_size) OVER () AS total
  FROM weighed WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT (1.5::DOUBLE * total::DOUBLE - 2.0::DOUBLE * held::DOUBLE) / rest AS per_weight FROM steps
  WHERE full_at >= (1.5::DOUBLE * total::DOUBLE - 2.0::DOUBLE * held::DOUBLE) / rest ORDER BY full_at, source LIMIT 1
), goal AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, (SELECT per_weight FROM level) * w) AS target FROM weighed
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS drawn
  FROM sized JOIN goal ON sized.source IS NOT DISTINCT FROM goal.source
)
SELECT doc_id, size, source_size, target,
  CAST(floor(rate) + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies,
  CAST(floor(rate) + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) * size AS taken
FROM rated
"""
