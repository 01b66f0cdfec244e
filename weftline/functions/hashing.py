"""Hashes as columns: corpora, cache keys, polynomial hashes for MinHash and Bloom filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import new_path, parquet_files, written

#: The first prime over 2**32.
PRIME = 4294967311
WORD = 1 << 32
#: Bytes of values that a task sorts for exact hashes, on average, and rows that the driver takes of them at a time.
PART, BATCH = 32 << 20, 512


def list_hash(urls: Column) -> Column:
    """SHA-256 of the sorted list, joined by a pipe."""
    return F.sha2(F.array_join(F.array_sort(urls), "|"), 256)


def document_hash_text(tokens: Column) -> Column:
    return F.array_join(F.array_sort(tokens), "|")


def corpus_hash(docs: DataFrame) -> DataFrame:
    """SHA-256 of a corpus (tokens) whatever its order: one row, corpus_hash, n_docs.

    Documents are hashed where they are; only their digests meet, sorted, in one task (32 bytes a document,
    in two levels: by the first byte of the digest, then of the 256 results).
    """
    each = docs.select(F.sha2(document_hash_text(F.col("tokens")), 256).alias("h"))
    parts = each.groupBy(F.substring("h", 1, 2).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"), F.count("*").alias("n"))
    whole = F.array_sort(F.collect_list(F.struct("p", "h")))
    return parts.agg(F.sha2(F.array_join(F.transform(whole, lambda x: x["h"]), ""), 256).alias("corpus_hash"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_docs"))


def exact_list_hashes(rows: DataFrame, of: str, value: str, separator: str = "|") -> DataFrame:
    """of, hash, n: SHA-256 of the sorted values of each key, joined by the separator: list_hash for lists of any length.

    SHA-256 takes its input in order, so one place has to see a key's values one after another. Tasks sort them into files by ranges of key and
    value, of which none grows with the input; the driver then takes the files in turn, a batch of rows at a time, and keeps one hash and one row for
    each key. corpus_hash is the form that is spread over tasks.
    """
    import hashlib

    import pyarrow.parquet as pq
    from pyarrow.fs import FileSystem

    spark = rows.sparkSession
    each = written(rows.select(F.col(of).cast("string").alias("of"), F.coalesce(F.col(value), F.lit("")).alias("value")), "hash-values")
    size = each.agg(F.coalesce(F.sum(F.octet_length("value") + 16), F.lit(0))).first()[0]
    parts = max(spark.sparkContext.defaultParallelism, -(-size // PART))
    # copies of a value may be in neighbouring ranges; which of them comes first doesn't count
    ordered = each.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, "of", "value", "row").withColumn("part", F.spark_partition_id()).sortWithinPartitions("of", "value")
    folder = new_path(spark, "hash-order")
    ordered.write.option("maxRecordsPerFile", 0).option("parquet.block.size", 16 << 20).parquet(folder)
    done: list[tuple[str | None, str, int]] = []
    key, digest, n, begun = None, hashlib.sha256(), 0, False
    between = separator.encode()
    fs, files = FileSystem.from_uri(folder)[0], []
    for path in parquet_files(folder):
        with fs.open_input_file(path) as f:
            file = pq.ParquetFile(f)
            if file.metadata.num_rows:
                files.append((next(file.iter_batches(1, columns=["part"]))["part"][0].as_py(), path))
    for _, path in sorted(files):
        with fs.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(BATCH, columns=["of", "value"]):
                for k, v in zip(batch["of"].to_pylist(), batch["value"].to_pylist()):
                    if not begun or k != key:
                        if begun:
                            done.append((key, digest.hexdigest(), n))
                        key, digest, n, begun = k, hashlib.sha256(), 0, True
                    if n:
                        digest.update(between)
                    digest.update(v.encode())
                    n += 1
    if begun:
        done.append((key, digest.hexdigest(), n))
    return spark.createDataFrame(done, "of string, hash string, n long")


def exact_corpus_hash(docs: DataFrame) -> DataFrame:
    """hash, n: SHA-256 of the documents' sorted tokens, pipe-joined, sorted and joined by two pipes; the driver sees all in turn, see exact_list_hashes."""
    return exact_list_hashes(docs.select(F.lit("").alias("of"), document_hash_text(F.col("tokens")).alias("t")), "of", "t", "||").select("hash", "n")


def weak_fingerprint(docs: DataFrame) -> DataFrame:
    """fingerprint: the number of documents and the tokens of the first one (by id), for caches of small corpora only."""
    return docs.agg(F.concat_ws("|", F.count("*"), F.min_by(F.size("tokens"), "id")).alias("fingerprint"))


def _codes(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))


def cache_key(tokens: Column, idf_terms: Column) -> Column:
    """Key of a vector: a 32-bit hash in base 36, the number of tokens and of idf terms."""
    content = F.concat(F.array_join(tokens, "|"), F.lit(":"), F.array_join(F.array_sort(idf_terms), "|"))
    signed = lambda h: F.pmod(h + F.lit(WORD // 2), F.lit(WORD)) - F.lit(WORD // 2)
    h = F.aggregate(_codes(content), F.lit(0).cast("long"), lambda a, c: signed(a * 31 + c))
    return F.concat_ws(":", F.lit("vec"), F.lower(F.conv(F.abs(h).cast("string"), 10, 36)), F.size(tokens).cast("string"), F.size(idf_terms).cast("string"))


def polynomial(text: Column, start: int, modulus: int) -> Column:
    """start and the characters' codes as digits of a base-31 number, modulo."""
    codes = F.when(F.length(text) > 0, _codes(text)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(codes, F.lit(start).cast("long"), lambda a, c: F.pmod(a * 31 + c, F.lit(modulus)))
