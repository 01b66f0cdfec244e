"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of the 5-word grams in every run of 10 words the one with the smallest hash (the last of equal ones) is kept, on both sides. Equal
runs keep the same gram, so every shared span of 10 words has one that both sides kept; of neighbouring runs most keep the same one,
so two grams in seven are left. Kept grams are joined, and each hit is extended word by word to its left and right: the words count
as hit if ten in a row agree. Items of fewer than 10 words are one gram each. One scan of the documents serves the word counts and the hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, spread, text_of, written

WINDOW, GRAM = 10, 5
#: What parts words. Splitting at it takes a fifth of the time of matching the words one by one.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Windows of all items that may be broadcast (under 150 bytes each); beyond it both sides are shuffled.
BROADCAST_WINDOWS = 50_000
#: Words of a document that are laid out at a time. A row of each word may be copied with its chunk, so chunks are short.
CHUNK = 64


def word_hashes(text: Column) -> Column:
    """A 64-bit hash for each word with A-Z (no other letters) in lower case."""
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.transform(F.array_remove(F.split(lower, GAP), ""), lambda w: F.xxhash64(w))


def _h(j: int) -> Column:
    return F.col(f"h{j}" if j >= 0 else "hp")


#: Words that a kept gram carries: its own, and those that a run of WINDOW words may have before and after it.
SIDE = WINDOW - GRAM
CONTEXT = GRAM + 2 * SIDE


def _laid_out(rows: DataFrame, *keep: str) -> DataFrame:
    """rows with h (array): a row for each position with the hashes of the word before, hp, and of the next ten, h0 to h9 (null past the
    ends), and a, i: a[i + SIDE] is the word at the position. At least one row for each of rows."""
    n = F.greatest(F.size("h"), F.lit(1))
    padded = F.concat(F.array_repeat(F.lit(None).cast("long"), SIDE), F.col("h"))
    chunks = rows.select(*keep, padded.alias("h"), F.explode(F.sequence(F.lit(0), n - 1, F.lit(CHUNK))).alias("base"))
    c = chunks.select(*keep, "base", F.slice("h", F.col("base") + 1, CHUNK + SIDE + WINDOW + SIDE).alias("a"))
    columns = {"h0": SIDE, "hp": SIDE - 1, **{f"h{j}": SIDE + j for j in range(1, WINDOW)}}
    zipped = F.arrays_zip(*[F.slice("a", at + 1, CHUNK).alias(name) for name, at in columns.items()])
    laid = c.select(*keep, "base", "a", F.posexplode_outer(F.slice(zipped, 1, F.greatest(F.lit(1), F.least(F.lit(CHUNK), F.size("a") - SIDE)))).alias("at", "x"))
    i = F.coalesce("at", F.lit(0))
    return laid.select(*keep, (F.col("base") + i).alias("pos"), i.alias("i"), "a", *[F.col("x")[name].alias(name) for name in columns])


def _gram(j: int) -> Column:
    return F.xxhash64(*[_h(j + k) for k in range(GRAM)])


def _kept(rows: DataFrame, lengths: list[int], *keep: str) -> DataFrame:
    """rows from _laid_out that keep a gram: len (WINDOW, or the words of a short item), fp (its hash), o (place of the gram from pos).

    A run keeps another gram than the run before it if its last gram is the least of both, or the first gram of the run before was the
    least there; other rows have a null fp. They aren't filtered here: Spark would push the filter below and hash every gram again for it.
    """
    last = WINDOW - GRAM
    g = rows.select("*", *[_gram(j).alias(f"g{j}" if j >= 0 else "gp") for j in range(-1, last + 1)])
    inner = F.least(*[F.col(f"g{j}") for j in range(last)])
    g = g.withColumn("inner", inner)
    newest = F.col(f"g{last}") <= F.col("inner")
    place = F.when(newest, last)
    for j in reversed(range(last)):
        place = place.when(F.col(f"g{j}") == F.col("inner"), j)
    changed = F.col("hp").isNull() | (F.col(f"g{last}") <= F.least("gp", "inner")) | (F.col("gp") < F.col("inner"))
    full = F.col(f"h{WINDOW - 1}").isNotNull() & changed
    whole = F.struct(F.lit(WINDOW).alias("len"), F.when(full, F.least("inner", f"g{last}")).alias("fp"), F.when(full, place).otherwise(0).alias("o"))
    short = [F.struct(F.lit(n).alias("len"), F.when(_h(n - 1).isNotNull(), F.xxhash64(F.lit(n), *[_h(j) for j in range(n)])).alias("fp"), F.lit(0).alias("o")) for n in lengths]
    k = g.withColumn("k", F.explode(F.array(whole, *short)) if short else whole)
    return k.select(*keep, "pos", "i", "a", "k.len", "k.fp", "k.o")


def _context() -> Column:
    """SIDE words before the gram, the gram, and what follows: of a short item all its words are in it."""
    return F.slice("a", F.col("i") + F.col("o") + 1, CONTEXT)


def item_grams(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """Distinct kept grams (win, len, fp, context), the items of each (win, item_id), and the lengths of short items."""
    items = benchmark.select("item_id", word_hashes(text_of()).alias("h")).where(F.size("h") > 0).withColumn("n", F.size("h"))
    short = sorted(r[0] for r in items.where(F.col("n") < WINDOW).select("n").distinct().collect())  # nine at most
    k = _kept(_laid_out(items, "item_id", "n"), short, "item_id", "n")
    own = ((F.col("n") >= WINDOW) & (F.col("len") == WINDOW)) | ((F.col("n") < WINDOW) & (F.col("pos") == 0) & (F.col("len") == F.col("n")))
    each = k.where(own & F.col("fp").isNotNull()).select("item_id", "len", "fp", _context().alias("words"))
    each = each.withColumn("win", F.sha2(F.concat_ws(",", F.col("len").cast("string"), F.transform("words", lambda w: F.coalesce(w.cast("string"), F.lit("-")))), 256))
    each = written(each.distinct(), "winnow-items")
    return written(each.drop("item_id").distinct(), "winnow-grams"), each.select("win", "item_id").distinct(), short


def _extent(own: Column, other: Column, length: Column) -> Column:
    """struct(left, right): words before the gram and after its beginning that agree, if ten in a row do (of a short item: if all do), else null."""
    same = lambda at: F.coalesce(F.get(own, F.lit(at)) == F.get(other, F.lit(at)), F.lit(False))

    def run(places: list[int]) -> Column:
        out = F.lit(len(places))
        for n, at in reversed(list(enumerate(places))):
            out = F.when(~same(at), n).otherwise(out)
        return out

    left, right = run(list(range(SIDE - 1, -1, -1))), run(list(range(SIDE, CONTEXT)))
    whole = F.when((right >= GRAM) & (left + right >= WINDOW), F.struct(left.alias("left"), right.alias("right")))
    return F.when(length == WINDOW, whole).when(right >= length, F.struct(F.lit(0).alias("left"), length.alias("right")))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Words of docs inside any occurrence of a benchmark item's window.

    Returns a row for each row of docs: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated.
    A null text has no words; an item without words has no window; items that repeat a window count
    each; a null item_id counts as an item but isn't named in items_sha256. Rows that repeat doc_id
    and text get the same values each; a text of any length is laid out in chunks; rows that share an id (or have none) but not the text are kept
    apart. Empty tables give no rows, or rows without hits. Extra columns are ignored.
    """
    grams, of_window, short = item_grams(benchmark)
    h = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), word_hashes(text_of()).alias("h"))
    keep = ("doc_id", "text_hash", "n_words")
    probes = _kept(_laid_out(h.withColumn("n_words", F.size("h").cast("long")), *keep), short, *keep)
    first = (F.col("pos") == 0) & (F.col("len") == WINDOW)

    w = grams.select("win", F.col("len").alias("wlen"), F.col("fp").alias("wfp"), F.col("words").alias("theirs"))
    equal = (F.col("fp") == F.col("wfp")) & (F.col("len") == F.col("wlen"))
    if grams.count() <= BROADCAST_WINDOWS:
        joined = probes.withColumn("first", first).join(F.broadcast(w), equal, "left").where(F.col("win").isNotNull() | F.col("first"))
        joined = joined.withColumn("own", F.when(F.col("win").isNotNull(), _context()))
    else:
        sent = probes.select(*keep, "pos", "len", "fp", "o", first.alias("first"), _context().alias("own"))
        once = sent.where("first").withColumn("fp", F.lit(None).cast("long")).join(w.limit(0), F.lit(True), "left")
        joined = sent.withColumn("first", F.lit(False)).where("fp is not null").join(w, equal).unionByName(once)
    # written, so that the rows of all words pass code without the extents: Java may leave so long a method uncompiled (not looked into)
    joined = written(joined.select(*keep, "pos", "len", "o", "first", "win", "own", "theirs"), "winnow-met")
    joined = joined.withColumn("x", F.when(F.col("win").isNotNull(), _extent(F.col("own"), F.col("theirs"), F.col("len"))))
    at = (F.col("pos") + F.col("o")).cast("long")
    found = joined.where(F.col("x").isNotNull() | F.col("first")).select(*keep, (at - F.col("x.left")).alias("pos"), (at + F.col("x.right")).alias("end"), F.when(F.col("x").isNotNull(), F.col("win")).alias("win"), F.col("win").alias("met"), "first")
    found = written(found, "winnow-hits")

    key = ["doc_id", "text_hash"]
    # a first row that meets several grams gives several rows for one document: copies are counted by any one of them
    seen = found.where("first").groupBy(*key, "n_words", "met").agg(F.count("*").alias("n")).groupBy(*key, "n_words").agg(F.max("n").alias("n"))
    hits = found.where("win is not null")
    spans = hits.groupBy(*key, "pos").agg(F.max("end").alias("end"))
    upto = F.max("end").over(Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    n_hit = spans.withColumn("new", F.col("end") - F.greatest("pos", F.least(F.coalesce(upto, F.lit(0)), F.col("end")))).groupBy(*key).agg(F.sum("new").alias("n_hit"))
    items = hits.select(*key, "win").distinct().join(of_window, "win").select(*key, "item_id").distinct()
    items = items.groupBy(*key).agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",").alias("items"))

    def same(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.withColumnRenamed("doc_id", "__id").withColumnRenamed("text_hash", "__hash")
        return a.join(b, a.doc_id.eqNullSafe(b["__id"]) & (a.text_hash == b["__hash"]), "left").drop("__id", "__hash")

    all_ = same(same(seen, n_hit), items).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return all_.select(
        *key, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that contain a benchmark window, all columns as they are. Nulls, repeats and empty tables: as in contamination."""
    of, hashed = fresh(docs.columns, "of", "hashed")
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias(of), F.col("text_hash").alias(hashed)).distinct()
    bad = written(bad, "contaminated")  # so that its size is known before Spark chooses the join
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(of)) & (F.xxhash64(text_of()) == F.col(hashed)), "left_anti")


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contamination(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, CAST(len(w) - least(10, len(w)) + 2 AS BIGINT))) AS i FROM b WHERE len(w) > 0)
), spot AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM d, (SELECT DISTINCT n FROM item) WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, item_id, i, spot.n FROM spot JOIN item ON spot.win = item.win AND spot.n = item.n
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
