"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Words and pairs of words are hashed into buckets. The raw model counts all documents, the target model
a bounded sample of the labelled good ones; a document's log-weight is the log-ratio of the two
models, taken for each n-gram so that length alone neither wins nor loses, times a stated temperature. Adding Gumbel noise and
keeping the k largest keys draws k documents without replacement in proportion to their weights.

Toxic documents are rejected first: a second model weighs n-grams by how many labelled toxic and
clean documents have them, and a document's score is its heaviest n-gram, so one in a long text counts
as much as in a short one.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, spread, text_of, written
from .licenses import words_of

BUCKETS = 1 << 16
#: Labelled good documents at most that the target model and the cut are fitted on: two thirds for the
#: model, the others for the cut. Chosen by the hash of their ids, from all labelled rows.
LABELLED = 20_000
#: N-grams that a document is taken to have besides its own, as likely in either model.
PRIOR = 50
#: Scale of the mean log-ratios: documents are drawn in proportion to exp(SHARPNESS x mean). The noise has a deviation of 1.28, so it
#: decides among documents within some hundredths of the k-th in their mean; clean and junk ones are a tenth and more apart.
SHARPNESS = 100.0
#: Of the labelled good documents that k is fitted on, the share whose weight is under that of the k-th heaviest document.
LOST = 0.001
#: Weight of the raw model within the target model, in n-grams.
SMOOTHING = 10_000.0
#: N-grams of the toxic model at most, the heaviest first.
TOXIC_GRAMS = 1 << 16
#: Of the labelled clean documents that the toxic cut is fitted on, the share that scores above it.
CLEAN_LOST = 0.001
SEED = 11


def grams(text: str | None) -> np.ndarray:
    """Bucket of each word and each pair of neighbours."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    h = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    pair = (h[:-1] * np.uint32(2654435761)) ^ (h[1:] * np.uint32(2246822519))
    pair = (pair ^ (pair >> np.uint32(15))) * np.uint32(2654435761)
    return np.concatenate([h, pair]) >> np.uint32(16)


def labelled_good(labels: DataFrame, limit: int = LABELLED) -> tuple[list[int], list[int]]:
    """Ids for the model and for the cut: rows with quality 1 that aren't toxic; null ids are left out."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    ids = [r[0] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()]
    return [x for i, x in enumerate(ids) if i % 3 < 2], [x for i, x in enumerate(ids) if i % 3 == 2]


def fit(docs: DataFrame, target_ids: list[int]) -> np.ndarray:
    """Log-ratio, target against raw, of each bucket: counted over all docs, 65,536 numbers whatever their size."""
    chosen = frozenset(target_ids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                b = batch.slice(i, 100)
                own = [grams(t) for t in b["text"].to_pylist()]
                raw += np.bincount(np.concatenate(own), minlength=BUCKETS)
                if wanted := [g for g, doc_id in zip(own, b["doc_id"].to_pylist()) if doc_id in chosen]:
                    target += np.bincount(np.concatenate(wanted), minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.record_batch({"bucket": pa.array(at, pa.int32()), "raw": raw[at], "target": target[at]})

    counts = docs.select("doc_id", "text").mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    got = counts.toPandas()
    raw[got.bucket], target[got.bucket] = got.raw, got.target
    p = (raw + 1) / (raw.sum() + BUCKETS)
    return np.log((target + SMOOTHING * p) / (target.sum() + SMOOTHING) / p).astype(np.float32)


def weight_of(ratios: np.ndarray, text: str | None) -> float:
    g = grams(text)
    return SHARPNESS * float(ratios[g].sum(dtype=np.float64)) / (len(g) + PRIOR)


def toxicity_of(model: tuple[np.ndarray, np.ndarray], text: str | None) -> float:
    """The largest log-ratio of a text's n-grams; 0 without any that the model has."""
    known, ratios = model
    if not len(known):
        return 0.0
    g = toxic_grams(text)
    at = np.minimum(np.searchsorted(known, g), len(known) - 1)
    return float(max(0.0, ratios[at[known[at] == g]].max(initial=0.0)))


NO_MODEL = (np.zeros(0, np.uint32), np.zeros(0))


def scores(ratios: np.ndarray, model: tuple[np.ndarray, np.ndarray], text: Column) -> Column:
    """struct(w, t): log-weight and toxicity of a text, in one function, so that a task has one Python worker.

    It is declared nondeterministic though it isn't: else Spark would evaluate it once more for each filter on it.
    """

    @F.pandas_udf("w double, t double")
    def score(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"w": [weight_of(ratios, t) for t in texts], "t": [toxicity_of(model, t) for t in texts]}, dtype="float64")

    return score.asNondeterministic()(text)


def keyed(docs: DataFrame, ratios: np.ndarray, seed: int = SEED, weight: str = "log_weight", key: str = "gumbel_key", model: tuple[np.ndarray, np.ndarray] = NO_MODEL, most: float = float("inf")) -> DataFrame:
    """docs, those of a toxicity over most left out, with the log-weight and the key: the log-weight plus Gumbel noise drawn from the hash of id and text."""
    (own,) = fresh([*docs.columns, weight, key], "scored")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", text_of()), 11).cast("double") + 0.5) / F.lit(float(2**53))
    scored = docs.withColumn(own, scores(ratios, model, text_of())).where(F.col(own)["t"] <= F.lit(most))
    return scored.withColumn(weight, F.col(own)["w"]).withColumn(key, F.col(weight) - F.log(-F.log(u))).drop(own)


def top_k_cut(scores: DataFrame, k: int, column: str = "gumbel_key") -> float:
    """The k-th largest value of a column: counts by 1024 ranges, narrowed until few values are left.

    The driver sees counts, and at the end at most the values of a range of 10,000 rows or of equal ones.
    """
    least, most, n = scores.agg(F.min(column), F.max(column), F.count(column)).first()
    if not k or not n:
        return float("inf")
    if k >= n:
        return least
    above = 0  # rows over most
    while least < most:
        width = (most - least) / 1024
        inside = scores.where(F.col(column).between(least, most))
        bins = {r[0]: r[1:] for r in inside.groupBy(F.least(F.floor((F.col(column) - least) / width), F.lit(1023)).alias("b")).agg(F.count("*"), F.min(column), F.max(column)).collect()}
        for b in sorted(bins, reverse=True):
            size, low, high = bins[b]
            if above + size >= k:
                break
            above += size
        if size <= 10_000:
            return sorted((r[0] for r in inside.where(F.col(column).between(low, high)).select(column).collect()), reverse=True)[k - above - 1]
        if (low, high) == (least, most):
            return low
        least, most = low, high
    return least


def labelled_toxic(labels: DataFrame, limit: int = LABELLED) -> list[int]:
    """Ids of at most limit toxic rows, chosen by their hash; null ids are left out."""
    toxic = labels.where("toxic = 1 and doc_id is not null").select("doc_id").distinct()
    return [r[0] for r in toxic.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()]


def texts_of(docs: DataFrame, ids: list[int]) -> DataFrame:
    """doc_id and text of the rows of docs with one of ids."""
    listed = F.split(F.lit(",".join(map(str, ids))), ",").cast("array<bigint>")
    return docs.select("doc_id", "text").join(F.broadcast(docs.sparkSession.range(1).select(F.explode(listed).alias("doc_id"))), "doc_id", "left_semi")


def toxic_grams(text: str | None) -> np.ndarray:
    """Hash of each distinct word and pair of neighbours, without regard to case and punctuation."""
    words = words_of(text)
    h = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    return np.unique(np.concatenate([h, (h[:-1] * np.uint32(2654435761)) ^ (h[1:] * np.uint32(2246822519))]))


def fit_toxic(docs: DataFrame, toxic_ids: list[int], clean_ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams that toxic documents have more often than clean ones, sorted, and the log-ratio of each."""
    chosen = frozenset(toxic_ids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                g = np.r_[np.int64(-1), toxic_grams(text).astype(np.int64)]  # -1 counts the documents
                yield pa.record_batch({"gram": g, "toxic": np.full(len(g), int(doc_id in chosen)), "clean": np.full(len(g), int(doc_id not in chosen))})

    counts = texts_of(docs, [*toxic_ids, *clean_ids]).mapInArrow(count, "gram long, toxic long, clean long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # a little of the gram's own hash sets equal ratios apart, so that the cut leaves TOXIC_GRAMS rows and no task or driver sorts all
    apart = F.shiftrightunsigned(F.xxhash64("gram"), 11) / F.lit(2.0**53) * 1e-7
    counts = written(counts.where("toxic > 0 or gram < 0").withColumn("order", F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5)) + apart), "toxic-grams")
    n = counts.where("gram < 0").agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("clean"), F.lit(0))).first()
    known = counts.where("gram >= 0")
    got = known.where(F.col("order") >= F.lit(top_k_cut(known.select("order"), TOXIC_GRAMS, "order"))).toPandas().sort_values("gram")
    ratio = np.log((got.toxic + 0.5) / (n[0] + 1)) - np.log((got.clean + 0.5) / (n[1] + 1))
    return got.gram.to_numpy(np.uint32), ratio.to_numpy(np.float64)


def toxic_model(docs: DataFrame, labels: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], float]:
    """The model and the toxicity that all but CLEAN_LOST of the labelled clean documents held out for the cut have at most.

    Without labelled toxic or clean documents, no document is over it.
    """
    toxic_ids, (clean_ids, cut_ids) = labelled_toxic(labels), labelled_good(labels)
    if not toxic_ids or not cut_ids:
        return NO_MODEL, float("inf")
    model = fit_toxic(docs, toxic_ids, clean_ids)
    held = _by_id(texts_of(docs, cut_ids).withColumn("v", scores(np.zeros(BUCKETS, np.float32), model, text_of())["t"]), F.max)
    return model, float(np.quantile(held, 1 - CLEAN_LOST, method="higher")) if held else float("inf")


def _by_id(scored: DataFrame, of_repeated: Callable) -> list[float]:
    """v of each doc_id, of which there are LABELLED at most."""
    return [r[1] for r in scored.groupBy("doc_id").agg(of_repeated("v")).collect()]


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The models' ratios, and the log-weight that all but LOST of the labelled good documents held out for it reach."""
    model_ids, cut_ids = labelled_good(labels)
    ratios = fit(docs, model_ids)
    held = _by_id(texts_of(docs, cut_ids).withColumn("v", scores(ratios, NO_MODEL, text_of())["w"]), F.min) if cut_ids else []
    return ratios, float(np.quantile(held, LOST, method="lower")) if held else float("-inf")


def draw(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED, weight: str = "log_weight", key: str = "gumbel_key") -> DataFrame:
    """The k documents with the largest keys, of those that aren't toxic; columns weight and key are added (docs must not have them)."""
    ratios, least = fitted(docs, labels)
    model, most = toxic_model(docs, labels)
    known = written(keyed(docs.select("doc_id", "text"), ratios, seed, model=model, most=most).select("log_weight", "gumbel_key"), "quality-keys")
    if k is None:
        k = known.where(F.col("log_weight") >= F.lit(least)).count()
    cut = top_k_cut(known, k)
    return keyed(docs, ratios, seed, weight, key, model, most).where(F.col(key) >= F.lit(cut))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> DataFrame:
    """The documents that the resampling draws: all columns of docs, then log_weight and gumbel_key.

    Toxic documents (over the cut of toxic_model) are no longer there when k are drawn.
    k: how many; by default as many as have a weight that all but LOST of the held-out good documents reach. Rows with equal keys at
    the k-th place are all kept. A null or empty text has weight 0 and no n-grams; a null id takes part and draws by its text; rows
    that repeat id and text share their draw; without labelled good rows the target is the raw model and all are kept; an empty
    table gives none. A text of any length is one row of Arrow and a few arrays of its own size. Where docs have a column log_weight
    or gumbel_key, it stays and the new one gets an underscore more.
    """
    weight, key = fresh(docs.columns, "log_weight", "gumbel_key")
    return draw(docs, labels, k, seed, weight, key)


def keep(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows that resample keeps, with the columns of docs and no others, whatever their names."""
    return resample(docs, labels, k, seed).select(*docs.columns)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    kept = resample(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return kept.select("doc_id", "log_weight", "gumbel_key")
