"""Exact BM25 top-k search: an inverted index by shards.

A shard indexes the documents of one task. Statistics that scores depend on (documents, mean length,
document frequencies) are summed over all shards first, so shard scores are global ones and the
merge of the shards' top k is exact. In a shard the postings of rare terms are added up, and the
frequent terms are a matrix of single precision, multiplied by the weights of many queries at once;
the documents that can be among the k best by these scores, rounding considered, are scored exactly.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LAST_ID, new_path, open_input, open_output, written

K, K1, B = 10, 1.2, 0.75
#: Documents and words of a shard, at most (up to the words of 100 documents that are read together).
SHARD_DOCS, SHARD_WORDS = 8192, 6_000_000
#: A term in more than this share of a shard's documents is frequent.
FREQUENT = 0.05
#: Documents that a frequent term has at least.
LEAST_DF = 32
#: Documents whose frequent terms are multiplied together.
GROUP_DOCS = 512
#: Cells of the matrix of frequent terms and documents of a shard, at most: the most frequent terms have rows, others are postings.
CELLS = 1 << 24
#: Scores are compared with so much room, for rounding to 6 decimals.
MARGIN = 1e-5
#: Queries that are read at a time (in the mean), and scored at a time; memory doesn't depend on how many there are.
QUERY_BLOCK, TOGETHER = 1024, 128
#: Postings that are added up at a time, or those of a single term or document.
POSTINGS = 1 << 17
#: Words: digits, letters a-z and all that isn't ASCII; A-Z in lower case. One byte for one byte.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of an array of texts: term (64-bit hash), row and count of each pair in order, and the words of each row."""
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "")
    texts = pa.concat_arrays([texts])  # offsets of its own
    _, offsets, data = texts.cast(pa.large_string()).buffers()
    clean = pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(bytes(data or b"").translate(TABLE))])
    lists = pc.split_pattern(clean, " ")
    words, rows = lists.values, np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    there = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    d = words.dictionary_encode()
    codes, rows = d.indices.to_numpy()[there], rows[there]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, d.dictionary.to_pylist()), np.uint64, len(d.dictionary))
    pair, count = np.unique(codes.astype(np.int64) * max(len(texts), 1) + rows, return_counts=True)
    code, row = np.divmod(pair, max(len(texts), 1))
    return hashes[code], row, count, np.bincount(rows, minlength=len(texts))


def build_index(docs: DataFrame, folder: str) -> DataFrame:
    """Index files of docs, a shard or more for each task; returns their list: uri, n_docs, n_words.

    Only files that the returned written table names count, so a lost executor costs its own shards.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n_docs = n_words = 0

        def close() -> pa.RecordBatch:
            term, row, count, length, ids = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((row, term))
            term, row, count = term[order], row[order], count[order]
            first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
            buffer = io.BytesIO()
            np.savez(buffer, terms=term[first], first=np.r_[first, len(term)].astype(np.int64), docs=row.astype(np.int32), counts=count.astype(np.int32), lengths=length.astype(np.int64), ids=ids)
            uri = f"{folder}/{uuid.uuid4().hex}.npz"
            with open_output(uri) as out:
                out.write(buffer.getvalue())
            return pa.record_batch({"uri": [uri], "n_docs": pa.array([len(ids)], pa.int64()), "n_words": pa.array([int(length.sum())], pa.int64())})

        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                b = batch.slice(i, 100)
                term, row, count, length = term_counts(b["text"])
                if n_docs and (n_docs + len(length) > SHARD_DOCS or n_words + length.sum() > SHARD_WORDS):
                    yield close()
                    held, n_docs, n_words = [], 0, 0
                held.append((term, row + n_docs, count, length, b["doc_id"].fill_null(LAST_ID).to_numpy(zero_copy_only=False)))
                n_docs, n_words = n_docs + len(length), n_words + int(length.sum())
        if n_docs:
            yield close()

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, "uri string, n_docs long, n_words long"), "bm25-shards")


def _spread(shards: DataFrame) -> DataFrame:
    return shards.repartition(max(1, shards.count()))


def query_weights(queries: DataFrame, shards: DataFrame, n_docs: int) -> DataFrame:
    """query_id, term, weight (count in the query times idf over all shards) of queries (query_id, text)."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            term, row, count, _ = term_counts(b["text"])
            yield pa.record_batch({"query_id": b["query_id"].to_numpy(zero_copy_only=False)[row], "term": term.view(np.int64), "n": count.astype(np.int64)})

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch["uri"].to_pylist():
                f = np.load(open_input(uri))
                yield pa.record_batch({"term": f["terms"].view(np.int64), "df": np.diff(f["first"])})

    # the shards' list is tiny and what is read by it isn't, which Spark can't tell: hence the hint
    asked = written(queries.mapInArrow(terms, "query_id long, term long, n long"), "bm25-queries")
    df = _spread(shards).mapInArrow(frequencies, "term long, df long").hint("merge").join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.log1p((F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return asked.join(df, "term").select("query_id", "term", (F.col("n") * idf).alias("weight"))


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ..., size numbers, of each pair in turn."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def pieces(size: np.ndarray, most: int) -> Iterator[slice]:
    """Ranges of rows whose sizes sum to most at most, or of a single larger row."""
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


class Searcher:
    """A shard in memory."""

    def __init__(self, uri: str, mean_length: float, k1: float, b: float):
        f = np.load(open_input(uri))
        self.terms, self.first, self.docs, self.ids = f["terms"], f["first"], f["docs"], f["ids"]
        count, n = f["counts"].astype(np.float64), len(self.ids)
        norm = k1 * (1 - b + b * f["lengths"] / mean_length) if mean_length else np.full(n, k1)
        self.impact = count * (k1 + 1) / (count + norm[self.docs])
        df = np.diff(self.first)
        head = np.argsort(-df, kind="stable")[: CELLS // max(n, 1)]
        head = np.sort(head[df[head] > max(LEAST_DF, FREQUENT * n)])
        self.head_of = np.full(len(self.terms), -1)
        self.head_of[head] = np.arange(len(head))
        self.head_df, self.n = df[head], n
        # documents with the same most frequent term (mostly: of one language) share a group, so that many terms are in few groups
        lead = np.full(n, -1)
        for t in head[np.argsort(df[head], kind="stable")]:
            lead[self.docs[self.first[t] : self.first[t + 1]]] = t
        place = np.empty(n, np.int64)
        place[np.argsort(lead, kind="stable")] = np.arange(n)
        self.docs, self.ids = place[self.docs], self.ids[np.argsort(place)]
        # the frequent terms twice: rounded as a matrix, and exactly as postings by document
        at = ranges(self.first[head], self.head_df)
        column = np.repeat(np.arange(len(head), dtype=np.int32), self.head_df)
        self.head = np.zeros((len(head), n), np.float32)
        self.head[column, self.docs[at]] = self.impact[at]
        at, column = at[order := np.argsort(self.docs[at], kind="stable")], column[order]
        self.own_first = np.searchsorted(self.docs[at], np.arange(n + 1))
        self.own_column, self.own_impact = column, self.impact[at]
        self.groups = [(self.head[:, i : i + GROUP_DOCS].any(axis=1), slice(i, i + GROUP_DOCS)) for i in range(0, n, GROUP_DOCS)]

    def top(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of queries given by rows (number from 0, term, weight): query, row and score (6 decimals) of the k best documents that share a term; equal scores go by id.

        Rounded scores of all documents tell which can be among the k best; only those are scored exactly.
        """
        m = int(query.max(initial=-1)) + 1
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if not m or not len(self.terms):
            return none
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[at] == term)
        query, at, weight = query[known], at[known], weight[known]
        # queries with the same most frequent term (mostly: of one language) go together, as they use the same rows of the matrix
        column = self.head_of[at]
        frequent = np.flatnonzero(column >= 0)
        frequent = frequent[np.argsort(self.head_df[column[frequent]], kind="stable")]
        lead, place = np.full(m, -1), np.empty(m, np.int64)
        lead[query[frequent]] = column[frequent]  # the last of a query stays
        place[np.argsort(lead, kind="stable")] = np.arange(m)
        query = place[query]
        order = np.argsort(query.astype(np.uint16) if m < 1 << 16 else query, kind="stable")
        query, at, weight = query[order], at[order], weight[order]
        cut = np.searchsorted(query // TOGETHER, np.arange(-(-m // TOGETHER) + 1))
        back = np.argsort(place)
        found = [self._some(min(TOGETHER, m - i * TOGETHER), query[a:z] - i * TOGETHER, at[a:z], weight[a:z], k) for i, (a, z) in enumerate(zip(cut, cut[1:]))]
        q, row, score = (np.concatenate(c) for c in zip(*((q + i * TOGETHER, row, score) for i, (q, row, score) in enumerate(found))))
        return back[q], row, score

    def _some(self, m: int, query: np.ndarray, at: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """top of m queries, given by rows in order of the query (number from 0, place in terms, weight)."""
        n, column = self.n, self.head_of[at]
        frequent = column >= 0
        w = np.zeros((m, len(self.head_df)))
        w[query[frequent], column[frequent]] = weight[frequent]
        query, at, weight = query[~frequent], at[~frequent], weight[~frequent]
        tail = np.zeros(m * n)
        size = self.first[at + 1] - self.first[at]
        for p in pieces(size, POSTINGS):
            postings, first, last = ranges(self.first[at[p]], size[p]), int(query[p.start]), int(query[p.stop - 1])
            cells = np.repeat((query[p] - first) * n, size[p]) + self.docs[postings]
            tail[first * n : (last + 1) * n] += np.bincount(cells, weights=np.repeat(weight[p], size[p]) * self.impact[postings], minlength=(last + 1 - first) * n)
        tail = tail.reshape(m, n)
        used, rounded = w.any(axis=0), tail.astype(np.float32)
        for there, docs in self.groups:
            rows = np.flatnonzero(used & there)
            rounded[:, docs] += w[:, rows].astype(np.float32) @ self.head[rows, docs]
        # sums of terms over 0: each is off by a share of itself, one rounding for each term at most and some more
        off = (np.count_nonzero(used) + 8) * 2.0**-23
        least = np.partition(rounded, n - k, axis=1)[:, n - k].astype(np.float64) * (1 - 2 * off) - MARGIN if n > k else np.zeros(m)
        q, row = np.nonzero((rounded > 0) & (rounded >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None]))
        score = tail[q, row]
        size = self.own_first[row + 1] - self.own_first[row]
        for p in pieces(size, POSTINGS):
            own = ranges(self.own_first[row[p]], size[p])
            score[p] += np.bincount(np.repeat(np.arange(len(size[p])), size[p]), weights=w[np.repeat(q[p], size[p]), self.own_column[own]] * self.own_impact[own], minlength=len(size[p]))
        score = np.round(score, 6)
        best = np.lexsort((self.ids[row], -score, q))
        q, row, score = q[best], row[best], score[best]
        keep = (np.arange(len(q)) - np.searchsorted(q, q) < k) & (score > 0)
        return q[keep], row[keep], score[keep]


def search(docs: DataFrame, queries: DataFrame, k: int = K, k1: float = K1, b: float = B) -> DataFrame:
    """The k documents of docs (doc_id, text) that score highest for each of queries (query_id, text).

    Returns query_id, rank (from 1), doc_id, score (BM25, 6 decimals; a term counts as often as the query
    has it). Equal scores rank by doc_id, nulls last. Null and empty texts match nothing; a query gets fewer than k
    rows if fewer documents share a word with it, and none if it has no words. Every row of docs takes
    part, also with repeated or null ids. Of queries that repeat an id the least text counts; a null
    query_id is left out; empty tables give no rows. Terms are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    shards = build_index(docs, new_path(spark, "bm25"))
    n_docs, n_words = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    queries = queries.where("query_id is not null").groupBy(F.col("query_id").cast("long").alias("query_id")).agg(F.min("text").alias("text"))
    weights = written(query_weights(queries, shards, n_docs), "bm25-weights")
    blocks = max(1, -(-weights.select("query_id").distinct().count() // QUERY_BLOCK))
    path = new_path(spark, "bm25-blocks")
    numbered = weights.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("query", F.dense_rank().over(Window.partitionBy("block").orderBy("query_id")) - 1)
    numbered.repartition("block").sortWithinPartitions("block", "term").write.partitionBy("block").parquet(path)
    mean = n_words / n_docs if n_docs else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSelector, FileSystem

        fs, root = FileSystem.from_uri(path)
        for batch in batches:
            for uri in batch["uri"].to_pylist():
                shard = Searcher(uri, mean, k1, b)
                for folder in fs.get_file_info(FileSelector(root)):
                    if not folder.base_name.startswith("block="):
                        continue
                    for file in fs.get_file_info(FileSelector(folder.path)):
                        if not file.base_name.endswith(".parquet"):
                            continue
                        t = pq.read_table(fs.open_input_file(file.path), columns=["query_id", "query", "term", "weight"])
                        query_id, query, term, weight = (t[c].to_numpy() for c in t.column_names)
                        name = np.zeros(int(query.max(initial=-1)) + 1, np.int64)
                        name[query] = query_id
                        q, row, score = shard.top(query.astype(np.int64), term.view(np.uint64), weight, k)
                        if len(q):
                            yield pa.record_batch({"query_id": name[q], "doc_id": shard.ids[row], "score": score})

    found = _spread(shards).mapInArrow(run, "query_id long, doc_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id"))
    ranked = found.withColumn("rank", best.cast("long")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("doc_id") < LAST_ID, F.col("doc_id")).alias("doc_id"), "score")


def op1_search(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search(docs, docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), tf AS (
  SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL
), df AS (
  SELECT term, count(*) AS df FROM tf GROUP BY term
), stat AS (
  SELECT count(*)::DOUBLE AS n_docs, avg(len(w))::DOUBLE AS mean FROM d
), scored AS (
  SELECT q.doc_id AS query_id, t.doc_id, round(sum(q.n * ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * t.n * 2.2::DOUBLE / (t.n + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(w) / mean))), 6) AS score
  FROM tf q JOIN tf t USING (term) JOIN df USING (term) JOIN d ON d.doc_id = t.doc_id, stat WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id, t.doc_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored
QUALIFY rank <= 10
"""
