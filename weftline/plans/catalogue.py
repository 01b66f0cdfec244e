"""Queries by name over the star-schema and document tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import errors, indexes, match, report, tfidf, topics
from ..sources import ingest
from ..sources.shared import new_path, spread, written
from ..sources.store import Store
from . import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: All documents are sources and all are targets, so each also meets itself, as the reference semantics have it.
SOURCE_SQL = TARGET_SQL = "SELECT doc_id AS id, tokens FROM tok"
LSH = indexes.LshConfig()
TERMS = ["ing", "tion", "nosuchterm"]
PREFIXES = ["the", "ing", "zzz"]


def query(statement: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if statement is not None:
            ORACLE_SQL[f.__name__] = statement
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    """id, url, text, tokens, lang, source."""
    t = spread(table(spark, d, "documents"), always=True)
    url = F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string"))
    return t.select(F.col("doc_id").alias("id"), url.alias("url"), F.coalesce("text", F.lit("")).alias("text"), text.tokens(F.col("text")).alias("tokens"), "lang", "source")


def tokenised(spark: SparkSession, d: str) -> DataFrame:
    """documents as a written table, for plans that need tokens more than once: each text is tokenised once."""
    return written(documents(spark, d), "documents")


def best(docs: DataFrame, config: match.MatchConfig = match.MatchConfig()) -> DataFrame:
    own = docs.select("id", "tokens")
    return match.top_matches(own, own, config)


SIM = f"WITH {sql.tokens()}, {sql.vectors(SOURCE_SQL, TARGET_SQL)}, {sql.BEST} "
TOK = f"WITH {sql.tokens()} "
TF = TOK + ", tf AS (SELECT doc_id, term, count(*) AS n, any_value(len(tokens)) AS n_tokens FROM (SELECT doc_id, tokens, unnest(tokens) AS term FROM tok) GROUP BY doc_id, term) "
TOPICS = f"WITH {sql.tokens()}, {sql.topics()} "

# ---- similarity


@query(SIM + "SELECT src, tgt, round(sim, 6) AS sim, rank FROM best")
def similarity_top5(spark, d):
    return best(tokenised(spark, d)).select("src", "tgt", F.round("sim", 6).alias("sim"), "rank")


@query(SIM.replace("t_doc AS (" + TARGET_SQL + ")", "t_doc AS (SELECT item_id AS id, tokens FROM btok)").replace("s_doc AS (" + SOURCE_SQL + ")", "s_doc AS (SELECT doc_id AS id, tokens FROM tok)").replace("WITH ", f"WITH {sql.tokens('benchmark', 'item_id', 'btok')}, ", 1) + "SELECT src, tgt, round(sim, 6) AS sim, rank FROM best")
def similarity_benchmark_top5(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), text.tokens(F.col("text")).alias("tokens"))
    return match.top_matches(documents(spark, d).select("id", "tokens"), written(b, "benchmark")).select("src", "tgt", F.round("sim", 6).alias("sim"), "rank")


@query(SIM + "SELECT src, tgt, round(sim, 6) AS sim, rank FROM best WHERE NOT (rank = 5 AND sim >= 0.3 AND sim < 0.9)")
def early_termination_top(spark, d):
    return best(tokenised(spark, d), match.MatchConfig(early_stop=0.3)).select("src", "tgt", F.round("sim", 6).alias("sim"), "rank")


@query(SIM + "SELECT round(min(sim), 6) AS min_sim, round(max(sim), 6) AS max_sim, round(avg(sim), 6) AS avg_sim, count(*) AS n FROM best")
def score_distribution(spark, d):
    return match.distribution(best(tokenised(spark, d))).select(*[F.round(c, 6).alias(c) for c in ("min_sim", "max_sim", "avg_sim")], "n")


_DENSE = """WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
p AS (SELECT s.id AS src, t.id AS tgt, greatest(-1, least(1, list_cosine_similarity(s.v, t.v))) AS sim FROM v s, v t WHERE s.id % 100 = 0),
best AS (SELECT src, tgt, sim, row_number() OVER (PARTITION BY src ORDER BY round(sim, 9) DESC, tgt) AS rank FROM p WHERE sim >= 0.01 QUALIFY rank <= 5) """


def _dense(spark, d) -> tuple[DataFrame, DataFrame]:
    """A search: the vectors whose ids are divisible by 100 are the queries, against all vectors."""
    v = spread(table(spark, d, "embeddings")).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return v, match.dense_best(v.where("id % 100 = 0"), v)


@query(_DENSE + "SELECT src, tgt, round(sim, 6) AS sim, rank FROM best")
def dense_cosine_top5(spark, d):
    return _dense(spark, d)[1].select("src", "tgt", F.round("sim", 6).alias("sim"), "rank")


@query(_DENSE + "SELECT src AS a, tgt AS b, round(sim, 6) AS sim, round(sim, 6) AS fast FROM best")
def dense_cosine_pairs(spark, d):
    v, found = _dense(spark, d)
    pairs = found.select("src", "tgt").join(v.select(F.col("id").alias("src"), F.col("vec").alias("v")), "src").join(v.select(F.col("id").alias("tgt"), F.col("vec").alias("w")), "tgt")
    fast = tfidf.unit_dot(tfidf.unit(F.col("v")), tfidf.unit(F.col("w")))
    return pairs.select(F.col("src").alias("a"), F.col("tgt").alias("b"), F.round(tfidf.cosine(F.col("v"), F.col("w"), checked=True), 6).alias("sim"), F.round(fast, 6).alias("fast"))


# ---- terms


@query(TOK + "SELECT doc_id AS id, CAST(len(tokens) AS BIGINT) AS n_tokens, CAST(len(list_distinct(tokens)) AS BIGINT) AS n_terms FROM tok")
def token_stats(spark, d):
    return documents(spark, d).select("id", F.size("tokens").cast("long").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_terms"))


@query(TF + "SELECT doc_id AS id, term, n, round(1 + ln(n::DOUBLE), 6) AS tf FROM tf")
def term_frequency_log(spark, d):
    return tfidf.term_counts(documents(spark, d)).select("id", "term", "n", F.round(tfidf.tf(), 6).alias("tf"))


@query(TF + "SELECT doc_id AS id, term, n, round(n::DOUBLE / n_tokens, 6) AS tf FROM tf WHERE n >= 2")
def term_frequency_relative(spark, d):
    c = tfidf.TfidfConfig(log_tf=False, min_count=2)
    return tfidf.term_counts(documents(spark, d), c).select("id", "term", "n", F.round(tfidf.tf(c), 6).alias("tf"))


@query(TF + "SELECT term, count(*) AS df FROM tf GROUP BY term")
def document_frequency(spark, d):
    return tfidf.document_frequency(tfidf.term_counts(documents(spark, d)))


def _idf(spark, d, config):
    n_docs = table(spark, d, "documents").agg(F.count("*").alias("n"))
    return tfidf.idf(tfidf.document_frequency(tfidf.term_counts(documents(spark, d))), n_docs, config).select("term", "df", F.round("idf", 6).alias("idf"))


_DF = TF + ", df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*)::DOUBLE AS n FROM documents) "


@query(_DF + "SELECT term, df, round(ln((n + 1) / (df + 1)) + 1, 6) AS idf FROM df, n")
def idf_smoothed(spark, d):
    return _idf(spark, d, tfidf.TfidfConfig())


@query(_DF + "SELECT term, df, round(ln(n / greatest(df, 1)), 6) AS idf FROM df, n")
def idf_standard(spark, d):
    return _idf(spark, d, tfidf.TfidfConfig(smooth_idf=False))


@query(TF + "SELECT term, row_number() OVER (ORDER BY term) - 1 AS index FROM (SELECT DISTINCT term FROM tf)")
def vocabulary(spark, d):
    return tfidf.vocabulary(tfidf.term_counts(documents(spark, d)))


@query(SIM + "SELECT t_w.id, count(*) AS n_terms, round(any_value(n), 6) AS norm, round(sqrt(sum((w / n) * (w / n))), 6) AS unit FROM t_w JOIN t_n ON t_w.id = t_n.id GROUP BY t_w.id")
def tfidf_vector_norm(spark, d):
    c = written(tfidf.term_counts(documents(spark, d)), "counts")
    w = tfidf.weights(c, tfidf.idf(tfidf.document_frequency(c), table(spark, d, "documents").agg(F.count("*").alias("n"))))
    return tfidf.unit_lengths(w).select("id", "n_terms", F.round("norm", 6).alias("norm"), F.round("unit", 6).alias("unit"))


# ---- text


@query(f"SELECT doc_id AS id, {sql.language('text')} AS language FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def language_detect(spark, d):
    return documents(spark, d).select("id", text.detect_language(F.col("text")).alias("language"))


@query("SELECT doc_id AS id, CASE WHEN lang IN ('en', 'fr', 'de', 'es', 'it', 'pt', 'ja') THEN lang ELSE 'en' END AS language FROM documents")
def language_codes(spark, d):
    return documents(spark, d).select("id", text.language_code(F.col("lang")).alias("language"))


@query(f"WITH {sql.tokens('(SELECT conv_id * 100000 + turn AS id, text FROM conversations)', 'id')} SELECT id, array_to_string(tokens, ' ') AS kept FROM tok")
def stopword_filter(spark, d):
    t = table(spark, d, "conversations")
    return t.select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), F.array_join(text.tokens(F.col("text")), " ").alias("kept"))


@query(TOPICS + "SELECT doc_id AS id, rank, term, n FROM top")
def doc_topics(spark, d):
    return topics.top_topics(documents(spark, d))


@query(TOPICS + "SELECT DISTINCT term AS topic FROM top")
def distinct_topics(spark, d):
    return topics.distinct_topics(topics.topic_lists(documents(spark, d)))


@query(f"SELECT doc_id AS id, {sql.anchor('text')} AS anchor FROM (SELECT doc_id, trim(coalesce(text, '')) AS text FROM documents)")
def suggested_anchor(spark, d):
    return documents(spark, d).select("id", text.suggested_anchor(text.document_text(F.lit(""), F.col("text"))).alias("anchor"))


@query(TOK + "SELECT doc_id AS id, CASE WHEN len(tokens) = 0 THEN 'empty' WHEN len(tokens) < 3 THEN 'under 3 words' ELSE '' END AS issues, len(tokens) >= 3 AS valid FROM tok")
def validate_documents(spark, d):
    return documents(spark, d).select("id", text.document_issues(F.col("tokens")).alias("i")).select("id", F.array_join("i", ",").alias("issues"), (F.size("i") == 0).alias("valid"))


@query(TOK + ", h AS (SELECT sha256(array_to_string(list_sort(tokens), '|')) AS h FROM tok), p AS (SELECT substr(h, 1, 2) AS p, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY substr(h, 1, 2)) SELECT sha256(string_agg(h, '' ORDER BY p)) AS corpus_hash, (SELECT count(*) FROM h) AS n_docs FROM p")
def corpus_hash(spark, d):
    return hashing.corpus_hash(documents(spark, d))


@query(TOK + "SELECT sha256(array_to_string(list(t ORDER BY t), '||')) AS corpus_hash, count(*) AS n_docs FROM (SELECT array_to_string(list_sort(tokens), '|') AS t FROM tok)")
def corpus_hash_exact(spark, d):
    return hashing.exact_corpus_hash(documents(spark, d)).select(F.col("hash").alias("corpus_hash"), F.col("n").alias("n_docs"))


@query("SELECT count(*) || '|' || arg_min(len(tokens), doc_id) AS fingerprint FROM (" + f"WITH {sql.tokens()} SELECT * FROM tok)")
def weak_fingerprint(spark, d):
    return hashing.weak_fingerprint(documents(spark, d))


@query("SELECT source, sha256(array_to_string(list(url ORDER BY url), '|')) AS list_hash FROM (SELECT source, 'https://' || source || '.example/' || doc_id AS url FROM documents) GROUP BY source")
def list_hash(spark, d):
    urls = table(spark, d, "documents").select("source", F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string")).alias("url"))
    return hashing.exact_list_hashes(urls, "source", "url").select(F.col("of").alias("source"), F.col("hash").alias("list_hash"))


@query(TOK + f""", h AS (SELECT doc_id, len(tokens) AS n, list_reduce(list_transform(string_split(array_to_string(tokens, '|') || ':', ''), lambda c: ord(c)::BIGINT), lambda a, c: ((a * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, 0::BIGINT) AS h FROM tok)
SELECT doc_id AS id, abs(h) AS hash, n AS n_tokens FROM h""")
def vector_cache_key(spark, d):
    key = hashing.cache_key(F.col("tokens"), F.array().cast("array<string>"))
    parts = documents(spark, d).select("id", F.split(key, ":").alias("k"))
    return parts.select("id", F.conv(F.col("k")[1], 36, 10).cast("long").alias("hash"), F.col("k")[2].cast("long").alias("n_tokens"))


# ---- ingestion


@query(r"""SELECT page_id, CASE WHEN url = '' THEN 'url_empty' WHEN NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'url_invalid'
WHEN NOT regexp_matches(lower(url), '^https?:') THEN 'url_scheme' ELSE 'ok' END AS issue FROM (SELECT page_id, trim(coalesce(url, '')) AS url FROM pages)""")
def url_validation(spark, d):
    p = table(spark, d, "pages").select("page_id", F.trim(F.coalesce("url", F.lit(""))).alias("url"))
    return p.select("page_id", F.coalesce(ingest.url_issue(F.col("url")), F.lit("ok")).alias("issue"))


@query("SELECT min(page_id) AS page_id, trim(url) AS url FROM pages GROUP BY trim(url)")
def dedupe_first_wins(spark, d):
    rows = table(spark, d, "pages").select(F.col("page_id").alias("line_no"), "url", F.lit("some words of text here").alias("body"), F.lit(True).alias("arity_ok"))
    return ingest.validate(rows).where("accepted").select(F.col("line_no").alias("page_id"), "url")


@query(f"WITH {sql.tokens('(SELECT page_id, trim(coalesce(html, ' + chr(39) * 2 + ')) AS text, trim(url) AS url FROM pages)', 'page_id', 'tok', 'url')}" + """, f AS (SELECT url, min(page_id) AS first FROM tok GROUP BY url),
v AS (SELECT page_id, CASE WHEN page_id > first THEN 'url_repeated' WHEN text = '' THEN 'body_empty' WHEN length(text) > 50000 THEN 'body_long' END AS refused, length(text) < 10 AS short, len(tokens) < 3 AS few FROM tok JOIN f USING (url))
SELECT page_id, coalesce(refused, concat_ws(',', CASE WHEN short THEN 'body_short' END, CASE WHEN few THEN 'few_words' END)) AS issues, refused IS NULL AS accepted FROM v""")
def validate_rows(spark, d):
    rows = table(spark, d, "pages").select(F.col("page_id").alias("line_no"), "url", F.col("html").alias("body"), F.lit(True).alias("arity_ok"))
    return ingest.validate(rows).select(F.col("line_no").alias("page_id"), F.array_join("issues", ",").alias("issues"), "accepted")


# ---- stores: each query fills a store of its own in the shared folder


def _store(spark) -> Store:
    return Store(spark, new_path(spark, "store"))


def _uploads(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    url = F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string"))
    return docs.select(url.alias("url"), F.col("lang").alias("title"), F.col("text").alias("body"), F.array("lang", "source").alias("tokens"), F.col("lang").alias("language"), F.array().cast("array<string>").alias("issues"), "doc_id")


def _edges(spark, d) -> DataFrame:
    """Known matches between documents: conversations stand for sources, their turns for targets, so some urls aren't stored."""
    u = table(spark, d, "documents").select("doc_id", F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string")).alias("url"))
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("a"), (F.col("conv_id") * 7 + F.col("turn")).alias("b"), (F.lit(1.0) / (F.col("turn") + 1)).alias("score"))
    s = u.select(F.col("doc_id").alias("a"), F.col("url").alias("source_url"))
    t = u.select(F.col("doc_id").alias("b"), F.col("url").alias("known"))
    target = F.coalesce("known", F.concat(F.lit("https://unknown.example/"), F.col("b").cast("string")))
    return c.join(s, "a").join(t, "b", "left").select("source_url", target.alias("target_url"), "score", F.concat(F.lit("to "), F.col("b").cast("string")).alias("anchor"))


_URL = "'https://' || source || '.example/' || doc_id"
_EDGE = f"""WITH u AS (SELECT doc_id, {_URL} AS url, lang, source FROM documents),
e AS (SELECT s.url AS source_url, t.url AS target_url, max(1.0::DOUBLE / (turn + 1)) AS score, any_value('to ' || t.doc_id) AS anchor FROM conversations JOIN u s ON s.doc_id = conv_id JOIN u t ON t.doc_id = conv_id * 7 + turn GROUP BY ALL) """


def _filled(spark, d) -> Store:
    store = _store(spark)
    store.put_documents(_uploads(spark, d))
    store.put_edges(_edges(spark, d), "list")
    return store


@query(f"SELECT {_URL} AS url, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'again' ELSE coalesce(lang, '') END AS title, 2 AS token_count, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS updated FROM documents")
def store_upsert(spark, d):
    """OP-08, 70, 75: inserts, then updates those with a label; created_at stays and updated_at moves on."""
    store, docs = _store(spark), _uploads(spark, d)
    store.put_documents(docs)
    again = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    store.put_documents(docs.join(again, "doc_id", "left_semi").withColumn("title", F.lit("again")))
    return store.read("urls").select("url", "title", "preprocessed.token_count", (F.col("updated_at") > F.col("created_at")).alias("updated"))


@query(f"SELECT {_URL} AS url, coalesce(lang, '') AS title FROM documents WHERE doc_id = 42")
def store_lookup(spark, d):
    """OP-06, 15: one document by its url: one part of the table is read."""
    store = _store(spark)
    store.put_documents(_uploads(spark, d))
    url = table(spark, d, "documents").where("doc_id = 42").select(F.concat(F.lit("https://"), "source", F.lit(".example/42"))).first()
    return store.document(url[0] if url else "").select("url", "title")


@query(_EDGE + "SELECT source_url, target_url, round(score, 6) AS score, anchor, coalesce(s.lang, '') AS source_title, coalesce(t.lang, '') AS target_title, [t.lang, t.source] AS target_tokens FROM e JOIN u s ON s.url = source_url JOIN u t ON t.url = target_url".replace("[t.lang, t.source]", "t.lang || ',' || t.source"))
def store_edges(spark, d):
    """OP-09, 21, 22, 23: edges whose urls are both stored, with both documents."""
    store = _filled(spark, d)
    e = store.edges_with_documents(store.read("urls").select("url"))
    return e.select("source_url", "target_url", F.round("score", 6).alias("score"), "anchor", "source_title", "target_title", F.array_join("target_tokens", ",").alias("target_tokens"))


@query(_EDGE + "SELECT source_url, target_url, round(score, 6) AS score, row_number() OVER (PARTITION BY source_url ORDER BY score DESC, target_url) AS rank FROM e QUALIFY rank <= 5")
def cached_top5(spark, d):
    """OP-25, 50: the best stored edges of each source."""
    store = _filled(spark, d)
    return store.cached_best(store.read("urls").select("url")).select("source_url", "target_url", F.round("score", 6).alias("score"), "rank")


@query(_EDGE + "SELECT target_url, round(score, 6) AS score FROM e WHERE source_url = (SELECT min(source_url) FROM e) ORDER BY score DESC, target_url LIMIT 5")
def store_best_of(spark, d):
    """OP-52: the best edges of one source."""
    store = _filled(spark, d)
    source = store.read("edges").agg(F.min("source_url")).first()[0]
    return store.best_of(source or "").select("target_url", F.round("score", 6).alias("score"))


@query(_EDGE + ", gone AS (SELECT url FROM u WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)) SELECT source_url, target_url FROM e WHERE source_url NOT IN (SELECT url FROM gone) AND target_url NOT IN (SELECT url FROM gone)")
def store_cascade(spark, d):
    """OP-76: edges that are left when documents are deleted."""
    store = _filled(spark, d)
    bad = table(spark, d, "labels").where("quality = 0").select("doc_id")
    store.delete_documents(_uploads(spark, d).join(bad, "doc_id", "left_semi").select("url"))
    return store.read("edges").select("source_url", "target_url")


def _processed(spark, d) -> tuple[Store, DataFrame]:
    store, docs = _store(spark), _uploads(spark, d).select("url", "doc_id")
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    store.mark_processed(docs.join(good, "doc_id", "left_semi").select("url"), "list")
    return store, docs.select("url", F.col("doc_id").alias("id"))


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def processed_anti_join(spark, d):
    """OP-24, 72: sources still to be compared."""
    store, docs = _processed(spark, d)
    return store.split_processed(docs, "list")[1].select("id")


@query("SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def processed_semi_join(spark, d):
    """OP-14, 24: sources that are done."""
    store, docs = _processed(spark, d)
    return store.split_processed(docs, "list")[0].select("id")


@query("SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def store_clear_status(spark, d):
    """OP-73, 74: what is still marked after the status of some is cleared."""
    store, docs = _processed(spark, d)
    toxic = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    store.clear_status(docs.join(toxic, "id", "left_semi").select("url"), "list")
    return store.split_processed(docs, "list")[0].select("id")


@query("SELECT 1::BIGINT AS n_lists, (SELECT count(*) FROM documents) AS n_urls, true AS same")
def store_target_list(spark, d):
    """OP-07, 71: a list of targets is stored once, whatever its order."""
    store, urls = _store(spark), _uploads(spark, d).select("url")
    one, two = store.get_or_create_list(urls), store.get_or_create_list(urls.orderBy(F.col("url").desc()))
    lists = store.read("lists").agg(F.count_distinct("list_id").alias("n_lists"))
    return lists.join(store.target_list(one).agg(F.count("*").alias("n_urls")), how="cross").withColumn("same", F.lit(one == two))


# ---- results


def results(spark, d) -> DataFrame:
    docs = tokenised(spark, d)
    lists = topics.topic_lists(docs.select("id", "tokens"))
    t = docs.join(lists, "id").select("id", "url", F.lit("").alias("title"), "topics", text.suggested_anchor(text.document_text(F.lit(""), F.col("text"))).alias("anchor"))
    t = written(t, "result-documents")
    return written(match.nested(t.drop("anchor"), best(docs), t), "results")


RESULTS = (
    f"WITH {sql.tokens()}, {sql.vectors(SOURCE_SQL, TARGET_SQL)}, {sql.BEST}, {sql.topics()}, u AS MATERIALIZED (SELECT d.doc_id AS id, 'https://' || source || '.example/' || d.doc_id AS url, coalesce(topics, []) AS topics, trim(coalesce(text, '')) AS text FROM documents d LEFT JOIN top_list USING (doc_id)), "
    f"a AS MATERIALIZED (SELECT id, url, topics, {sql.anchor('text')} AS anchor FROM u), r AS MATERIALIZED (SELECT s.id, s.url, s.topics, rank, t.url AS m_url, sim, t.anchor, t.topics AS m_topics FROM u s LEFT JOIN best ON src = s.id LEFT JOIN a t ON tgt = t.id ) "
)


@query(RESULTS + "SELECT topic, count(*) AS n FROM (SELECT DISTINCT id, url, unnest(topics) AS topic FROM u UNION ALL SELECT id * 10 + rank, m_url, unnest(m_topics) FROM r) GROUP BY topic")
def topic_groups(spark, d):
    return report.topic_counts(results(spark, d))


@query(RESULTS + "SELECT DISTINCT url, array_to_string(topics, ',') AS topics, CAST(count(m_url) OVER (PARTITION BY id) AS BIGINT) AS n_matches FROM r")
def url_groups(spark, d):
    return report.group_by_url(results(spark, d)).select("url", F.array_join("topics", ",").alias("topics"), F.size("matches").cast("long").alias("n_matches"))


@query(RESULTS + "SELECT DISTINCT id FROM r WHERE contains(lower(url), 'src1.') OR contains(lower(m_url), 'src1.') OR contains(lower(anchor), 'src1.') OR len(list_filter(m_topics, lambda t: contains(lower(t), 'src1.'))) > 0 OR len(list_filter(topics, lambda t: contains(lower(t), 'src1.'))) > 0")
def search_results(spark, d):
    return report.search(results(spark, d), "SRC1.").select("id")


@query("SELECT doc_id AS id, 'https://' || source || '.example/' || doc_id AS url FROM documents ORDER BY doc_id OFFSET 20 LIMIT 10")
def paginate_results(spark, d):
    return report.page(documents(spark, d), 3).select("id", "url")


@query("SELECT CAST(ceil(count(*) / 10.0) AS BIGINT) AS n_pages FROM documents")
def page_count(spark, d):
    return report.n_pages(documents(spark, d))


@query(RESULTS + "SELECT url AS source_url, coalesce(m_url, '') AS match_url, coalesce(format('{:.2f}', sim * 100), '') AS similarity, coalesce(array_to_string(m_topics, '; '), '') AS match_topics, coalesce(array_to_string(topics, '; '), '') AS source_topics FROM r")
def export_rows(spark, d):
    return report.export_rows(results(spark, d))


# ---- candidates


@query(TOK + f", p AS (SELECT DISTINCT doc_id AS id, unnest(tokens) AS term FROM tok), h AS (SELECT * FROM p WHERE term IN ({', '.join(repr(t) for t in TERMS)})) SELECT id FROM h GROUP BY id HAVING count(*) = (SELECT count(DISTINCT term) FROM h)")
def inverted_search(spark, d):
    return indexes.search_all(indexes.postings(documents(spark, d)), TERMS)


@query(rf"WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[{sql.SPACE}]+')) AS w FROM documents), h AS (SELECT DISTINCT doc_id AS id, substr(w, 1, 3) AS term FROM w WHERE length(w) >= 3 AND substr(w, 1, 3) IN ({', '.join(repr(t) for t in PREFIXES)})) SELECT id FROM h GROUP BY id HAVING count(*) = (SELECT count(DISTINCT term) FROM h)")
def prefix_search(spark, d):
    return indexes.search_all(indexes.prefix_postings(documents(spark, d)), PREFIXES)


_SIGN = TOK + f", p AS (SELECT DISTINCT doc_id, unnest(tokens) AS term FROM tok), v AS MATERIALIZED (SELECT term, {sql.padded('term')} AS v FROM (SELECT DISTINCT term FROM p)), s AS MATERIALIZED (SELECT doc_id, {sql.signature(LSH.hashes)} AS sig FROM p JOIN v USING (term) GROUP BY doc_id) "


@query(_SIGN + "SELECT doc_id AS id, array_to_string(sig, ',') AS sig FROM s")
def minhash_signature(spark, d):
    return indexes.signatures(documents(spark, d), LSH).select("id", F.array_join(F.col("sig").cast("array<string>"), ",").alias("sig"))


@query(_SIGN + ", b AS (SELECT doc_id, i, array_to_string(sig[i * 8 + 1 : i * 8 + 8], ',') AS bucket FROM s, range(16) t(i)) SELECT DISTINCT q.doc_id AS query, d.doc_id AS id FROM b q JOIN b d USING (i, bucket) WHERE q.doc_id % 100 = 0")
def lsh_candidates(spark, d):
    """A search: the documents whose ids are divisible by 100 are the queries, against all documents."""
    signed = written(indexes.signatures(documents(spark, d), LSH), "signatures")
    return indexes.candidates(signed.where("id % 100 = 0"), signed, LSH)


@query(TOK + "SELECT count(*) AS n_docs, 128::BIGINT AS n_hashes, 16::BIGINT AS n_bands, round(avg(len(list_distinct(tokens))), 6) AS avg_terms FROM tok")
def lsh_index_stats(spark, d):
    return indexes.index_stats(documents(spark, d), LSH).withColumn("avg_terms", F.round("avg_terms", 6))


# the filter holds the urls of documents and has the size that their number asks for; urls of documents and of pages are looked up
_POS = "[" + ", ".join(f"{sql.polynomial('value', i + 1, 2**32)} % (SELECT bits FROM cfg)" for i in range(7)) + "]"
_BLOOM = f"""WITH cfg AS (SELECT CAST(ceil(-(greatest(count(*), 1) * ln(0.01::DOUBLE)) / (ln(2::DOUBLE) * ln(2::DOUBLE))) AS BIGINT) AS bits FROM documents),
v AS (SELECT {_URL} AS value, true AS stored FROM documents UNION SELECT url, false FROM pages WHERE url IS NOT NULL), p AS MATERIALIZED (SELECT value, stored, {_POS} AS pos FROM v), bits AS MATERIALIZED (SELECT DISTINCT unnest(pos) AS pos FROM p WHERE stored) """


def _bloom(spark, d) -> tuple[DataFrame, DataFrame, indexes.BloomConfig]:
    stored = table(spark, d, "documents").select(F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string")).alias("value"))
    config = indexes.fitting(stored)
    return stored, written(indexes.bloom_bits(spread(stored), config), "bloom"), config


@query(_BLOOM + "SELECT value, bool_and(b.pos IS NOT NULL) AS maybe FROM (SELECT value, unnest(pos) AS pos FROM p) q LEFT JOIN bits b ON b.pos = q.pos GROUP BY value")
def bloom_probe(spark, d):
    stored, bits, config = _bloom(spark, d)
    asked = stored.union(table(spark, d, "pages").where("url is not null").select("url"))
    return indexes.bloom_probe(spread(asked), bits, config)


@query(_BLOOM + "SELECT round(pow(count(*) / (SELECT bits FROM cfg)::DOUBLE, 7), 6) AS rate FROM bits")
def bloom_fpr(spark, d):
    _, bits, config = _bloom(spark, d)
    return indexes.bloom_rate(bits, config).select(F.round("rate", 6).alias("rate"))


# ---- topic model

_MODEL = TOK + """, w AS MATERIALIZED (SELECT doc_id, unnest(tokens) AS word FROM tok), f AS (SELECT word, count(*)::DOUBLE AS f FROM w GROUP BY word),
u AS MATERIALIZED (SELECT doc_id, word, f FROM (SELECT DISTINCT * FROM w) JOIN f USING (word)), n AS (SELECT doc_id, 1 + ln(count(*)::DOUBLE) AS size FROM u GROUP BY doc_id),
c AS MATERIALIZED (SELECT doc_id, f, count(*) AS n FROM u GROUP BY ALL), v AS (SELECT a.doc_id, a.f, sum(b.n * ln(1 + a.f * b.f)) - ln(1 + a.f * a.f) AS s FROM c a JOIN c b USING (doc_id) GROUP BY a.doc_id, a.f),
s AS (SELECT u.doc_id, word, u.f, s FROM u JOIN v ON u.doc_id = v.doc_id AND u.f = v.f),
t AS MATERIALIZED (SELECT doc_id, word, f FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(s, 6) DESC, word) <= 20),
x AS MATERIALIZED (SELECT a.word, sum(coalesce(CASE WHEN a.word <> b.word THEN ln(1 + a.f * b.f) / size END, 0)) AS score FROM t a JOIN t b USING (doc_id) JOIN n USING (doc_id) GROUP BY a.word)"""


@query(_MODEL + "SELECT word, round(score, 6) AS score FROM x")
def topic_model_word_scores(spark, d):
    return topics.train(tokenised(spark, d)).select("word", F.round("score", 6).alias("score"))


_DOC_TOPICS = _MODEL + ", g AS (SELECT word, unnest(['topic_0', 'topic_1']) AS topic, score FROM x WHERE score >= 0.2), dt AS MATERIALIZED (SELECT doc_id, topic, sum(score) AS score FROM (SELECT doc_id, unnest(tokens) AS word FROM tok) JOIN g USING (word) GROUP BY ALL HAVING sum(score) > 0.2) "


@query(_DOC_TOPICS + "SELECT doc_id AS id, topic, round(score, 4) AS score FROM dt")
def topic_model_documents(spark, d):
    docs = tokenised(spark, d)
    return topics.document_topics(docs, topics.assign(topics.train(docs))).select("id", "topic", F.round("score", 4).alias("score"))


@query(_DOC_TOPICS + f", l AS (SELECT doc_id, count(*) AS n FROM dt GROUP BY doc_id), {sql.vectors(SOURCE_SQL, TARGET_SQL)}, {sql.BEST} SELECT src AS a, tgt AS b, least(coalesce(x.n, 0), coalesce(y.n, 0)) >= 1 AS related, least(coalesce(x.n, 0), coalesce(y.n, 0)) AS overlap FROM best LEFT JOIN l x ON x.doc_id = src LEFT JOIN l y ON y.doc_id = tgt")
def related_documents(spark, d):
    """OP-60, 86: of the pairs that the similarity search finds."""
    docs = tokenised(spark, d)
    pairs = best(docs).select(F.col("src").alias("a"), F.col("tgt").alias("b"))
    return topics.related(pairs, topics.document_topics(docs, topics.assign(topics.train(docs))))


# ---- errors

_MESSAGES = ["Network unreachable", "parsing failed", "SecurityError raised", "authentication refused", "bad format", "request timeout"]
_COMPONENTS, _SEVERITIES = ["worker", "store", "csv", "tfidf"], ["low", "medium", "high", "critical"]


def reports(spark, d) -> DataFrame:
    pick = lambda xs, c: F.element_at(F.array(*[F.lit(x) for x in xs]), (c % len(xs) + 1).cast("int"))
    e = table(spark, d, "events").where("event_type = 'error'")
    e = e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), pick(_MESSAGES, F.col("event_id")).alias("message"), pick(_COMPONENTS, F.col("user_id")).alias("component"), F.lit("run").alias("operation"), pick(_SEVERITIES, F.col("event_id") + F.col("user_id")).alias("severity"))
    return e.withColumn("recoverable", errors.recoverable(F.col("message"), F.col("component")))


_ERR = f"""WITH e AS (SELECT event_id AS id, ts, {_MESSAGES}[event_id % 6 + 1] AS message, {_COMPONENTS}[user_id % 4 + 1] AS component, {_SEVERITIES}[(event_id + user_id) % 4 + 1] AS severity FROM events WHERE event_type = 'error'),
r AS (SELECT *, CASE WHEN regexp_matches(lower(message), 'fetch|invalid input|network|out of memory|rate limit|timeout|vector dimensions mismatch|worker terminated') THEN true WHEN component = 'worker' THEN NOT contains(message, 'SecurityError')
WHEN component = 'store' THEN NOT contains(message, 'authentication') WHEN component = 'csv' THEN contains(message, 'parsing') OR contains(message, 'format') ELSE false END AS recoverable FROM e),
l AS (SELECT * FROM r ORDER BY ts DESC, id DESC LIMIT 100) """


@query(_ERR + "SELECT count(*) AS total_errors, count_if(epoch_us((SELECT max(ts) FROM r)) - epoch_us(ts) < 300000000)::BIGINT AS recent_errors, round(coalesce(count_if(recoverable) * 100.0::DOUBLE / count(*), 0), 6) AS recoverable_percent FROM l")
def error_stats(spark, d):
    r = reports(spark, d)
    now = r.agg(F.max("ts").alias("now"))
    out = errors.statistics(r.join(F.broadcast(now), how="cross").select(*r.columns, "now"), F.col("now"))
    return out.select("total_errors", "recent_errors", F.round(F.col("recoverable_percent").cast("double"), 6).alias("recoverable_percent"))


@query(_ERR + "SELECT component, count(*) AS n FROM l GROUP BY component")
def errors_by_component(spark, d):
    return errors.by(reports(spark, d), "component")


@query(_ERR + "SELECT severity, count(*) AS n FROM l GROUP BY severity")
def errors_by_severity(spark, d):
    return errors.by(reports(spark, d), "severity")


_RECOVER = f"""{_ERR}, n AS (SELECT *, CASE WHEN recoverable THEN row_number() OVER (PARTITION BY component, recoverable ORDER BY ts, id) END AS attempt FROM r)
SELECT id, component, recoverable, CASE WHEN NOT recoverable THEN 'none' WHEN attempt > 3 THEN 'give up'
WHEN component = 'worker' THEN CASE WHEN contains(message, 'Worker terminated') OR contains(message, 'NetworkError') THEN 'restart' WHEN contains(message, 'Out of memory') THEN 'free memory' ELSE 'fail' END
WHEN component = 'store' THEN CASE WHEN contains(message, 'fetch') OR contains(message, 'network') OR contains(message, 'timeout') THEN 'retry' WHEN contains(message, 'rate limit') OR contains(message, '429') THEN 'wait' ELSE 'fail' END
WHEN component = 'tfidf' THEN CASE WHEN contains(message, 'Invalid input') OR contains(message, 'empty') THEN 'skip' WHEN contains(message, 'Vector dimensions mismatch') THEN 'clear caches' ELSE 'fail' END
WHEN component = 'csv' THEN CASE WHEN contains(message, 'parsing') OR contains(message, 'format') THEN 'explain' ELSE 'fail' END
ELSE 'fail' END AS action FROM n"""


@query(_RECOVER)
def error_recovery(spark, d):
    return errors.recovery(reports(spark, d)).select("id", "component", "recoverable", "action")
