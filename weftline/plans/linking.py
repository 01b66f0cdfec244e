"""The whole run: prepare targets, compare new sources with them, keep the results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import match, tfidf, topics
from ..sources.shared import written
from ..sources.store import Store


def prepare(docs: DataFrame) -> DataFrame:
    """docs (url, title, body) with id (the url), text, tokens, language and issues; documents without tokens are left out."""
    d = docs.select("url", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("body"))
    d = d.withColumn("id", F.col("url")).withColumn("text", text.document_text(F.col("title"), F.col("body"))).withColumn("tokens", text.tokens(F.col("text")))
    d = d.where(F.size("tokens") > 0)
    return d.withColumn("language", text.detect_language(F.array_join("tokens", " "))).withColumn("issues", text.document_issues(F.col("tokens")))


def compare(sources: DataFrame, targets: DataFrame, config: match.MatchConfig = match.MatchConfig(early_stop=0.8), weights: tfidf.TfidfConfig = tfidf.TfidfConfig()) -> DataFrame:
    """Nested results (id, url, title, topics, matches) of prepared sources against prepared targets."""
    sources, targets = written(sources, "linking-sources"), written(targets, "linking-targets")
    best = match.top_matches(sources.select("id", "tokens"), targets.select("id", "tokens"), config, weights)
    t = targets.join(topics.topic_lists(targets.select("id", "tokens")), "id").withColumn("anchor", text.suggested_anchor(F.col("text")))
    s = sources.join(topics.topic_lists(sources.select("id", "tokens")), "id")
    return match.nested(s, best, t)


def run(store: Store, sources: DataFrame, targets: DataFrame, config: match.MatchConfig = match.MatchConfig(early_stop=0.8)) -> DataFrame:
    """Compares the sources that aren't processed for this list of targets, stores edges and status, returns new and cached results.

    sources, targets: url, title, body. A source is marked only if it has a match; the status of processed ones
    without stored edges is cleared, so they are compared on the next run.
    """
    list_id = store.get_or_create_list(targets)
    done, todo = store.split_processed(sources, list_id)
    t, s = prepare(targets), prepare(todo)
    store.put_documents(t.unionByName(s).dropDuplicates(["url"]))
    cached = store.cached_best(done.select("url"))
    with_edges = cached.select(F.col("source_url").alias("url")).distinct()
    store.clear_status(done.select("url").join(with_edges, "url", "left_anti"), list_id)
    fresh = compare(s, t, config)
    edges = fresh.select(F.col("url").alias("source_url"), F.explode("matches").alias("m")).select("source_url", F.col("m.url").alias("target_url"), F.col("m.similarity").alias("score"), F.col("m.anchor").alias("anchor"))
    store.put_edges(edges, list_id)
    stored = store.read("edges").where(F.col("list_id") == list_id).select(F.col("source_url").alias("url")).distinct()
    store.mark_processed(stored.join(s.select("url"), "url", "left_semi"), list_id)
    own = store.read("edges").where(F.col("list_id") == list_id)
    return own.join(sources.select(F.col("url").alias("source_url")), "source_url", "left_semi").select("source_url", "target_url", "score", "anchor")
