"""Error reports (message, component, operation, ts, severity): what is recoverable, and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ANYWHERE = ("fetch", "invalid input", "network", "out of memory", "rate limit", "timeout", "vector dimensions mismatch", "worker terminated")
HISTORY, RECENT_S, ATTEMPTS = 100, 300, 3


def recoverable(message: Column, component: Column) -> Column:
    """By message, else by the rule of its component."""
    lower = F.lower(message)
    known = reduce(lambda a, b: a | b, [F.contains(lower, F.lit(p)) for p in ANYWHERE])
    rule = F.when(component == "worker", ~F.contains(message, F.lit("SecurityError"))).when(component == "store", ~F.contains(message, F.lit("authentication")))
    rule = rule.when(component == "csv", F.contains(message, F.lit("parsing")) | F.contains(message, F.lit("format"))).otherwise(False)
    return F.coalesce(known | rule, F.lit(False))


def last_reports(reports: DataFrame, n: int = HISTORY) -> DataFrame:
    """The last n: a top-n by time, so that tasks pass on n rows each."""
    return reports.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(n)


def statistics(reports: DataFrame, now: Column | None = None) -> DataFrame:
    """One row: total_errors, recent_errors (last five minutes), recoverable_percent of the last 100 reports."""
    last = last_reports(reports)
    now = F.current_timestamp() if now is None else now
    recent = F.count_if(F.unix_micros(now) - F.unix_micros("ts") < RECENT_S * 1_000_000)
    return last.agg(F.count("*").alias("total_errors"), recent.alias("recent_errors"), F.coalesce(F.count_if("recoverable") * 100.0 / F.count("*"), F.lit(0.0)).alias("recoverable_percent"))


def by(reports: DataFrame, column: str) -> DataFrame:
    return last_reports(reports).groupBy(column).agg(F.count("*").alias("n"))


def attempts(reports: DataFrame) -> DataFrame:
    """reports with attempt (the how-manieth recoverable one of its component and operation) and tried: whether recovery is still tried."""
    order = Window.partitionBy("component", "operation").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    n = F.count_if("recoverable").over(order)
    return reports.withColumn("attempt", F.when(F.col("recoverable"), n)).withColumn("tried", F.col("recoverable") & (n <= ATTEMPTS))


def recovery(reports: DataFrame) -> DataFrame:
    """reports (id, component, operation, message, severity, recoverable, ts) with attempt and action.

    What is recoverable is tried ATTEMPTS times for each component and operation, in order of time: by a rule of its component, or
    'give up' beyond that; other reports get 'none'. One component's reports may be a third of all, so the
    window keeps ATTEMPTS rows of each group before the shuffle (a group limit), and the rest never meets.
    """
    order = Window.partitionBy("component", "operation").orderBy("ts", "id")
    tried = reports.where("recoverable").withColumn("attempt", F.row_number().over(order).cast("long")).where(F.col("attempt") <= ATTEMPTS).select("id", "attempt")
    has = lambda *words: reduce(lambda a, b: a | b, [F.contains("message", F.lit(w)) for w in words])
    rules = {
        "worker": F.when(has("Worker terminated", "NetworkError"), "restart").when(has("Out of memory"), "free memory"),
        "store": F.when(has("fetch", "network", "timeout"), "retry").when(has("rate limit", "429"), "wait"),
        "tfidf": F.when(has("Invalid input", "empty"), "skip").when(has("Vector dimensions mismatch"), "clear caches"),
        "csv": F.when(has("parsing", "format"), "explain"),
        "memory": F.lit("free memory"),
    }
    by_rule = F.when(F.lit(False), "")
    for component, rule in rules.items():
        by_rule = by_rule.when(F.col("component") == component, F.coalesce(rule, F.lit("fail")))
    by_rule = by_rule.otherwise(F.when(F.col("severity") == "critical", "clear all").otherwise("fail"))
    action = F.when(~F.col("recoverable"), "none").when(F.col("attempt").isNull(), "give up").otherwise(by_rule)
    return reports.join(tried, "id", "left").withColumn("action", action)
