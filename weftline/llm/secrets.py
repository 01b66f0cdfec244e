"""Secret scans: fixed patterns, and Markov models of random strings against identifiers.

Both parts are DataFrame expressions over one row at a time: no shuffle, nothing kept between rows.
Positions come from cutting a text at a pattern: the pieces between matches and the matches in turn.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stopword_lists import LISTS
from .common import spread, text_of

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are greedy and a failing run has no longer part, so the least length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

#: A run of these, this long, is a candidate for the models.
RUN = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: What each transition costs before its log-likelihood ratio counts: a stretch goes on as long as it gains more than that.
THRESHOLD = 0.5
#: What a stretch must gain in all, and its characters. Held-out identifiers, paths and long words gain 6.5 at most, 99 in 100 random strings of 20 letters and digits over 10.
GAIN, LEAST = 10.0, 12
#: Labelled strings that the models are fitted on, of each class.
SAMPLES = 4000

_WORDS = (
    "get set make read write open close find first last next value key name list map index count size type file path user data item node "
    "table column row query plan cache store load save update delete insert create remove parse format string number date time zone text "
    "token stream buffer block page order group sort merge join filter select source target result error event message request response "
    "server client session config option default handler manager factory builder service worker thread process memory limit offset length "
    "start stop begin end left right parent child root leaf tree graph edge vector matrix model train test score weight "
    "http https www com org index html images static assets usr local share lib bin home opt var etc src main docs readme version release build"
).split()
#: Ordinary words of several languages, so that long words of prose are no more random than identifiers.
_PROSE = sorted({w for listed in LISTS.values() for w in listed.split() if w.isalpha() and w.isascii() and len(w) > 2})


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """value and label (1: random string, 0: identifier), n of each, made from hashes of row numbers."""
    known = [*_WORDS, *_PROSE]
    at = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(known))).cast("int") + 1
    words = F.split(F.lit(" ".join(known)), " ")
    word = [F.element_at(words, at(k)) for k in range(4)]
    digest = F.concat(F.sha2(F.concat(F.lit("r"), "id"), 256), F.sha2(F.concat(F.lit("s"), "id"), 256))
    b64 = F.regexp_replace(F.base64(F.unhex(digest)), "[\r\n]", "")
    kind = F.pmod("id", F.lit(4))
    random = F.when(kind == 0, F.substring(digest, 1, 40)).when(kind == 1, F.upper(F.regexp_replace(b64, "[+/=]", ""))).when(kind == 2, F.regexp_replace(b64, "[+/]", "")).otherwise(b64)
    number = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(3000)).cast("string")
    style = F.pmod("id", F.lit(7))
    ident = (
        F.when(style == 0, F.concat_ws("_", *word)).when(style == 1, F.concat(word[0], *[F.initcap(w) for w in word[1:]]))
        .when(style == 2, F.upper(F.concat_ws("_", *word))).when(style == 3, F.concat(*word)).when(style == 4, F.concat(F.lit("/"), F.concat_ws("/", *word)))
        .when(style == 5, F.concat(F.concat_ws("-", *word[:3]), F.lit("-"), number)).otherwise(F.concat(F.initcap(word[0]), F.initcap(word[1]), number, F.lit("="), word[2]))
    )
    ids = spark.range(n)
    return ids.select(random.alias("value"), F.lit(1).alias("label")).union(ids.select(ident, F.lit(0)))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio, random against identifier, of each of the 67 x 67 transitions.

    samples: value, label; null values and characters outside the alphabet are left out. Counts start
    at 0.5. The result is of fixed size, whatever the samples.
    """
    n = len(ALPHABET)
    i = F.explode(F.sequence(F.lit(1), F.length("value") - 1))
    pairs = samples.where(F.length("value") > 1).select("label", "value", i.alias("i")).select("label", F.expr(f"instr('{ALPHABET}', substr(value, i, 1))").alias("a"), F.expr(f"instr('{ALPHABET}', substr(value, i + 1, 1))").alias("b"))
    counts = pairs.where("a > 0 and b > 0").groupBy("label", "a", "b").count().collect()  # at most 2 x 67 x 67 rows
    table = {(r["label"], r["a"], r["b"]): r["count"] for r in counts}

    def log_p(label: int) -> list[list[float]]:
        rows = [[table.get((label, a, b), 0) + 0.5 for b in range(1, n + 1)] for a in range(1, n + 1)]
        return [[math.log(x / sum(row)) for x in row] for row in rows]

    random, ident = log_p(1), log_p(0)
    return [random[a][b] - ident[a][b] for a in range(n) for b in range(n)]


#: Matches whose places are summed at a time: an array that grows by one is copied each time, so a text of many matches goes in parts.
PART = 256


def _starts(text: Column, pattern: str, matches: Column) -> Column:
    """struct(start, end) of each match, in code points."""
    span = "array<struct<start:int,end:int>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("spans"))

    def placed(pairs: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("spans"))
        return F.aggregate(pairs, zero, step)

    def joined(parts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("bases"))
        bases = F.aggregate(parts, zero, lambda acc, p: F.struct((acc["at"] + p["at"]).alias("at"), F.concat(acc["bases"], F.array(acc["at"])).alias("bases")), lambda acc: acc["bases"])
        moved = F.zip_with(parts, bases, lambda p, base: F.transform(p["spans"], lambda s: F.struct((s["start"] + base).alias("start"), (s["end"] + base).alias("end"))))
        return F.flatten(moved)

    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(matches)).alias("g"), matches.alias("m"))
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    parts = let(pairs, lambda all_: F.transform(F.sequence(F.lit(1), F.greatest(F.size(all_), F.lit(1)), F.lit(PART)), lambda i: placed(F.slice(all_, i, PART))))
    return let(parts, joined)


def find(docs: DataFrame, table: list[float], threshold: float = THRESHOLD, gain: float = GAIN) -> DataFrame:
    """Spans of secrets in each row of docs.

    Returns doc_id, n_assign, n_access, n_hex (long), base_sha256, spans (kind:start:end in code points,
    end exclusive, by start and then kind, comma-joined), n_random (spans that only the models add).
    Of each run of characters of secrets the models add the stretch that gains most: the greatest sum of log-likelihood ratios less
    threshold a transition, so a secret joined to a name or a path is found in it. It must gain as much as gain and have LEAST
    characters. A null or empty text has none, and base_sha256 of the empty string; a text of any length is read in one pass. A stretch that
    touches a span of the patterns isn't added again. Rows are judged one by one, so repeats and null ids change
    nothing; an empty table gives no rows; extra columns are ignored.
    """
    t, low = F.col("t"), F.col("low")
    hint = reduce(lambda a, b: a | b, [low.contains(w) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")])
    none = F.array().cast("array<string>")
    d = docs.select("doc_id", text_of().alias("t")).withColumn("low", F.lower("t"))
    d = d.select("doc_id", "t", hint.alias("h_assign"), t.contains("AKIA").alias("h_access"), t.rlike(HEX).alias("h_hex"), t.rlike(RUN).alias("h_run"))
    d = d.select(
        "doc_id", "t",
        *[F.when(F.col(f"h_{k}"), F.regexp_extract_all("t", F.lit(p), F.lit(0))).otherwise(none).alias(f"m_{k}") for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("run", RUN))],
        F.when(F.col("h_assign"), F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2))).otherwise(none).alias("v_assign"),
    )
    empty = F.array().cast("array<struct<start:int,end:int>>")
    at = {k: F.when(F.size(f"m_{k}") > 0, _starts(t, p, F.col(f"m_{k}"))).otherwise(empty) for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("run", RUN))}
    d = d.select("doc_id", "m_run", "v_assign", *[c.alias(f"s_{k}") for k, c in at.items()])

    def kinded(spans: Column, k: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end")))

    long_enough = F.filter(F.arrays_zip(F.col("s_assign").alias("s"), F.col("v_assign").alias("v")), lambda x: F.length(x["v"]) >= 6)
    d = d.withColumn("assign", kinded(F.transform(long_enough, lambda x: x["s"]), 0)).withColumn("access", kinded(F.col("s_access"), 1)).withColumn("hex", kinded(F.col("s_hex"), 2))
    d = d.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))

    n = len(ALPHABET)
    ratios = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")

    def stretch(w: Column) -> Column:
        """struct(best, from, to): the maximum-sum stretch of a run, 0-based, end exclusive."""
        codes = F.transform(F.split(w, ""), lambda c: F.instr(F.lit(ALPHABET), c))
        zero = F.struct(F.lit(0).alias("last"), F.lit(0).alias("i"), F.lit(0.0).alias("sum"), F.lit(0).alias("begin"), F.lit(0.0).alias("best"), F.lit(0).alias("from"), F.lit(0).alias("to"))

        def step(acc: Column, c: Column) -> Column:
            more = F.when(acc["last"] > 0, F.element_at(ratios, (acc["last"] - 1) * n + c) - F.lit(threshold)).otherwise(F.lit(0.0))
            # what came before helps if it is over 0; else the stretch begins with the character before this one
            go = acc["sum"] > 0
            total = F.when(go, acc["sum"] + more).otherwise(more)
            begin = F.when(go, acc["begin"]).otherwise(F.greatest(acc["i"] - 1, F.lit(0)))
            better = total > acc["best"]
            return F.struct(
                c.alias("last"), (acc["i"] + 1).alias("i"), total.alias("sum"), begin.alias("begin"), F.when(better, total).otherwise(acc["best"]).alias("best"),
                F.when(better, begin).otherwise(acc["from"]).alias("from"), F.when(better, acc["i"] + 1).otherwise(acc["to"]).alias("to"),
            )

        return F.aggregate(codes, zero, step)

    found = F.transform(F.arrays_zip(F.col("s_run").alias("s"), F.col("m_run").alias("w")), lambda x: F.struct(x["s"].alias("s"), stretch(x["w"]).alias("b")))
    spans = F.transform(F.filter(found, lambda x: (x["b"]["best"] >= F.lit(gain)) & (x["b"]["to"] - x["b"]["from"] >= LEAST)), lambda x: F.struct((x["s"]["start"] + x["b"]["from"]).alias("start"), (x["s"]["start"] + x["b"]["to"]).alias("end")))
    d = d.withColumn("stretches", F.when(F.size("m_run") > 0, spans).otherwise(empty))
    runs = F.filter(F.col("stretches"), lambda x: ~F.exists(F.col("base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    d = d.withColumn("random", kinded(runs, 3))
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return d.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "random"))).alias("spans"), F.size("random").cast("long").alias("n_random"),
    )


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    return find(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), train(labelled_samples(spark)))
