"""Reading and checking uploads of (url, body) or (url, title, body)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text

UPLOAD = T.StructType([T.StructField("url", T.StringType()), T.StructField("body", T.StringType()), T.StructField("_malformed", T.StringType())])
SHORT, LONG, FEW = 10, 50_000, 3


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV file with a header: line_no (from 2, blank lines not counted), url, body, arity_ok.

    A row of other than two columns is kept, marked. Line numbers come from the order in the file, which a
    quoted line break makes impossible to know from within: one task reads a file, many files run in parallel.
    """
    # without pruning: else rows of wrong arity go unseen
    raw = spark.read.schema(UPLOAD).options(header=True, multiLine=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_malformed", enforceSchema=True, columnPruning=False).csv(path)
    rows = raw.withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id())
    cells = F.concat(F.trim(F.coalesce("url", F.lit(""))), F.trim(F.coalesce("body", F.lit(""))))
    rows = rows.where((F.length(cells) > 0) | F.col("_malformed").isNotNull())
    number = F.row_number().over(Window.partitionBy("file").orderBy("at")) + 1
    return rows.select(number.cast("long").alias("line_no"), "url", "body", F.col("_malformed").isNull().alias("arity_ok"))


#: What a host may not contain: the forbidden code points of the URL standard, control characters and blanks.
_HOST = r"[^\x00-\x20#%/:<>?@\\^|\x7F\[\]]+"
_HTTP = rf"^https?:[/\\]*([^/\\?#]*@)?({_HOST}|\[[0-9a-f:.]+\])(:[0-9]{{0,5}})?([/\\?#]|$)"


def url_issue(url: Column) -> Column:
    """Null if url is an absolute http or https address as browsers take it: blanks, bars and letters of any script may stand after the host,
    slashes may lean either way or be missing, a port has 0 to 65535; tabs and line breaks are ignored. A relative address is invalid."""
    own = F.lower(F.regexp_replace(F.trim(url), r"[\t\n\r]", ""))
    scheme = F.regexp_extract(own, "^([a-z][a-z0-9+.-]*):", 1)
    port = F.coalesce(F.substring(F.regexp_extract(own, _HTTP, 3), 2, 5).try_cast("int"), F.lit(0))
    ok = own.rlike(_HTTP) & (port <= 65535)
    return F.when(own == "", "url_empty").when((scheme == "") | (scheme.isin("http", "https") & ~ok), "url_invalid").when(~scheme.isin("http", "https"), "url_scheme")


def validate(rows: DataFrame) -> DataFrame:
    """rows (line_no, url, body, arity_ok) with tokens, issues (array) and accepted.

    Checks in order: arity, url, repeated url, body. Of rows with one url the first that passes the url checks has it,
    even if its body is then refused. A short body or few words are issues that don't refuse a row.
    """
    r = rows.withColumn("url", F.trim(F.coalesce("url", F.lit("")))).withColumn("body", F.trim(F.coalesce("body", F.lit(""))))
    r = r.withColumn("first_issue", F.when(~F.col("arity_ok"), "columns").otherwise(url_issue(F.col("url"))))
    good = r.where("first_issue is null")
    first = good.groupBy("url").agg(F.min("line_no").alias("first_line"))
    r = r.join(first, "url", "left").withColumn("first_issue", F.when(F.col("first_issue").isNull() & (F.col("line_no") > F.col("first_line")), "url_repeated").otherwise(F.col("first_issue")))
    r = r.withColumn("tokens", text.tokens(F.col("body")))
    refused = F.coalesce("first_issue", F.when(F.col("body") == "", "body_empty").when(F.length("body") > LONG, "body_long"))
    short = F.when(refused.isNull() & (F.length("body") < SHORT), "body_short")
    few = F.when(refused.isNull() & (F.size("tokens") < FEW), "few_words")
    return r.select("line_no", "url", "body", "tokens", F.filter(F.array(refused, short, few), lambda x: x.isNotNull()).alias("issues"), refused.isNull().alias("accepted"))


def accepted(validated: DataFrame) -> DataFrame:
    """url, title, body (the tokens, joined), tokens of accepted rows."""
    return validated.where("accepted").select("url", F.lit("").alias("title"), F.array_join("tokens", " ").alias("body"), "tokens")


def quarantine(validated: DataFrame) -> DataFrame:
    return validated.where(~F.col("accepted"))


def first_issues(validated: DataFrame, n: int = 10) -> DataFrame:
    """The first n issues by line."""
    return validated.select("line_no", F.posexplode("issues").alias("at", "issue")).orderBy("line_no", "at").select("line_no", "issue").limit(n)


def require_rows(validated: DataFrame) -> DataFrame:
    """accepted rows; an error if there are none."""
    out = accepted(validated)
    if out.isEmpty():
        raise ValueError("no valid row in the upload")
    return out
