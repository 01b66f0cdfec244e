"""Keyed stores on Parquet, in versions.

A table is cut into PARTS parts by the hash of its first key column. A version is a small file that lists the folder of each
part; a change writes the parts that it touches anew, then creates the next version file, which fails if another writer was
first (the change is then made again on top of it). A version file is never replaced or removed while it is the newest, and
nothing is read that no version names: after a crash between the two steps the table is as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

PRE = T.StructType([T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("language", T.StringType()), T.StructField("token_count", T.IntegerType()), T.StructField("issues", T.ArrayType(T.StringType()))])
_time = [T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType())]
SCHEMAS = {
    "urls": T.StructType([T.StructField(c, T.StringType()) for c in ("url", "title", "body")] + [T.StructField("preprocessed", PRE)] + _time),
    "edges": T.StructType([T.StructField(c, T.StringType()) for c in ("source_url", "target_url", "list_id")] + [T.StructField("score", T.DoubleType()), T.StructField("anchor", T.StringType())] + _time),
    "lists": T.StructType([T.StructField("list_id", T.StringType()), T.StructField("url", T.StringType())] + _time),
    "status": T.StructType([T.StructField(c, T.StringType()) for c in ("source_url", "list_id")] + [T.StructField("processed", T.BooleanType())] + _time),
}
KEYS = {"urls": ["url"], "edges": ["source_url", "target_url", "list_id"], "lists": ["url", "list_id"], "status": ["source_url", "list_id"]}
#: Parts of a table; a part file of a store of terabytes is some gigabytes, and a change touches the parts of its keys only.
PARTS = 16
END = "end"


class Store:
    """Tables urls, edges, lists and status under one folder (any file system that Spark reaches)."""

    def __init__(self, spark: SparkSession, folder: str, parts: int = PARTS):
        self.spark, self.folder, self.parts = spark, folder.rstrip("/"), parts

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _read_text(self, fs, path) -> str:
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _versions(self, name: str) -> list[int]:
        fs, folder = self._fs(f"{self.folder}/{name}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest(self, name: str) -> tuple[int, dict[int, str]]:
        """Number of the newest whole version, and the folder of each part in it. One still being written doesn't count."""
        for number in reversed(self._versions(name)):
            lines = self._read_text(*self._fs(f"{self.folder}/{name}/versions/{number:012d}")).split("\n")
            if lines[-1] == END:
                return number, {int(part): path for part, _, path in (line.partition(" ") for line in lines[:-1])}
        return 0, {}

    def _load(self, name: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def read(self, name: str) -> DataFrame:
        return self._load(name, sorted(self._manifest(name)[1].values()))

    def _part(self, name: str) -> Column:
        return F.pmod(F.xxhash64(KEYS[name][0]), F.lit(self.parts)).cast("int")

    def _read_key(self, name: str, key: str) -> DataFrame:
        """Rows with this first key: one part is read."""
        part = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(key)), F.lit(self.parts)).cast("int")).first()[0]
        path = self._manifest(name)[1].get(part)
        return self._load(name, [path] if path else []).where(F.col(KEYS[name][0]) == key)

    def _commit(self, name: str, number: int, paths: dict[int, str]) -> bool:
        fs, path = self._fs(f"{self.folder}/{name}/versions/{number:012d}")
        try:
            out = fs.create(path, False)  # fails if it is there
        except Exception as failed:
            if "already exists" in str(failed):
                return False
            raise
        out.write(bytearray("\n".join([*(f"{part} {at}" for part, at in sorted(paths.items())), END]).encode()))
        out.close()
        return True

    def _change(self, name: str, touched: list[int] | None, made: Callable[[DataFrame], DataFrame]) -> None:
        """Replaces the touched parts (None: all) by what is made of their rows, and commits; again if another writer was first."""
        while True:
            number, paths = self._manifest(name)
            old = {p: at for p, at in paths.items() if touched is None or p in touched}
            folder = f"{self.folder}/{name}/{uuid.uuid4().hex}"
            new = made(self._load(name, sorted(old.values()))).select(*SCHEMAS[name].names)
            new.withColumn("part", self._part(name)).repartition("part").write.partitionBy("part").parquet(folder)
            fs, root = self._fs(folder)
            own = [s.getPath().getName() for s in fs.listStatus(root)]
            left = {p: at for p, at in paths.items() if p not in old}
            if self._commit(name, number + 1, {**left, **{int(n.removeprefix("part=")): f"{folder}/{n}" for n in own if n.startswith("part=")}}):
                return
            fs.delete(root, True)

    def vacuum(self, name: str, keep: int = 2) -> None:
        """Removes what only versions before the newest keep ones name; readers of those lose it."""
        versions, fs = self._versions(name), self._fs(self.folder)[0]
        used, gone = set(), versions[:-keep]
        for number in versions[-keep:]:
            lines = self._read_text(*self._fs(f"{self.folder}/{name}/versions/{number:012d}")).split("\n")
            used |= {line.partition(" ")[2] for line in lines if line != END}
        for number in gone:
            path = self._fs(f"{self.folder}/{name}/versions/{number:012d}")[1]
            for line in self._read_text(fs, path).split("\n"):
                at = line.partition(" ")[2]
                if line != END and at not in used:
                    fs.delete(self._fs(at)[1], True)
            fs.delete(path, False)

    def _touched(self, name: str, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self._part(name).alias("p")).distinct().collect()]  # PARTS numbers at most

    def merge(self, name: str, rows: DataFrame) -> None:
        """Inserts or updates by key: the last of rows with a key (by anything, made definite) wins; created_at stays."""
        key = KEYS[name]
        values = [c for c in SCHEMAS[name].names if c not in (*key, "created_at", "updated_at")]
        one = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in values])
        rows = rows.select(*key, *values)
        rows = rows.withColumn("__r", F.row_number().over(one)).where("__r = 1").drop("__r") if values else rows.distinct()
        path = f"{self.folder}/{name}/incoming-{uuid.uuid4().hex}"
        rows.write.parquet(path)  # so that rows that come from this table, or from anything costly, are read once
        rows = self.spark.read.schema(rows.schema).parquet(path)

        def made(old: DataFrame) -> DataFrame:
            new = rows.join(old.select(*key, "created_at"), key, "left").withColumn("updated_at", F.current_timestamp()).withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))
            return old.join(rows.select(*key), key, "left_anti").select(*SCHEMAS[name].names).unionByName(new.select(*SCHEMAS[name].names))

        if touched := self._touched(name, rows):
            self._change(name, touched, made)
        fs, incoming = self._fs(path)
        fs.delete(incoming, True)

    def delete(self, name: str, rows: DataFrame) -> None:
        """Removes the rows that have a key of rows (some or all key columns)."""
        touched = self._touched(name, rows) if KEYS[name][0] in rows.columns else None
        if touched != []:
            self._change(name, touched, lambda old: old.join(rows, rows.columns, "left_anti"))

    # ---- documents and edges

    def document(self, url: str) -> DataFrame:
        return self._read_key("urls", url).limit(1)

    def put_documents(self, docs: DataFrame) -> None:
        """docs: url, title, body, tokens, language, issues; nulls become empty."""
        text = lambda c: F.coalesce(c, F.lit("")).alias(c)
        pre = F.struct("tokens", "language", F.size("tokens").alias("token_count"), "issues")
        self.merge("urls", docs.select("url", text("title"), text("body"), pre.alias("preprocessed")))

    def delete_documents(self, urls: DataFrame) -> None:
        """urls (url) and all edges and statuses that refer to them: these first, so that a crash leaves no edge without its document."""
        for name, column in (("edges", "source_url"), ("edges", "target_url"), ("status", "source_url")):
            self.delete(name, urls.select(F.col("url").alias(column)))
        self.delete("urls", urls)

    def put_edges(self, matches: DataFrame, list_id: str) -> None:
        """matches: source_url, target_url, score, anchor; those whose urls aren't both stored are left out."""
        known = self.read("urls").select("url")
        m = matches.join(known, matches.source_url == known.url, "left_semi").join(known, matches.target_url == known.url, "left_semi")
        self.merge("edges", m.withColumn("list_id", F.lit(list_id)))

    def edges_with_documents(self, sources: DataFrame) -> DataFrame:
        """Edges of sources (url) with both documents' attributes: left joins, so an edge without its document stays."""
        e = self.read("edges").join(sources.select(F.col("url").alias("source_url")), "source_url", "left_semi")
        u = self.read("urls")
        s = u.select(F.col("url").alias("source_url"), F.col("title").alias("source_title"), tokens_of(F.col("preprocessed")).alias("source_tokens"))
        t = u.select(F.col("url").alias("target_url"), F.col("title").alias("target_title"), tokens_of(F.col("preprocessed")).alias("target_tokens"))
        return e.join(s, "source_url", "left").join(t, "target_url", "left")

    def cached_best(self, sources: DataFrame, best: int = 5) -> DataFrame:
        """The best stored edges of each source: url of source and target, score, anchor, rank."""
        rank = F.row_number().over(Window.partitionBy("source_url").orderBy(F.col("score").desc(), "target_url"))
        return self.edges_with_documents(sources).withColumn("rank", rank.cast("long")).where(F.col("rank") <= best)

    def best_of(self, url: str, best: int = 5) -> DataFrame:
        return self._read_key("edges", url).orderBy(F.col("score").desc(), "target_url").limit(best)

    # ---- target lists and status

    def target_list(self, list_id: str) -> DataFrame:
        """url of each entry of a list."""
        return self.read("lists").where(F.col("list_id") == list_id).select("url")

    def get_or_create_list(self, urls: DataFrame) -> str:
        """The id (a hash of the sorted urls, taken in parts) of a list of url, which is stored, a row for each url, if it is new."""
        rows = urls.select("url").distinct()
        each = rows.select(F.sha2("url", 256).alias("h"))
        parts = each.groupBy(F.substring("h", 1, 3).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
        whole = parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256).alias("id"))
        list_id = whole.first()[0]
        if self.target_list(list_id).isEmpty():
            self.merge("lists", rows.withColumn("list_id", F.lit(list_id)))
        return list_id

    def mark_processed(self, sources: DataFrame, list_id: str) -> None:
        """sources: url of sources that have at least one match."""
        self.merge("status", sources.select(F.col("url").alias("source_url"), F.lit(list_id).alias("list_id"), F.lit(True).alias("processed")))

    def clear_status(self, sources: DataFrame, list_id: str) -> None:
        self.delete("status", sources.select(F.col("url").alias("source_url"), F.lit(list_id).alias("list_id")))

    def split_processed(self, sources: DataFrame, list_id: str) -> tuple[DataFrame, DataFrame]:
        """sources (url, ...) that are processed for this list, and the others."""
        done = self.read("status").where((F.col("list_id") == list_id) & F.col("processed")).select(F.col("source_url").alias("url"))
        return sources.join(done, "url", "left_semi"), sources.join(done, "url", "left_anti")

    def has_processed(self, list_id: str) -> bool:
        return not self.read("status").where((F.col("list_id") == list_id) & F.col("processed")).isEmpty()

    def corpus_changed(self, name: str, current: str) -> bool:
        """Whether a corpus hash differs from the one kept under name, which is replaced; without one: yes."""
        fs, p = self._fs(f"{self.folder}/hashes/{name}")
        before = self._read_text(fs, p) if fs.exists(p) else None
        out = fs.create(p, True)
        out.write(bytearray(current.encode()))
        out.close()
        return before != current


def tokens_of(preprocessed: Column) -> Column:
    return F.coalesce(preprocessed["tokens"], F.array().cast("array<string>"))
