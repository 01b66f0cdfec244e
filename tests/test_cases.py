"""Small cases of single operators."""

import math
import random
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weftline.functions import hashing, text
from weftline.functions.stopwords import stopwords
from weftline.operators import errors, groups, indexes, match, report, tfidf, topics
from weftline.plans import linking
from weftline.sources import ingest, shared
from weftline.sources.store import Store
from weftline.streaming.incremental import link_stream


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["_"]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def strings(spark, value):
    return spark.createDataFrame([(value,)], "v string")


def docs(spark, rows):
    return spark.createDataFrame(rows, "id long, tokens array<string>")


# ---- text


def test_words_are_deleted_not_cut_at_punctuation(spark):
    assert strings(spark, "Don't STATE-of-the-art É1x abc").select(text.words(F.col("v"))).first()[0] == ["dont", "stateoftheart", "abc"]


@pytest.mark.parametrize("value,lang", [("avec joie", "fr"), ("und so", "de"), ("que", "es"), ("gli uomini", "it"), ("mais tarde", "pt"), ("日本", "ja"), ("plain words", "en"), ("éla x", "fr"), ("", "en"), ("le che", "fr"), ("con", "es")])
def test_language(spark, value, lang):
    assert strings(spark, value).select(text.detect_language(F.col("v"))).first()[0] == lang


def test_language_code(spark):
    for name, code in (("Deutsch", "en"), ("ger", "de"), (" JPN ", "ja"), (None, "en"), ("portuguese", "pt")):
        assert strings(spark, name).select(text.language_code(F.col("v"))).first()[0] == code


def test_stop_words_keep_counts_and_detect_anew(spark):
    assert len(stopwords("en")) > 150 and stopwords("ja") == () and stopwords("xx") == stopwords("en")
    df = spark.createDataFrame([(["fox", "the", "fox", "over"],)], "t array<string>")
    assert df.select(text.drop_stopwords(F.col("t"))).first()[0] == ["fox", "fox"]
    assert strings(spark, None).select(text.tokens(F.col("v"))).first()[0] == []


@pytest.mark.parametrize("value,anchor", [("alpha beta gamma delta", "alpha beta gamma"), ("alpha the beta", "alpha beta"), ("12 34 of it 5678901234567890123456789", "12 34 of it 567890123456789012"), ("", "")])
def test_anchor(spark, value, anchor):
    assert strings(spark, value).select(text.suggested_anchor(F.col("v"))).first()[0] == anchor


def test_tokens_in_batches_equal_those_of_expressions(spark, monkeypatch):
    odd = ["le", "la", "las", "für", "the", "die", "é", "ü", "ª", "µ", "×", "÷", "·", "İ", "\u212a", "\u212b", "Σ", "日本", "か", " ", "  ", "\u00a0", "\u200b", "\ufeff", "\u0085", "\n", "\x1c", "'", "²", "½", "Ⅷ", "x", "ab", "que", "avec", "A" * 30, "b" * 25, "Ÿ", "ẞ", "ǅ", "\u2003", "𝒳"]
    draw = random.Random(3)
    texts = [None, "", *("".join(draw.choice(odd) for _ in range(draw.randint(0, 30))) for _ in range(3000))]
    from weftline.functions import words

    monkeypatch.setattr(words, "PACKED", 7)  # of the driver; lists() is tried with it below
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    first = text.drop_stopwords(text.words(F.coalesce("v", F.lit(""))))
    rows = df.select(text.tokens(F.col("v")).alias("a"), first.alias("b"), text.drop_again(text.tokens(F.col("v"))).alias("c"), text.drop_stopwords(first).alias("d")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and [r.c for r in rows] == [r.d for r in rows]
    assert words.lists(iter([["a"] * 9, [], ["b"], ["c"] * 7])).to_pylist() == [["a"] * 9, [], ["b"], ["c"] * 7]
    assert words.lists(iter([])).to_pylist() == []


def test_parts_of_an_input_do_not_grow_with_it(spark, tmp_path, monkeypatch):
    spark.range(20000).write.parquet(path := str(tmp_path / "t"))
    df = spark.read.parquet(path)
    monkeypatch.setattr(shared, "PIECE", 1000)
    size = sum(f.stat().st_size for f in Path(path).glob("*.parquet"))
    assert shared.spread(df).rdd.getNumPartitions() >= size // 1000 > 2 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(shared, "SMALL", 1)
    assert shared.spread(df).rdd.getNumPartitions() == df.rdd.getNumPartitions() < shared.spread(df, always=True).rdd.getNumPartitions()


def test_document_issues(spark):
    df = spark.createDataFrame([(None,), ([],), (["a", " "],), (["a", "b", "c"],)], "t array<string>")
    assert [r[0] for r in df.select(text.document_issues(F.col("t"))).collect()] == [["not an array"], ["empty"], ["under 3 words", "1 blank terms"], []]


# ---- TF-IDF


def test_weights_by_hand(spark):
    counts = tfidf.term_counts(docs(spark, [(1, ["a", "a", "a", "b"])]))
    assert {r.term: r.tf for r in counts.select("term", tfidf.tf().alias("tf")).collect()} == {"a": pytest.approx(1 + math.log(3)), "b": 1.0}
    three = docs(spark, [(1, ["a", "b"]), (2, ["a"]), (3, ["a", " "])])
    c = tfidf.term_counts(three)
    idf = {r.term: r.idf for r in tfidf.idf(tfidf.document_frequency(c), tfidf.n_documents(three)).collect()}
    assert idf == {"a": pytest.approx(1), "b": pytest.approx(math.log(2) + 1)}


def test_unit_lengths_equal_those_of_two_steps(spark):
    w = spark.createDataFrame([(1, "a", 3.0), (1, "b", 4.0), (2, "a", 0.0), (None, "c", 2.0)], "id long, term string, w double")
    found = {r.id: tuple(r)[1:] for r in tfidf.unit_lengths(w).collect()}
    assert found == {1: (2, 5.0, pytest.approx(1)), 2: (1, 0.0, 0.0), None: (1, 2.0, 1.0)}


def test_similarity_properties(spark):
    t = docs(spark, [(1, ["a", "b", "c"]), (2, ["a", "d"]), (3, ["e"])])
    s = docs(spark, [(1, ["c", "b", "a"]), (9, ["zzz"])])
    sims = {(r.src, r.tgt): r.sim for r in match.similarities(s, t).collect()}
    assert sims[1, 1] == pytest.approx(1) and sims[1, 1] <= 1 and set(sims) == {(1, 1), (1, 2)} and 0 < sims[1, 2] < 1


def brute_best(s, t, k, least=0.01):
    n, df = len(t), {}
    for _, w in t:
        for x in set(w):
            df[x] = df.get(x, 0) + 1

    def vector(w):
        v = {x: (1 + math.log(w.count(x))) * (math.log((n + 1) / (df[x] + 1)) + 1) for x in set(w) if x in df}
        length = math.sqrt(sum(y * y for y in v.values()))
        return {x: y / length for x, y in v.items()}

    tv, out = [(i, vector(w)) for i, w in t], []
    for i, w in s:
        v = vector(w)
        sims = sorted((-round(x, 9), j) for j, u in tv if (x := sum(v[a] * u.get(a, 0) for a in v)) >= least)
        out += [(i, j, round(-x, 6), r + 1) for r, (x, j) in enumerate(sims[:k])]
    return sorted(out)


@pytest.mark.parametrize("rows,frequent,expanded", [(4096, 0.02, 8_000_000), (7, 2.0, 100), (7, 0.0, 5)])
def test_top_matches_equal_brute_force(spark, monkeypatch, rows, frequent, expanded):
    import random

    r = random.Random(5)
    for name, value in (("TARGET_ROWS", rows), ("SOURCE_ROWS", rows), ("CHUNK", 4), ("FREQUENT", frequent), ("EXPANDED", expanded)):
        monkeypatch.setattr(match, name, value)
    words = [f"w{i}" for i in range(40)]
    t = [(i, [words[min(int(r.expovariate(0.15)), 39)] for _ in range(r.randint(0, 12))]) for i in range(60)] + [(100 + i, ["w1", "w2", "w30"]) for i in range(9)]
    s = t[10:40] + [(500, ["none"]), (501, ["w1", "w2", "w30"]), (502, [])]
    got = sorted(tuple(x) for x in match.top_matches(docs(spark, s), docs(spark, t)).select("src", "tgt", F.round("sim", 6), "rank").collect())
    assert got == brute_best(s, t, 5)
    alone = match.top_matches(docs(spark, s), docs(spark, t), match.MatchConfig(exclude_self=True)).where("src = tgt or rank > 5").count()
    assert alone == 0 and match.top_matches(docs(spark, s), docs(spark, []), match.MatchConfig()).count() == 0 and match.top_matches(docs(spark, []), docs(spark, t)).count() == 0
    named = lambda x: docs(spark, x).select(F.concat(F.lit("u"), "id").alias("id"), "tokens")
    assert sorted((x.src, x.tgt) for x in match.top_matches(named(s[:3]), named(t)).collect()) == sorted((f"u{a}", f"u{b}") for a, b, _, _ in brute_best(s[:3], [(f"{i}", w) for i, w in t], 5))


def test_rough_scores_lose_no_match():
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(2)
    # long rows that differ in one weight: their scores are equal in single precision, but not to 9 decimals
    terms, n = 900, 40
    weights = np.ones((n, terms))
    weights[:, 0] += draw.permutation(n) * 1e-4
    weights[:3, 5:] = draw.random((3, terms - 5))
    block = pa.table({"id": np.arange(n), "terms": pa.array([list(range(terms))] * n), "weights": pa.array(weights.tolist())})
    rough = match._load_rough(block)
    rows = np.arange(n)
    unit = weights / np.linalg.norm(weights, axis=1, keepdims=True)
    for frequent in (rough, match._load_rough(block) | {"column": np.full(terms, -1), "matrix": np.zeros((0, n), np.float32)}):
        assert (np.abs(match._score_rough(rough, rows, frequent) - unit @ unit.T) <= rough["error"][:, None]).all()
    r, c = np.divmod(np.arange(n * n), n)
    assert np.abs(match._exact(rough, rows, r, rough, c).reshape(n, n) - unit @ unit.T).max() < 1e-13


def test_rough_and_exact_matches_are_the_same(tmp_path, monkeypatch):
    import pyarrow as pa

    draw = random.Random(9)
    monkeypatch.setattr(match, "CHUNK", 7)
    monkeypatch.setattr(match, "EXPANDED", 40)
    rows = [[draw.choice("abcdefghij") for _ in range(draw.randint(1, 6))] for _ in range(60)]
    rows += rows[:20]  # copies: equal scores, by target
    ids = list(range(len(rows)))
    terms = [sorted({ord(x) for x in r}) for r in rows]
    block = pa.table({"id": ids, "terms": pa.array(terms), "weights": pa.array([[1.0 + t % 3 for t in ts] for ts in terms])})
    import pyarrow.parquet as pq

    for i, part in enumerate((block.slice(0, 25), block.slice(25, 30), block.slice(55))):
        (tmp_path / f"block={i}").mkdir()
        pq.write_table(part, tmp_path / f"block={i}" / "x.parquet")
    for best, own in ((5, False), (5, True), (1, False), (100, True)):
        both = []
        for load, score, exact in ((match._load_sparse, match._score_sparse, None), (match._load_rough, match._score_rough, match._exact)):
            out = match._best_of_block(load(block), f"file://{tmp_path}", ["id", "terms", "weights"], load, score, best, 0.01, own, exact)
            both.append([(r["src"], r["rank"], r["tgt"], round(r["sim"], 9)) for b in out for r in b.to_pylist()])
        assert both[0] == both[1] and both[0]


def test_dense_best(spark):
    kind = "id long, vec array<double>"
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, []), (5, None), (6, [0.0, 0.0]), (7, [2.0, 0.0]), (8, [-1.0, 0.0])], kind)
    got = [(r.src, r.tgt, round(r.sim, 6), r["rank"]) for r in match.dense_best(v, v).orderBy("src", "rank").collect()]
    half = round(math.sqrt(0.5), 6)
    assert got == [(1, 1, 1.0, 1), (1, 7, 1.0, 2), (1, 2, half, 3), (2, 2, 1.0, 1), (2, 1, half, 2), (2, 7, half, 3), (3, 3, 1.0, 1), (7, 1, 1.0, 1), (7, 7, 1.0, 2), (7, 2, half, 3), (8, 8, 1.0, 1)]
    assert match.dense_best(v, v.limit(0)).count() == 0


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0], [2.0, 2.0])], "a array<double>, b array<double>, z array<double>, c array<double>")
    c = lambda x, y, **k: df.select(tfidf.cosine(F.col(x), F.col(y), **k)).first()[0]
    assert c("a", "b") == 0 and c("a", "z") == 0 and c("a", "c") == pytest.approx(math.sqrt(0.5)) and c("c", "c") <= 1
    with pytest.raises(PySparkException):
        c("a", "b", checked=True)


@pytest.mark.parametrize("sims,config,n", [([0.95, 0.9, 0.85, 0.83, 0.81, 0.5], match.MatchConfig(early_stop=0.8), 4), ([0.99, 0.98, 0.97, 0.96, 0.95, 0.85], match.MatchConfig(early_stop=0.8), 5), ([0.95, 0.9, 0.85, 0.83, 0.81, 0.5], match.MatchConfig(), 5), ([0.01, 0.0099], match.MatchConfig(), 1), ([0.9, 0.8, 0.7], match.MatchConfig(max_candidates=2), 2)])
def test_best_matches(spark, sims, config, n):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(sims)], "src long, tgt long, sim double")
    assert match.best_matches(df, config).count() == n


def test_sources_without_matches_stay(spark):
    s = spark.createDataFrame([(1, "u", "", ["t"])], "id long, url string, title string, topics array<string>")
    none = spark.createDataFrame([], "src long, tgt long, sim double, rank long")
    r = match.nested(s, none, s.withColumn("anchor", F.lit("")))
    assert r.first().matches == []
    assert report.export_rows(r).collect() == [("u", "", "", "", "t")]


# ---- topics


def test_topics_tie_by_term(spark):
    d = docs(spark, [(1, ["beta", "alpha", "gamma", "alpha", "beta", "delta", "zeta", "eta", "the"]), (2, [])])
    assert {r.id: r.topics for r in topics.topic_lists(d).collect()} == {1: ["alpha", "beta", "delta", "eta", "gamma"], 2: []}


def test_topic_model(spark):
    d = docs(spark, [(1, ["a", "b"]), (2, ["b", "a"]), (3, ["a", "c"])])
    scores = {r.word: r.score for r in topics.train(d).collect()}  # 1 and 2 are equal and both count
    ab, ac, size = math.log(1 + 3 * 2), math.log(1 + 3 * 1), 1 + math.log(2)
    assert scores == {"a": pytest.approx((2 * ab + ac) / size), "b": pytest.approx(2 * ab / size), "c": pytest.approx(ac / size)}
    known = d.where("id = 1").select(topics.model_key().alias("key"))
    assert {r.word for r in topics.train(d, known).collect()} == {"a", "c"}
    assigned = topics.assign(topics.train(d))
    assert {r.topic for r in assigned.collect()} == {"topic_0", "topic_1"}
    t = topics.document_topics(d, assigned)
    pairs = spark.createDataFrame([(1, 3), (1, 99)], "a long, b long")
    assert {(r.a, r.b): r.related for r in topics.related(pairs, t).collect()} == {(1, 3): True, (1, 99): False}
    lists = spark.createDataFrame([(["x", "y", "z"], ["y", "z", "w"]), (["x"], [])], "a array<string>, b array<string>")
    assert [r[0] for r in lists.select(topics.overlap("a", "b")).collect()] == [2, 0]


# ---- indexes


def test_best_words_equal_those_of_all_pair_scores():
    import numpy as np
    import pyarrow as pa

    draw = random.Random(4)
    for n in (1, 20, 21, 40):
        for _ in range(60):
            big = draw.random() < 0.5
            f = np.array(sorted((float(draw.choice([2_000_000_000 + draw.randint(0, 9), draw.randint(1, 9)]) if big else draw.randint(1, 40)) for _ in range(n)), reverse=True))
            words = [f"w{draw.random():.6f}" for _ in range(n)]
            rows = sorted(zip(f, words), key=lambda r: (-r[0], r[1]))
            f, words = np.array([r[0] for r in rows]), [r[1] for r in rows]
            score = lambda x: round(float(sum(math.log(1 + x * g) for g in f) - math.log(1 + x * x)), 6)  # noqa: B023, E731
            scores = {x: score(x) for x in set(f.tolist())}
            asked = sorted(range(n), key=lambda i: (-scores[f[i]], words[i]))[:20]  # noqa: B023
            assert sorted(topics._best_words(f, pa.array(words)).tolist()) == sorted(asked)


def test_topic_model_joins_no_pairs_of_words(spark):
    rows = docs(spark, [(1, [f"w{i}" for i in range(300)]), (None, ["w1", "w2"]), (2, ["w1", "w2", "w2"])])
    scores = topics.train(rows)
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
    assert scores.count() == 20


def test_rows_of_a_key_come_together(spark):
    import pyarrow as pa

    def work(rows, first):
        ends = [*first[1:].tolist(), rows.num_rows]
        yield pa.record_batch([rows["k"].take(first).combine_chunks(), pa.array([e - a for a, e in zip(first.tolist(), ends)]), pa.array([rows["v"].slice(a, e - a).to_pylist() for a, e in zip(first.tolist(), ends)])], names=["k", "n", "v"])

    rows = [(i % 7 or None, i) for i in range(500)] + [(100, 1)] + [(8, i) for i in range(90)]
    df = spark.createDataFrame(rows, "k long, v long")
    own = groups.by_key
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in ("1", "13", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            found = own(df, "k", work, "k long, n long, v array<long>", "v").collect()
            assert {r.k: r.v for r in found} == {k: sorted(v for c, v in rows if c == k) for k in {c for c, _ in rows}} and len(found) == 9
        assert own(df.limit(0), "k", work, "k long, n long, v array<long>").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_search_ignores_unknown_terms(spark):
    index = indexes.postings(docs(spark, [(1, ["a", "b", "a"]), (2, ["a"]), (3, ["b"])]))
    ids = lambda *terms: sorted(r.id for r in indexes.search_all(index, list(terms)).collect())
    assert ids("a", "b") == [1] and ids("a", "none") == [1, 2] and ids("none") == [] and ids() == [] and ids("a", "a") == [1, 2]


def test_prefixes(spark):
    assert strings(spark, "The theory, of th other").select(indexes.prefixes(F.col("v"))).first()[0] == ["the", "oth"]


def minhash(terms, n):
    out = []
    for i in range(n):
        values = []
        for t in terms:
            h = 31 * (i + 1)
            for c in [*map(ord, t[:256]), *[0] * (256 - len(t[:256]))]:
                h = (h * 31 + c) % hashing.PRIME
            values.append(h % 2**32)
        out.append(min(values))
    return out


def test_minhash(spark):
    config = indexes.LshConfig(hashes=8, bands=4)
    d = docs(spark, [(1, ["abc", "éx", "q" * 300]), (2, ["abc", "éx", "q" * 300]), (3, ["other"])])
    got = {r.id: r.sig for r in indexes.signatures(d, config).collect()}
    assert got[1] == minhash(["abc", "éx", "q" * 300], 8) == got[2] != got[3]
    pairs = {tuple(r) for r in indexes.lsh_candidates(d, d, config).collect()}
    assert {(1, 1), (1, 2), (2, 1), (3, 3)} <= pairs and all((b, a) in pairs for a, b in pairs)
    every = indexes.lsh_candidates(d, d, indexes.LshConfig(hashes=8, bands=4, degenerate=True))
    assert every.count() == 9


def test_bloom_filter_has_no_false_negatives(spark):
    config = indexes.BloomConfig(items=50)
    assert (config.bits, config.hashes) == (480, 7)
    values = spark.createDataFrame([(f"value {i} é",) for i in range(50)], "value string")
    bits = indexes.bloom_bits(values, config)
    assert all(r.maybe for r in indexes.bloom_probe(values, bits, config).collect())
    others = spark.createDataFrame([(f"other {i}",) for i in range(200)], "value string")
    # its hashes differ by a multiple of a power of 31 alone, so it passes more than the one in a hundred of independent ones
    assert sum(r.maybe for r in indexes.bloom_probe(others, bits, config).collect()) < 100
    assert 0 < indexes.bloom_rate(bits, config).first().rate < 0.05


def test_hashes(spark):
    import hashlib

    df = spark.createDataFrame([(["b", "a"], ["t2", "t1"])], "u array<string>, t array<string>")
    assert df.select(hashing.list_hash(F.col("u"))).first()[0] == hashlib.sha256(b"a|b").hexdigest()
    h = 0
    for c in "b|a:t1|t2":
        h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
    digits, n = "", abs(h)
    while n:
        digits, n = "0123456789abcdefghijklmnopqrstuvwxyz"[n % 36] + digits, n // 36
    assert df.select(hashing.cache_key(F.col("u"), F.col("t"))).first()[0] == f"vec:{digits}:2:2"
    d = docs(spark, [(1, ["x", "y"]), (2, ["z"])])
    same = docs(spark, [(5, ["z"]), (6, ["y", "x"])])
    assert tuple(hashing.exact_corpus_hash(d).first()) == (hashlib.sha256(b"x|y||z").hexdigest(), 2)
    many = spark.createDataFrame([("a", "2"), ("a", "1"), (None, "3"), ("b", None)], "k string, v string")
    assert {r.of: r.hash for r in hashing.exact_list_hashes(many, "k", "v").collect()} == {k: hashlib.sha256(v).hexdigest() for k, v in (("a", b"1|2"), (None, b"3"), ("b", b""))}
    assert hashing.weak_fingerprint(d).first()[0] == "2|2"
    assert hashing.corpus_hash(d).first() == hashing.corpus_hash(same).first() != hashing.corpus_hash(d.limit(1)).first()


def test_no_task_reads_all_values_of_an_exact_hash(spark, tmp_path, monkeypatch):
    import hashlib

    monkeypatch.setattr(hashing, "PART", 2000)
    monkeypatch.setattr(hashing, "BATCH", 3)
    orders = []
    own = hashing.parquet_files
    monkeypatch.setattr(hashing, "parquet_files", lambda folder: orders.append(own(folder)) or orders[-1])
    values = [f"é{i % 300:04d}" for i in range(900)] + ["same"] * 500
    df = spark.createDataFrame([(k, v) for k in ("a", "b") for v in values], "k string, v string")
    found = {r.of: (r.hash, r.n) for r in hashing.exact_list_hashes(df, "k", "v").collect()}
    right = hashlib.sha256("|".join(sorted(values)).encode()).hexdigest()
    assert found == {k: (right, len(values)) for k in ("a", "b")}
    import pyarrow.parquet as pq

    assert max(pq.ParquetFile(f).metadata.num_rows for f in orders[0]) < 500
    assert hashing.exact_list_hashes(df.limit(0), "k", "v").count() == 0


# ---- results


@pytest.fixture()
def results(spark):
    rows = [(1, "https://a/1", "", ["t", "u"], [("https://b/2", 0.5, 'say "hi"', ["t"]), ("https://b/3", 0.126, "x", [])]), (2, "https://a/2", "", [], [])]
    return spark.createDataFrame(rows, "id long, url string, title string, topics array<string>, matches array<struct<url:string,similarity:double,anchor:string,topics:array<string>>>")


def test_topic_groups_count_repeats(results):
    twice = results.union(results)
    assert {r.topic: r.n for r in report.group_by_topic(twice).collect()} == {"t": 4, "u": 2}
    assert {r.topic: r.n for r in report.topic_counts(results).collect()} == {"t": 2, "u": 1}


@pytest.mark.parametrize("term,ids", [("", [1, 2]), ("A/2", [2]), ("SAY", [1]), ("b/3", [1]), ("%", []), ("u", [1])])
def test_search(results, term, ids):
    found = sorted(r.id for r in report.search(results, term).collect())
    assert found == ids


def test_pages_and_export(results, tmp_path):
    assert [r.id for r in report.page(results, 1, size=1).collect()] == [1] and [r.id for r in report.page(results, 2, size=1).collect()] == [2]
    assert report.n_pages(results).first()[0] == 1
    path = report.write_export(results, f"file://{tmp_path}", datetime(2024, 5, 6))
    assert path.endswith("2024-05-06.csv")
    lines = sorted(line for f in (tmp_path / path.rpartition("/")[2]).glob("part*") for line in f.read_text().splitlines())
    assert '"https://a/1","https://b/2","50.00","t","t; u"' in lines and '"https://a/2","","","",""' in lines


def test_error_statistics(spark):
    rows = [(i, datetime(2024, 1, 1, 0, i // 60, i % 60), ["bad network", "auth"][i % 2], ["csv", "tfidf"][i % 2], "run", "low") for i in range(120)]
    r = spark.createDataFrame(rows, "id long, ts timestamp, message string, component string, operation string, severity string")
    r = r.withColumn("recoverable", errors.recoverable(F.col("message"), F.col("component")))
    s = errors.statistics(r, F.lit(datetime(2024, 1, 1, 0, 6, 10)).cast("timestamp")).first()
    assert (s.total_errors, s.recent_errors, s.recoverable_percent) == (100, 49, 50.0)
    assert {x.component: x.n for x in errors.by(r, "component").collect()} == {"csv": 50, "tfidf": 50}
    assert errors.attempts(r).where("tried").count() == 3
    rules = [("SecurityError x", "worker", False), ("boom", "worker", True), ("authentication", "store", False), ("parsing", "csv", True), ("x", "csv", False), ("Request TIMEOUT", "other", True), (None, "csv", False)]
    assert [x[0] for x in spark.createDataFrame([r[:2] for r in rules], "m string, c string").select(errors.recoverable(F.col("m"), F.col("c"))).collect()] == [r[2] for r in rules]


# ---- ingestion and stores


def test_upload(spark, tmp_path):
    body = "alpha beta gamma delta"
    lines = ["url,body", f"https://a.b/1,{body}", "", f",{body}", f"nope,{body}", f"ftp://a.b,{body}", f"https://a.b/1,{body}", "https://a.b/2,", f"https://a.b/2,{body}", "https://a.b/3,short one", "one cell", f"https://a.b/4,{body},more", "https://a.b/5," + "x" * 50001, 'https://a.b/6,"alpha ""beta""\ngamma delta"']
    path = tmp_path / "up.csv"
    path.write_text("\n".join(lines) + "\n")
    v = ingest.validate(ingest.read_csv(spark, str(path))).orderBy("line_no").collect()
    assert [(r.line_no, r.issues, r.accepted) for r in v] == [
        (2, [], True), (3, ["url_empty"], False), (4, ["url_invalid"], False), (5, ["url_scheme"], False), (6, ["url_repeated"], False), (7, ["body_empty"], False), (8, ["url_repeated"], False),
        (9, ["body_short", "few_words"], True), (10, ["columns"], False), (11, ["columns"], False), (12, ["body_long"], False), (13, [], True),
    ]
    checked = ingest.validate(ingest.read_csv(spark, str(path)))
    assert [r.line_no for r in ingest.first_issues(checked, 3).collect()] == [3, 4, 5] and ingest.quarantine(checked).count() == 9
    assert sorted(r.body for r in ingest.accepted(checked).collect()) == sorted([" ".join(body.split()), "alpha beta gamma delta", "short one"])
    with pytest.raises(ValueError):
        ingest.require_rows(checked.where("line_no = 3"))


def test_store_and_incremental_run(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    schema = "url string, title string, body string"
    targets = spark.createDataFrame([(f"https://t/{i}", None, w) for i, w in enumerate(["apple banana cherry orchard", "engine wheel brake motor", "river mountain valley forest"])], schema)
    first = spark.createDataFrame([("https://s/1", "", "apple cherry orchard picking"), ("https://s/2", "", "nothing shared whatsoever here")], schema)
    out = linking.run(store, first, targets).collect()
    assert [(r.source_url, r.target_url) for r in out] == [("https://s/1", "https://t/0")]
    list_id = store.get_or_create_list(targets)
    assert store.read("lists").count() == 3 and store.target_list(list_id).count() == 3 and store.has_processed(list_id)
    done, todo = store.split_processed(first, list_id)
    assert [r.url for r in done.collect()] == ["https://s/1"] and [r.url for r in todo.collect()] == ["https://s/2"]
    created = store.read("edges").first().created_at
    assert linking.run(store, first, targets).count() == 1 and store.read("edges").count() == 1 and store.read("edges").first().created_at == created
    assert store.cached_best(first.select("url")).count() == 1 and store.best_of("https://s/1").count() == 1
    assert store.document("https://t/0").first().preprocessed.token_count == 4
    store.merge("urls", store.read("urls"))
    assert store.read("urls").count() == 5
    store.clear_status(first.select("url"), list_id)
    assert not store.has_processed(list_id)
    store.delete_documents(spark.createDataFrame([("https://t/0",)], "url string"))
    assert store.read("edges").count() == 0 and store.read("urls").count() == 4
    assert store.corpus_changed("targets", "x") and not store.corpus_changed("targets", "x") and store.corpus_changed("targets", "y")


def test_stream_of_sources(spark, tmp_path):
    store, schema = Store(spark, f"file://{tmp_path}/store"), "url string, title string, body string"
    targets = spark.createDataFrame([("https://t/0", "", "apple banana cherry orchard"), ("https://t/1", "", "engine wheel brake motor")], schema)
    for n, body in enumerate(["apple banana pie", "motor brake wheel"]):
        spark.createDataFrame([(f"https://s/{n}", "", body)], schema).write.mode("append").json(f"{tmp_path}/in")
        link_stream(spark.readStream.schema(schema).json(f"{tmp_path}/in"), store, targets, f"{tmp_path}/check").awaitTermination()
        assert store.read("edges").count() == n + 1


# ---- stores under failure, work that fails, watching


def test_store_survives_a_crash_and_a_second_writer(spark, tmp_path, monkeypatch):
    def put(store, *urls):
        store.put_documents(spark.createDataFrame([(u, "t", "b", ["x"], "en", []) for u in urls], "url string, title string, body string, tokens array<string>, language string, issues array<string>"))

    store, other = Store(spark, f"file://{tmp_path}/s"), Store(spark, f"file://{tmp_path}/s")
    put(store, "u1", "u2")

    def crash(*_):
        raise RuntimeError("killed between the two steps")

    with monkeypatch.context() as m:
        m.setattr(Store, "_commit", crash)
        with pytest.raises(RuntimeError):
            put(store, "u3")
    assert sorted(r.url for r in store.read("urls").collect()) == ["u1", "u2"]
    (tmp_path / "s/urls/versions/000000000009").write_text("3 /half")  # a version that was never finished
    assert store.read("urls").count() == 2
    (tmp_path / "s/urls/versions/000000000009").unlink()
    commit, first = Store._commit, []

    def late(self, name, number, paths):
        if self is store and not first:
            first.append(1)
            put(other, "u4")
        return commit(self, name, number, paths)

    monkeypatch.setattr(Store, "_commit", late)
    put(store, "u5")
    assert sorted(r.url for r in store.read("urls").collect()) == ["u1", "u2", "u4", "u5"] == sorted(r.url for r in other.read("urls").collect())
    store.vacuum("urls", keep=1)
    assert store.read("urls").count() == 4 and len(list((tmp_path / "s/urls/versions").glob("0*"))) == 1
    assert store.document("u4").count() == 1 and store.document("none").count() == 0


def test_rows_that_fail_are_tried_again_and_set_apart(spark):
    def work(row):
        import os
        import tempfile

        if row["x"] is None:
            raise ValueError("empty")
        if row["x"] == 3:
            mark = f"{tempfile.gettempdir()}/weftline-test-{row['run']}"
            if not os.path.exists(mark):
                open(mark, "w").close()
                raise TimeoutError("timeout")
            os.unlink(mark)
        return None if row["x"] == 4 else {"y": row["x"] * 2}

    import uuid

    from weftline.operators import batch

    df = spark.createDataFrame([(1, "r"), (None, "r"), (3, uuid.uuid4().hex), (4, "r")], "x long, run string").coalesce(1)
    done = batch.settle_all(df, work, "y long", wait=lambda n: 0.0)
    good, bad = batch.settled(done.cache())
    assert sorted(r.y for r in good.collect()) == [2, 6] and sorted(r.error for r in bad.collect()) == ["ValueError: empty", "ValueError: no result"]
    assert {r.y: r.attempts for r in done.where("y is not null").collect()} == {2: 1, 6: 2}
    once = batch.settle_all(df.where("x is null"), work, "y long", wait=batch.exponential, again=batch.passing)
    assert [r.attempts for r in once.collect()] == [1] and batch.settle_all(df.limit(0), work, "y long").count() == 0
    assert [batch.linear(n) for n in (1, 2)] == [1, 2] and [batch.exponential(n) for n in (1, 2, 3)] == [1, 2, 4]
    assert batch.passing(ConnectionError("x")) and batch.passing(RuntimeError("Rate limit")) and not batch.passing(ValueError("x"))


def test_progress_stored_blocks_and_stop(spark):
    import threading
    import time

    from weftline.plans import monitor

    with monitor.named(spark, "own"):
        spark.range(100).repartition(3).count()
    p = monitor.progress(spark, "own").collect()
    assert p and all(r.ratio == 1.0 for r in p if r.done) and monitor.progress(spark, "none").count() == 0
    kept = spark.range(1000).cache()
    kept.count()
    assert any(r.cached == r.partitions and r.memory_bytes > 0 for r in monitor.stored(spark).collect())
    kept.unpersist()
    ended = []

    def slow():
        with monitor.named(spark, "slow"):
            try:
                spark.range(4).repartition(4).rdd.map(lambda x: time.sleep(60)).count()
            except Exception:  # noqa: BLE001
                ended.append(1)

    from pyspark import InheritableThread

    t = InheritableThread(target=slow)
    t.start()
    for _ in range(100):
        time.sleep(0.1)
        if spark.sparkContext.statusTracker().getJobIdsForGroup("slow"):
            break
    monitor.stop(spark, "slow")
    t.join(30)
    assert ended and not t.is_alive() and isinstance(t, threading.Thread)


def test_recovery_by_rule_and_attempt(spark):
    rows = [(i, "worker", "run", m, "low", i) for i, m in enumerate(["Worker terminated", "Out of memory", "x", "Worker terminated", "SecurityError"])]
    rows += [(10, "store", "w", "timeout", "low", 10), (11, "tfidf", "v", "Invalid input", "low", 11), (12, "other", "v", "network", "critical", 12), (13, "memory", "v", "network", "low", 13), (14, None, None, None, None, 14), (15, "csv", "r", "bad format", "low", 15), (16, "store", "w", "rate limit", "low", 16)]
    df = spark.createDataFrame(rows, "id long, component string, operation string, message string, severity string, ts long").withColumn("recoverable", errors.recoverable(F.col("message"), F.col("component")))
    want = {0: "restart", 1: "free memory", 2: "fail", 3: "give up", 4: "none", 10: "retry", 11: "skip", 12: "clear all", 13: "free memory", 14: "none", 15: "explain", 16: "wait"}
    assert {r.id: r.action for r in errors.recovery(df).collect()} == want


@pytest.mark.parametrize("url,issue", [("https://a.b/x y|z", None), ("HTTPS:a.b", None), ("http:\\\\a.b\\c", None), ("http://ü.example/ä", None), ("http://a.b:99999/", "url_invalid"), ("http://a b/", "url_invalid"), ("http://", "url_invalid"), ("//a.b", "url_invalid"), ("mailto:x", "url_scheme"), ("", "url_empty"), ("http://u:p@a.b:80?q", None), ("http://[::1]/", None), ("ht\ttp://a", None)])
def test_addresses_as_browsers_take_them(spark, url, issue):
    assert strings(spark, url).select(ingest.url_issue(F.col("v"))).first()[0] == issue
