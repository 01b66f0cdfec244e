"""Each stage of the pipeline held against what it says of its own input."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import decontaminate, mixing, quality, simhash, tokens

from .helpers import prose
from .test_operators import brute_hits

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA).cache()
        out.append(docs)
    return out


def test_names_and_columns(stages):
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    for s in stages[:-1]:
        assert s.columns == stages[0].columns


def test_quality_keeps_clean_documents(spark, stages):
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1].select("doc_id").collect()}
    clean, junk = {i for i, (q, t) in labels.items() if q and not t}, {i for i, (q, _) in labels.items() if not q}
    assert len(clean & kept) >= len(clean) - 1 and len(junk & kept) <= 0.1 * len(junk)


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_one_of_each_near_group_stays(stages):
    rows = [(r.doc_id, shingle_set(r.text)) for r in stages[1].collect()]
    label = [i for i, _ in rows]
    near = [[j for j, (_, b) in enumerate(rows) if len(a & b) >= 0.8 * len(a | b)] for _, a in rows]
    while (new := [min(label[j] for j in n) for n in near]) != label:
        label = new
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(set(label))


def test_planted_documents(spark):
    """Toxic ones, near copies and benchmark passages go; plain ones, odd columns and odd rows stay as they are."""
    plain = [(i, prose(i, 120), "s") for i in range(200)]
    labels = [(i, 1, 0) for i in range(120)] + [(300 + i, 1, 1) for i in range(20)]
    toxic = [(300 + i, f"{prose(i + 900, 60)} vileword {prose(i + 950, 60)}", "t") for i in range(40)]
    words = [t.split() for _, t, _ in plain[:10]]
    for w in words:
        w[60] = "changed"
    near = [(400 + i, " ".join(w), "s") for i, w in enumerate(words)]
    benchmark = [(i, prose(7000 + i, 30)) for i in range(3)]
    bad = [(500 + i, f"{prose(i + 800, 50)} {t} {prose(i + 850, 50)}", "s") for i, t in benchmark]
    rest = [(600, None, None), (None, prose(77, 80), "s"), (700, plain[50][1], "s")]
    schema = "doc_id long, text string, source string"
    docs = spark.createDataFrame(plain + toxic + near + bad + rest, schema).withColumn("log_weight", F.lit(1)).withColumn("of", F.lit("x")).withColumn("fp", F.lit(2))
    q = quality.keep(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = {r.doc_id for r in q.collect()}
    assert not kept & set(range(300, 340)) and len(set(range(200)) - kept) <= 2 and q.columns == docs.columns
    d = simhash.deduplicate(docs, shingle=5, similarity=0.8)
    assert {r.doc_id for r in d.collect()} == {r.doc_id for r in docs.collect()} - set(range(400, 410)) - {700} and d.columns == docs.columns
    c = decontaminate.decontaminate(docs, spark.createDataFrame(benchmark, "item_id long, text string"))
    assert {r.doc_id for r in c.collect()} == {r.doc_id for r in docs.collect()} - {500, 501, 502} and c.columns == docs.columns
    assert mixing.mix(docs).columns == docs.columns


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0


def test_contaminated_documents_go(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = sorted(r[0] for r in brute_hits([(r.doc_id, r.text) for r in stages[2].collect()], items) if not r[5])
    assert sorted(r.doc_id for r in stages[3].collect()) == want


def test_mix_and_tokens(stages):
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(stages[3]).collect()}
    assert Counter(r.doc_id for r in stages[4].collect()) == +Counter(plan)
    from tokenizers import Tokenizer

    own, at = Tokenizer.from_file(tokens.tokenizer_file()), 0
    text = {r.doc_id: r.text for r in stages[4].collect()}
    for r in sorted(stages[5].collect(), key=lambda r: r.start):
        ids = own.encode(text[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_run_is_the_stages_in_turn(spark, stages):
    assert sorted(corpus_pipeline.run(spark, DATA).collect()) == sorted(stages[5].collect())
