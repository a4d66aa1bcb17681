"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import random

import pytest
from pyspark.sql import functions as F

from latticeon.llm import hamming, licenses, neardup, packing, pii, pipeline, quality, secrets, sentencepieces, tokencount, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, spans string, piece int, start long, length long, id long, r string, s string, salt int, own int, fp string, kept boolean, component_id long, n_shingles long"
LONG = " ".join(random.Random(1).choice(["alpha", "beta", "gamma", "delta", "the", "of"]) + str(i % 977) for i in range(60_000))
TEXTS = [None, "", "   \n\t", "word", "The same old text of the day, and it is for all.", "The same old text of the day, and it is for all.", LONG, "a" * 200_000, "Ünïcödé 中文 \U0001f600 text of the world " * 3]
PATH = tokencount.tokenizer_path


def rows():
    out = [(i, t, "en", "x", len(t or ""), 1, 0.5, "q", 1, 2, 3, 4, "r", "s", 5, 6, "f", True, 7, 8) for i, t in enumerate(TEXTS)]
    out.append((None, "A row without an id, of the usual kind, with some words.", None, None, None, *[None] * 15))
    out.append(out[4])  # a repeated row
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(9)] + [(None, None, 1), (3, 1, None)], "doc_id long, quality int, toxic int")


def operators(labels):
    return {
        "secrets": secrets.scan_secrets,
        "sentencepieces": lambda d: sentencepieces.segment(d, PATH(sentencepieces.MODEL)),
        "licenses": licenses.scan_licenses,
        "toxicity": lambda d: toxicity.score_toxicity(d, labels),
        "quality": quality.judge_quality,
        "pii": pii.find_personal_data,
        "neardup": neardup.near_duplicates,
        "tokencount": lambda d: tokencount.count_tokens(d, PATH(tokencount.MODEL)),
    }


@pytest.mark.parametrize("name", ["secrets", "sentencepieces", "licenses", "toxicity", "quality", "pii", "neardup", "tokencount"])
def test_row_for_each_row(spark, docs, labels, name):
    f = operators(labels)[name]
    got = f(docs).collect()
    assert len(got) == len(TEXTS) + 2
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows())
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(tuple(str(x) for x in r))
    assert len(by[4]) == 1, "repeated rows are treated alike"
    none, empty = next(r for r in got if r["doc_id"] == 0), next(r for r in got if r["doc_id"] == 1)
    assert [x for x in none[1:]] == [x for x in empty[1:]] or name in ("toxicity", "neardup")
    assert f(docs.limit(0)).count() == 0
    assert f(docs.limit(0)).columns == f(docs).columns


def test_packing(spark, docs):
    got = packing.pack_documents(docs, PATH(packing.MODEL)).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in rows()}
    assert sum(1 for r in got if r["doc_id"] == 4) == 2
    check_packing(got)
    assert packing.pack_documents(docs.limit(0), PATH(packing.MODEL)).collect() == []


def check_packing(got, capacity=packing.CAPACITY):
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= capacity


def test_hamming(spark):
    e = spark.createDataFrame([(0, [1.0] * 64), (20, None), (None, [1.0] * 64), (3, []), (4, [1.0, None, float("nan")]), (5, [1.0] * 64), (5, [1.0] * 64)], "vec_id long, embedding array<float>")
    got = hamming.top_k(e, e.filter("vec_id % 20 = 0"), 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["found_id"], r["distance"]) for r in got] == [(0, 1, 0, 0), (0, 2, 5, 0), (0, 3, 5, 0)]
    assert hamming.top_k(e.limit(0), e.limit(0), 3).count() == 0


def test_stages(spark, docs, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    d = docs
    for k, stage in enumerate((pipeline.drop_toxic, pipeline.drop_poor, pipeline.drop_copies, pipeline.redact)):
        out = stage(spark, d, str(tmp_path))
        assert out.columns == docs.columns
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(str(tmp_path / str(k)))
        d = spark.read.parquet(str(tmp_path / str(k)))
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert d.filter("doc_id IS NULL").count() == 1
    assert d.filter("doc_id IN (0, 1, 2, 3)").count() == 0
    check_packing(pipeline.pack(spark, d, str(tmp_path)).collect())


def test_redaction_keeps_null_and_clean(spark):
    d = spark.createDataFrame([(1, None, 0), (2, "clean text", 10), (3, "mail a.b@c.org now", 0)], "doc_id long, text string, n_chars int")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pipeline.redact(spark, d, "").collect()}
    assert got == {1: (None, None), 2: ("clean text", 10), 3: ("mail [EMAIL] now", 16)}


def test_keep_good_agrees_with_verdict(spark, docs):
    kept = sorted(str(r["doc_id"]) for r in quality.keep_good(docs).select("doc_id").collect())
    assert kept == sorted(str(r["doc_id"]) for r in quality.judge_quality(docs).filter("kept").collect())


def test_all_nulls(spark):
    d = spark.createDataFrame([(None, None, None, None, None)] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, f in operators(empty).items():
        assert f(d).count() == 3, name
    assert toxicity.score_toxicity(d, empty).agg(F.max("score")).first()[0] == 0.0
