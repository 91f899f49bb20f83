"""Phrase mining against a plain count of all grams."""

import random

import pytest
from pyspark.sql import functions as F

from signalpanel.llm import phrases, slabs
from tests.conftest import SF_SMALL

from . import brute
from .test_edges import SCHEMA, _rows, _texts


def test_query(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text", "lang").collect()
    assert _rows(phrases.op12_phrases(spark, SF_SMALL)) == sorted(brute.phrases([tuple(r) for r in docs]), key=str)


def _mixed():
    r = random.Random(7)
    boiler = "all rights are reserved by the owner of this long licence line"
    rows = [(t, None if (i or 0) % 4 == 0 else "en" if (i or 0) % 3 else "und") for i, t in _texts() if len(t or "") < 50_000]
    for k in range(60):
        prose = " ".join(r.choice("abcdefgh") for _ in range(60))
        rows.append((f"{prose}. {boiler}! {boiler.upper()}, é {prose[:30]}\tx\x0by\x1cz", r.choice(["en", "de", None])))
    return rows


@pytest.mark.parametrize("max_words,min_count", [(2, 3), (3, 10), (4, 5), (6, 4)])
def test_edges(spark, max_words, min_count, monkeypatch):
    monkeypatch.setattr(slabs.cut_slabs, "__defaults__", ("t", 3000, 10))
    rows = _mixed()
    docs = spark.createDataFrame([(1, t, g, None, 0) for t, g in rows], SCHEMA).repartition(3)
    for c in ("t", "slab", "id", "gram", "f", "word", "w0", "n"):
        docs = docs.withColumn(c, F.lit(1))
    got = phrases.mine_phrases(docs, max_words=max_words, min_count=min_count, top=50)
    assert _rows(got) == sorted(brute.phrases(rows, max_words, min_count, 50), key=str)
    if max_words == 3:
        assert phrases.mine_phrases(docs.filter("false")).count() == 0
        assert phrases.mine_phrases(docs.withColumn("text", F.lit(None).cast("string"))).count() == 0


def test_paths(spark):
    """A line that always occurs whole is one path; its inner grams are in it."""
    line = [f"l{k}" for k in range(21)]
    texts = [" ".join(line)] * 4 + [f"x{k} l3 y{k}" for k in range(3)]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    grams, words, _ = phrases.gram_counts(docs, min_count=2)
    names = {r["id"]: r["word"] for r in words.collect()}
    paths = [[names[i] for i in r["path"]] for r in phrases.compact_paths(grams, words, min_count=2).collect()]
    assert paths == [line]
    steps = phrases.unary_paths(grams, min_count=2).agg(F.max("step"), F.count("*")).first()
    assert tuple(steps) == (18, 19)
