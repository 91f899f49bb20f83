"""Partial-matching scores against a plain trie, and what a model must obey."""

import math
import zlib

import pytest
from pyspark.sql import functions as F

from signalpanel.llm import ppm, slabs
from tests.conftest import SF_SMALL

from . import brute
from .test_edges import SCHEMA, _texts


def _held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def _same(got, want):
    key = lambda r: (str(r[0]), r[2], r[3], round(r[5], 4), round(r[6], 4))
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert tuple(g[:5]) == tuple(w[:5])
        assert math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9, abs_tol=1e-9)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in ppm.op11_ppm(spark, SF_SMALL).collect()]
    _same(got, brute.ppm(rows, [_held(i) for i, _ in rows], ppm.ORDER))
    held = {r[0] for r in got if r[1]}
    size = sum(len((t or "").encode()) + 1 for i, t in rows if i in held)
    assert held and -sum(r[6] for r in got if r[1]) / size * math.log2(10) < 3.5  # bits a byte of texts not learnt


@pytest.mark.parametrize("order", [0, 1, 3, 5])
def test_edges(spark, order, monkeypatch):
    rows = [(i, t) for i, t in _texts() if len(t or "") < 4_000] + [(101, "ÀÉ\x00\x1f x"), (103, "Q" * 50)]
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], SCHEMA).repartition(3)
    for c in ("id", "t", "slab", "g", "word", "held", "c"):
        docs = docs.withColumn(c, F.lit(1))
    flag = ppm.held_out(F.col("doc_id"))
    want = brute.ppm(rows, [_held(i) for i, _ in rows], order)
    _same([tuple(r) for r in ppm.score_texts(docs, flag, order=order).collect()], want)
    if order == 3:
        monkeypatch.setattr(slabs.cut_slabs, "__defaults__", ("t", 500, 2))
        monkeypatch.setattr(ppm, "_WINDOW", 64)
        _same([tuple(r) for r in ppm.score_texts(docs, flag, order=order).collect()], want)
        _same([tuple(r) for r in ppm.score_texts(docs, F.lit(True), order=order).collect()], brute.ppm(rows, [True] * len(rows), order))
        assert ppm.score_texts(docs.filter("false"), flag, order=order).count() == 0


def test_probabilities_add_up(spark):
    """Over all 257 next symbols of any context, known or not, the scores are a distribution."""
    rows = [(1, "abracadabra abc"), (2, "cab bad")]
    order = 2
    nodes = spark.createDataFrame(
        [(g, 0) for g in range(1)], "g long, c long").filter("false")
    seen = {}
    for _, t in rows:
        s = [257] * order + list(t.encode()) + [256]
        for p in range(order, len(s)):
            g = s[p - 2] << 18 | s[p - 1] << 9 | s[p]
            seen[g] = seen.get(g, 0) + 1
    contexts = [(257, 257), (97, 98), (98, 114), (120, 97), (120, 120), (257, 122)]
    asked = {c[0] << 18 | c[1] << 9 | x for c in contexts for x in range(257)}
    grams = nodes.unionByName(spark.createDataFrame([(g, seen.get(g, 0)) for g in asked | set(seen)], "g long, c long"))
    got = {r["g"]: r["logp"] for r in ppm.gram_scores(grams, order).collect()}
    for c in contexts:
        assert math.isclose(sum(10 ** got[c[0] << 18 | c[1] << 9 | x] for x in range(257)), 1.0, rel_tol=1e-9)


def test_adaptive(spark):
    rows = [(1, "abab" * 50), (2, None), (3, "x")]
    got = dict(tuple(r) for r in ppm.adaptive_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert math.isclose(got[2], -math.log10(257))
    assert math.isclose(got[3], 2 * -math.log10(257) + math.log10(1 / 2) + math.log10(257 / 256), rel_tol=1e-9)
    assert got[1] > -40  # 200 repeated symbols cost little
