"""Cross-tokenizer alignment against both libraries and a plain version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalpanel.llm import align, slabs
from tests.conftest import SF_SMALL

from . import brute
from .test_edges import SCHEMA, _texts

P = pytest.importorskip("public_tokenizers")
PATHS = [P.path(v) for v in (align.VOCABULARY_A, align.VOCABULARY_B)]
ODD = ["<|endoftext|> a<|endoftext|>", "<s>x</s><unk>", "a▁b", " two  spaces ", "\ttab\r\nline\n\n", "日本語テキスト 🎉🎉", "a\x00b", "naïve é",
       "1234567890" * 5, "don't we'll I'VE", "=" * 300, " " * 50_000 + "x", "x " * 60_000]


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def _same(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (str(r[0]), *r[1:7])), sorted(want, key=lambda r: (str(r[0]), *r[1:7]))):
        assert g[:7] == w[:7] and w[7] in (None, g[7])


def test_query(spark, models):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    _same([tuple(r) for r in align.op13_align(spark, SF_SMALL).collect()],
          brute.align([tuple(r) for r in docs.collect()], *models))


def test_edges(spark, models, monkeypatch):
    rows = [(i, t) for i, t in _texts() if len(t or "") < 40_000] + [(100 + k, t) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], SCHEMA).repartition(3)
    for c in ("id", "t", "slab", "pair", "pairs", "n", "best"):
        docs = docs.withColumn(c, F.lit(1))
    want = brute.align(rows, *models)
    _same([tuple(r) for r in align.align_tokens(docs, *PATHS).collect()], want)
    monkeypatch.setattr(slabs.cut_slabs, "__defaults__", ("t", 1000, 3))  # many slabs: same rows
    _same([tuple(r) for r in align.align_tokens(docs, *PATHS).collect()], want)
    assert align.align_tokens(docs.filter("false"), *PATHS).count() == 0


def test_groups(spark):
    docs = spark.createDataFrame([(1, "hello world 日本"), (2, None)], "doc_id long, text string")
    got = {r["id"]: r["groups"] for r in align.aligned_groups(docs, *PATHS).collect()}
    one = align.Aligner(*PATHS)
    a, b = one.encode("hello world 日本")
    assert got[2] == [] and [x for g in got[1] for x in g["a"]] == a and [x for g in got[1] for x in g["b"]] == b
    for g in got[1]:
        assert b"".join(one.a.bytes[x] for x in g["a"]) == b"".join(one.b.bytes[x] for x in g["b"])


def test_ids_equal_the_library(models):
    one = align.ByteLevel(PATHS[0])
    texts = ODD + [f" a{chr(c)}a1{chr(c)}1! {chr(c)} " for c in range(1, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    assert [one.encode(t) for t in texts] == [e.ids for e in models[0].encode_batch(texts, add_special_tokens=False)]
    assert "".join(map(chr, range(65, 70))).encode() == bytes(align.byte_alphabet()[c] for c in "ABCDE")


def test_overlaps_brute():
    import random

    r = random.Random(2)
    for _ in range(300):
        n = r.randrange(1, 30)
        ends = [sorted({n, *r.sample(range(1, n + 1), r.randrange(0, n))}) for _ in range(2)]
        ids = [np.arange(len(e)) for e in ends]
        at = [align.end_index(np.array(e), n) for e in ends]
        got = [(p >> 24, p & 0xFFFFFF) for p in align.linked(ids[0], at[0], ids[1], at[1]).tolist()]
        starts = [[0, *e[:-1]] for e in ends]
        assert got == [(x, y) for x in range(len(ends[0])) for y in range(len(ends[1]))
                       if starts[0][x] < ends[1][y] and starts[1][y] < ends[0][x]]
