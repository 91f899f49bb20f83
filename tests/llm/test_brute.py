"""Whole queries against plain versions on the smallest tables."""

import pytest

from signalpanel.llm import queries
from tests.conftest import SF_SMALL

from . import brute


def _rows(spark, name="documents", cols=("doc_id", "text")):
    return [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/{name}.parquet").select(*cols).collect()]


def _run(spark, name):
    return [tuple(r) for r in queries.QUERIES[name](spark, SF_SMALL).collect()]


def test_simhash(spark):
    want = brute.classes([(i, brute.simhash(t)) for i, t in _rows(spark)])
    got = _run(spark, "op1_simhash")
    assert sorted(got) == sorted((i, f"{fp:016x}", c) for i, fp, c in want)


def test_substring(spark):
    assert sorted(_run(spark, "op7_substring_dedup")) == sorted(brute.substring(_rows(spark)))


def test_lines(spark):
    assert sorted(_run(spark, "op5_line_dedup")) == sorted(brute.lines(_rows(spark)))


def test_tokens(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sorted(_run(spark, "op6_token_ids")) == sorted(brute.tokens(_rows(spark), model))


def test_decontamination(spark):
    from signalpanel.llm.decontam import EDIT_PERCENT, edit_budget, normalise, pieces_of

    assert EDIT_PERCENT > 0
    docs, items = _rows(spark), _rows(spark, "benchmark", ("item_id", "text"))
    got = {(r[0], r[1]) for r in _run(spark, "op9_decontaminate")}
    whole = {(d, i) for d, t in docs for i, b in items if normalise(b) in normalise(t)}
    assert whole and whole <= got
    # pairs outside: no piece of the item is within its edit budget (a sample of short documents)
    short = [(d, normalise(t)) for d, t in docs if len(t or "") < 400][:12]
    for d, t in short:
        for i, b in items[:6]:
            near = any(brute.edit_distance_in(p, t) <= edit_budget(len(p)) for p in pieces_of(normalise(b)))
            assert near == ((d, i) in got)
