"""The pipeline against its stages' plain versions, and its columns."""

import corpus_pipeline
from signalpanel.llm import decontam
from tests.conftest import SF_SMALL

from . import brute


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, SF_SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        if k < 4:
            assert docs.columns == columns
        if k == 1:
            want = {c for _, _, c in brute.classes([(r["doc_id"], brute.simhash(r["text"])) for r in before])}
            assert sorted(r["doc_id"] for r in after) == sorted(want)
        if k == 2:
            index = decontam.Index([(0, t) for t in items])
            want = [r["doc_id"] for r in before if not index.matches([r["text"]])]
            assert sorted(r["doc_id"] for r in after) == sorted(want)
            assert not any(decontam.normalise(t) in decontam.normalise(r["text"]) for t in items for r in after)
        if k == 3:
            total = lambda rows: sum(len(brute.words(r["text"])) for r in rows)
            assert abs(total(after) - total(before)) <= 40
        if k == 4:
            assert len(after) == len(before) and len({(r["start"]) for r in after}) == len(after)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_SMALL).collect())) == sorted(map(tuple, after))
