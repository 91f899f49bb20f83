"""Line dedup: explode normalised lines, hash, count distinct documents per
hash, drop lines over the threshold, reassemble by position.

Lines are exploded, normalised and hashed (128 bits) batch by batch with Arrow
kernels in the task that reads them; only hashes and positions are shuffled.
Counting distinct documents is Spark's two-step distinct aggregate, so a line that a third of
all documents holds is counted in many tasks; marking its lines is an inner
join of plain exchanges, which adaptive execution splits by size.

Defined results: a NULL or empty text is one empty line; documents are told
apart by id, a NULL id counting as one document, smaller than all others;
rows with the same id and text give the same result, once per row; rows with
the same id and different texts are reassembled each on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, bounded_batches, packed, stored, string_hashes, unpack

# Fixed values of the contract.
MIN_CHARS = 20
MIN_DOCS = 3

_NO_ID = -(2 ** 63)


def _emit_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines whose key is long enough: document, position, two hashes."""
        for b in batches:
            lists = pc.split_pattern(b.column("t"), "\n")
            keys = pc.ascii_lower(pc.utf8_trim(lists.flatten(), characters=SPACE_CHARS))
            offsets = np.asarray(lists.offsets.to_numpy(), np.int64)
            offsets = offsets - offsets[0]
            long = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), min_chars).to_numpy(zero_copy_only=False))
            owner = np.searchsorted(offsets, long, "right") - 1
            h1, h2 = string_hashes(keys.take(pa.array(long)))
            own = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc").take(own), b.column("th").take(own), pa.array((long - offsets[owner]).astype(np.int32)),
                 pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=["doc", "th", "pos", "h1", "h2"])
    return run


def _drop_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts and the positions to drop, to the lines that stay."""
    for b in batches:
        cols = {"id": [], "n_lines": [], "n_dropped": [], "kept": []}
        for i, text, gone in zip(b.column("id").to_pylist(), unpack(b.column("t")).to_pylist(),
                                 b.column("gone").to_pylist()):
            lines = text.split("\n")
            if gone:
                away = set(gone)
                text = "\n".join(x for k, x in enumerate(lines) if k not in away)
            cols["id"].append(i)
            cols["n_lines"].append(len(lines))
            cols["n_dropped"].append(len(gone or ()))
            cols["kept"].append(text)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols["id"], pa.int64()), pa.array(cols["n_lines"], pa.int64()),
             pa.array(cols["n_dropped"], pa.int64()), pa.array(cols["kept"], pa.string())],
            names=list(cols))


def _digest_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _drop_lines(batches):
        sha = [hashlib.sha256(x.encode("utf-8")).hexdigest() for x in b.column("kept").to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sha, pa.string())],
                                         names=["id", "n_lines", "n_dropped", "kept_sha256"])


def _marked(docs: DataFrame, id_col: str, text: str, min_chars: int, min_docs: int) -> DataFrame:
    """One row per document row: ``id``, packed text ``t`` and positions ``gone``."""
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                    F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    d = d.select("id", F.coalesce("id", F.lit(_NO_ID)).alias("doc"), F.xxhash64("t").alias("th"), "t")
    lines = stored(d.select("doc", "th", "t").mapInArrow(
        _emit_lines(min_chars), "doc long, th long, pos int, h1 long, h2 long"))
    often = (lines.groupBy("h1", "h2").agg(F.countDistinct("doc").alias("n"), F.max("doc").alias("last"))
             .filter(F.col("n") >= min_docs).select("h1", "h2", "last"))
    gone = (lines.join(often, ["h1", "h2"]).filter("doc < last")
            .groupBy("doc", "th").agg(F.collect_set("pos").alias("gone")))
    return (packed(d, "t")
            .join(gone, ["doc", "th"], "left").select("id", "t", "gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per document row: ``id, n_lines, n_dropped, kept`` (the text that stays)."""
    bounded_batches(docs.sparkSession)
    return _marked(docs, id_col, text, min_chars, min_docs).mapInArrow(
        _drop_lines, "id long, n_lines long, n_dropped long, kept string")


def op5_line_dedup(spark, sf_dir):
    bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return (_marked(docs, "doc_id", "text", MIN_CHARS, MIN_DOCS)
            .mapInArrow(_digest_kept, "id long, n_lines long, n_dropped long, kept_sha256 string")
            .withColumnRenamed("id", "doc_id"))


OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(generate_series(1, len(ls))) AS pos, unnest(ls) AS line FROM d),
k AS (SELECT r, doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {MIN_CHARS}
      GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
j AS (SELECT k.*, o.last IS NOT NULL AND k.doc_id < o.last AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY r, doc_id
"""
