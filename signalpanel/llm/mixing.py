"""Mixing sources to target weights with exact budgets.

Every row gets a hash-random key. Within each source the keys are cut into
equal ranges; one grouped sum per (source, range) and a running sum over the
ranges give each range its start, and a running sum inside the range gives
each row its start in the source's random order. A source's target is cut
from that order exactly: whole epochs first, then the rows in front of the
cut, and the row at the cut in part.

Defined results: NULL text has size 0; a NULL source is a source of its own,
last in the order of sources; a source of size 0 has target 0; repeated rows
are rows of their own (equal keys are ordered by id and size, so equal rows
are interchangeable); an empty table gives an empty result. The table of
sources has one row per distinct source and is the only thing that a single
window task holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, cut, n_words, packed, unpack

# Fixed values of the contract: weights in the order of sources, and the repeat limit.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 7
KEY_BITS = 60
#: Rows that one range of keys holds on average (in the largest source).
ROWS_PER_RANGE = 256


def random_key(id_: Column, seed: int = SEED) -> Column:
    """60 hash bits of the id as a long, the same on every run and engine."""
    text = F.concat(F.coalesce(id_.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Target per source from ``(skey, source_size)``: shares by weight, none
    above ``max_epochs`` times its size, the excess reshared by weight. The
    sources that reach their limit are a prefix in the order limit / weight."""
    order = W.orderBy("skey")
    n = len(weights)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]),
                     ((F.row_number().over(order) - 1) % n + 1).cast("int"))
    a = totals.select("*", w.cast("double").alias("w"),
                      (F.col("source_size") * max_epochs).cast("double").alias("cap"))
    every = W.partitionBy()
    by_level = W.orderBy(F.col("cap") / F.col("w"), "skey")
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    a = a.select("*", F.sum("source_size").over(every).cast("double").alias("total"),
                 F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"),
                 F.sum("w").over(by_level.rowsBetween(0, W.unboundedFollowing)).alias("w_from"))
    a = a.select("*", ((F.col("total") - F.col("cap_before")) * F.col("w")
                       >= F.col("cap") * F.col("w_from")).alias("full"))
    a = a.select("*",
                 F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0)).alias("cap_full"),
                 F.sum(F.when(~F.col("full"), F.col("w"))).over(every).alias("w_open"))
    return a.select("skey", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(
        F.col("w") * (F.col("total") - F.col("cap_full")) / F.col("w_open")).alias("target"))


def _sized(docs: DataFrame, id_col: str, text: str, source: str, seed: int) -> DataFrame:
    src = F.col(f"`{source}`").cast("string")
    return docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.when(src.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), src)).alias("skey"),
        n_words(F.col(f"`{text}`")).alias("size"),
        random_key(F.col(f"`{id_col}`"), seed).alias("key"),
        F.xxhash64(F.col(f"`{text}`")).alias("th"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("rest"),
        F.col(f"`{text}`").alias("t"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
             weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
             rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Per input row: ``id``, ``size``, ``source_size``, ``target``, ``epochs``
    (whole repetitions), ``partial`` (words of one more, cut repetition) and ``taken``."""
    sized = cut(_sized(docs, id_col, text, source, seed).drop("rest", "t"))
    return _placed(sized, sized, weights, max_epochs, rows_per_range)


def _placed(sized: DataFrame, narrow: DataFrame, weights, max_epochs: int, rows_per_range: int) -> DataFrame:
    """Place the rows of ``sized``; ``narrow`` has the same rows for the sums."""
    totals = narrow.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    most = totals.agg(F.max("rows")).first()[0] or 0
    ranges = max(1, -(-most // rows_per_range))
    # range number of a key: floor(key * ranges / 2^60), on the upper bits to stay in a long
    upper = 2 ** 30
    in_range = F.floor(F.floor(F.col("key") / F.lit(upper)) * ranges / F.lit(2 ** (KEY_BITS - 30))).cast("long")
    running = W.partitionBy("skey").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = (narrow.withColumn("range", in_range).groupBy("skey", "range").agg(F.sum("size").alias("range_size"))
              .select("skey", "range", F.coalesce(F.sum("range_size").over(running), F.lit(0)).alias("range_start"))
              .join(source_targets(totals.drop("rows"), weights, max_epochs), "skey"))
    inside = (W.partitionBy("skey", "range").orderBy("key", "id", "size", "th")
              .rowsBetween(W.unboundedPreceding, -1))
    placed = sized.withColumn("range", in_range).join(starts, ["skey", "range"]).select(
        "*", (F.col("range_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("start"))
    epochs = F.when(F.col("source_size") > 0, F.least(
        F.lit(max_epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    placed = placed.select("*", epochs.alias("epochs"))
    rest = F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")
    partial = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("start")))
    partial = F.when(F.col("epochs") < max_epochs, partial).otherwise(F.lit(0).cast("long"))
    placed = placed.select("*", partial.alias("partial"))
    return placed.withColumn("taken", F.col("epochs") * F.col("size") + F.col("partial"))


def _shorten(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Unpack texts; rows with ``first`` set keep that many words."""
        for b in batches:
            texts = unpack(b.column("t")).to_pylist()
            for k, n in enumerate(b.column("first").to_pylist()):
                if n is not None:
                    texts[k] = b" ".join(texts[k].encode("utf-8").split(None, n)[:n]).decode("utf-8")
            rest = b.column("rest").flatten()
            names = [f.name for f in b.schema.field("rest").type]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *rest], names=[text, *names])
    return run


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
               weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
               rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """The mix itself, with the input's columns: each row once per whole epoch
    and once more if it is in front of the cut; the one row at each source's
    cut keeps just its first words, joined by one space. The sums are taken
    from short rows; texts go through one shuffle, compressed."""
    bounded_batches(docs.sparkSession)
    sized = _sized(docs, id_col, text, source, seed)
    p = _placed(packed(sized, "t"), cut(sized.drop("rest", "t")), weights, max_epochs, rows_per_range)
    copies = F.col("epochs") + F.when(F.col("partial") > 0, 1).otherwise(0)
    p = p.filter(copies > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    shorter = (F.col("epoch") > F.col("epochs")) & (F.col("partial") < F.col("size"))
    rows = p.select("rest", "t", F.when(shorter, F.col("partial")).alias("first"))
    columns = [text, *[c for c in docs.columns if c != text]]
    schema = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in columns)
    return rows.mapInArrow(_shorten(text), schema).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_mix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return plan_mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP3_SQL = rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':{SEED}'), 1, {KEY_BITS // 4}))::BIGINT AS key
  FROM documents),
s AS (
  SELECT skey, sum(size)::BIGINT AS source_size, (3 * sum(size))::DOUBLE AS cap,
    [5, 2, 1][((row_number() OVER (ORDER BY skey) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY skey),
l AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    sum(w) OVER (ORDER BY cap / w, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_from FROM s),
f AS (SELECT *, (total - cap_before) * w >= cap * w_from AS is_full FROM l),
c AS (SELECT *, coalesce(sum(cap) FILTER (is_full) OVER (), 0) AS cap_full, sum(w) FILTER (NOT is_full) OVER () AS w_open FROM f),
t AS (SELECT skey, source_size, CASE WHEN is_full THEN cap ELSE w * (total - cap_full) / w_open END AS target FROM c),
p AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END::BIGINT AS epochs,
    coalesce(sum(size) OVER (PARTITION BY skey ORDER BY key, doc_id, size
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t USING (skey))
SELECT doc_id, size, source_size, target,
  (epochs * size + CASE WHEN epochs < 3 THEN greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - start)) ELSE 0 END)::BIGINT AS taken
FROM p
"""
