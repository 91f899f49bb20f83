"""SMOTE / borderline-SMOTE oversampling of the positive class.

Synthetic rows ``a + λ·(b − a)`` between a seed minority row ``a`` and one
of its k nearest minority neighbours ``b``. Borderline-1 keeps only seeds
whose m-neighbourhood among all training rows is at least half but not
entirely majority ("danger"). Draw j picks its seed, neighbour and λ from
``md5(seed:j:…)``; neighbours come from the exact blocked kNN search, so
nothing is collected and the result is reproducible.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import split as C


def _u(seed: str, j, tag: str):
    """Uniform [0, 1) from md5(seed:j:tag)."""
    h = F.md5(F.concat_ws(":", F.lit(seed), j.cast("string"), F.lit(tag)))
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / float(16 ** 12)


#: Draws that one row of the plan makes at a time.
_DRAWS = 1 << 16


def smote(train: DataFrame, k: int = 5, ratio: float = 0.25, variant: str = "borderline",
          m_neighbors: int = 10, seed: int = 42, y: str = "y", row_id: str = "row_id",
          col: str = "x", by: Sequence[str] = ()) -> DataFrame:
    """Synthetic positive rows of every ``by`` group of train rows (``part`` =
    train, ``row_id`` prefixed ``smote:``, no subject); none where the plan (C8)
    says no. All groups share one plan, one search for the borderline seeds and
    one for the neighbours. For fitting only: a synthetic row is never scored."""
    from ..plans.models import knn_neighbors
    by = list(by)
    same = by or [F.lit(1).alias("_all")]
    plan = train.groupBy(*same).agg(F.count_if(F.col(y) == 1).alias("_pos"), F.count_if(F.col(y) == 0).alias("_neg"))
    new = F.floor(F.lit(ratio) * F.col("_neg")).cast("long") - F.col("_pos")
    plan = plan.filter((F.col("_pos") >= 2) & (F.col("_pos") < F.col("_neg")) & (F.col("_pos") / F.col("_neg") < ratio) & (new > 0))
    plan = plan.select(*(by or ["_all"]), F.least(F.lit(k), F.col("_pos") - 1).alias("_kk"), new.alias("_new"))
    key = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in [*by, row_id]])  # as the search names its queries
    minority = train.filter(F.col(y) == 1)
    seeds = minority
    if variant == "borderline":
        nb = knn_neighbors(train, minority, m_neighbors, row_id=row_id, col=col, y=y, exclude_self=True, by=by)
        danger = (nb.groupBy("_qid").agg(F.count_if(F.col("_y") == 0).alias("_nm"))
                  .filter((F.col("_nm") >= m_neighbors / 2.0) & (F.col("_nm") < m_neighbors)).select("_qid"))
        seeds = minority.withColumn("_qid", key).join(danger, on="_qid", how="left_semi").drop("_qid")
    sseed = f"{seed}:smote"
    ranked = C.dealt_rank(seeds.withColumn("_h", F.md5(F.concat(F.lit(sseed), F.col(row_id).cast("string"))))
                          .withColumn("_b", C.rank_block(F.col("_h"))), ["_b", "_h"], name="_sr", part=by)
    ensure_checkpoint_dir(train.sparkSession)
    ranked = ranked.checkpoint()
    sizes = ranked.groupBy(*same).agg(F.count(F.lit(1)).alias("_seeds"))
    j = F.col("_j")
    # a plan row makes blocks of draws, which are dealt out before they are made
    blocks = (plan.join(sizes, by or ["_all"]).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_new") - 1, F.lit(_DRAWS).cast("long"))).alias("_from"))
              .repartition(*(by or []), "_from"))
    draws = blocks.select("*", F.explode(F.sequence("_from", F.least(F.col("_from") + _DRAWS, F.col("_new")) - 1)).alias("_j")).select(
        *by, "_j", F.floor(_u(sseed, j, "seed") * F.col("_seeds")).cast("long").alias("_sr"),
        (F.floor(_u(sseed, j, "nb") * F.col("_kk")) + 1).cast("int").alias("_rank"), _u(sseed, j, "lam").alias("_lam"))
    near = knn_neighbors(minority, ranked, k, row_id=row_id, col=col, y=None, exclude_self=True, by=by)
    a = ranked.select(*by, "_sr", key.alias("_qid"), F.col(col).alias("_a"))
    b = minority.select(*by, F.col(row_id).cast("string").alias("_id"), F.col(col).alias("_b"))
    syn = (draws.join(a, on=[*by, "_sr"]).join(near.select("_qid", "_rank", "_id"), on=["_qid", "_rank"])
           .join(b, on=[*by, "_id"]))
    x_new = F.zip_with("_a", "_b", lambda u, v: u + F.col("_lam") * (v - u))
    made = {row_id: F.concat(F.lit("smote:"), F.col("_j").cast("string")), col: x_new, y: F.lit(1), "part": F.lit("train"),
            **{c: F.col(c) for c in by}}
    # a synthetic row belongs to no subject or window: all other columns are NULL
    return syn.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in train.schema.fields])
