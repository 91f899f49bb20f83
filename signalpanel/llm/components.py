"""Connected components of a link table by alternating star contraction.

A large-star round links every node's larger neighbours to its smallest
neighbour, a small-star round does so for the smaller ones; both keep the
components and turn each into a star around its smallest node in a
logarithmic number of rounds. A round is a grouped minimum (combined before
the shuffle) and a join of the links with it, whose exchanges adaptive
execution can split at a node of high degree. Each round is cut by a
checkpoint in the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(links: DataFrame):
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node in ``links``: the smallest node that
    it reaches. Self-links and repeated links are harmless; no links, no rows."""
    every = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    stars = cut(every.filter("a <> b").distinct())
    last = _state(stars)
    while last[0]:
        both = stars.unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .filter("a <> b").distinct())
        large = cut(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        stars = cut(small.select("a", F.col("m").alias("b"))
                    .unionAll(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
                    .distinct())
        now = _state(stars)
        if now == last:
            break
        last = now
    return (stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionAll(stars.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct())
