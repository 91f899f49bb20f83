"""Subject-safe folds, splits and class balancing.

Randomness is ``md5(seed:id)``, never ``rand()``: reproducible across runs,
engines and executor loss. Folds are *dealt*: subjects are ordered by
``(stratum, md5)`` and fold = global rank mod k, which balances every
stratum to within one subject. The global rank is computed without a
single-partition window: rows are hashed into buckets, per-bucket counts
(a table of strata × buckets rows) are prefix-summed, and each row's rank
is its bucket offset plus its rank inside the bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the md5 that make a rank block: 65,536 blocks per part, so a
#: part of ten billion rows has blocks of some 150,000 rows.
BLOCK_DIGITS = 4


def rank_block(h: Column, digits: int = BLOCK_DIGITS) -> Column:
    """Block number of an md5 text, in the order of the text."""
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("int") if digits else F.lit(0)


def digits_for(rows: int, per_block: int = 50_000) -> int:
    """Digits that cut a part of ``rows`` into blocks of about ``per_block``."""
    digits = 0
    while rows > per_block * 16 ** digits:
        digits += 1
    return digits


def md5_key(seed: int | str, col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def dealt_rank(df: DataFrame, order: Sequence[Column | str], part: Sequence[str] = (),
               name: str = "_rank") -> DataFrame:
    """Dense 0-based rank of every row by ``order`` within ``part``.

    ``order[0]`` is a *block* key (it must already contain a hash bucket so
    that blocks are small); the rank window runs per (part, block) and the
    block offsets come from the prefix sum over a count table with one row
    per non-empty (part, block). That table is joined back on the keys of the
    rank window, so the rows are shuffled once; how it is joined is left to
    Spark. No window ever spans a whole stratum.
    """
    o = [F.col(c) if isinstance(c, str) else c for c in order]
    x = df.withColumn("_o0", o[0])
    cnt = x.groupBy(*part, "_o0").agg(F.count(F.lit(1)).alias("_c"))
    w_off = (Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))) \
        .orderBy("_o0").rowsBetween(Window.unboundedPreceding, -1)
    offs = cnt.withColumn("_off", F.coalesce(F.sum("_c").over(w_off), F.lit(0))).drop("_c")
    if len(o) > 1:
        inner = F.row_number().over(Window.partitionBy(*part, "_o0").orderBy(*o[1:])) - 1
    else:
        inner = F.lit(0)
    return (x.withColumn("_in", inner).join(offs, on=[*part, "_o0"])
            .withColumn(name, (F.col("_off") + F.col("_in")).cast("long"))
            .drop("_o0", "_in", "_off"))


def deal_folds(subjects: DataFrame, k: int, seed: int, strata: Sequence[Column | str] = (),
               subject: str = "subject_id", part: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """Order subjects by (strata…, md5 bucket, md5, ties…) and deal folds
    round-robin. Adds ``fold`` (0..k-1)."""
    h = md5_key(seed, subject)
    x = subjects.withColumn("_h", h).withColumn("_b", rank_block(F.col("_h")))
    s = [F.col(c) if isinstance(c, str) else c for c in strata]
    key = F.struct(*[c.alias(f"_s{i}") for i, c in enumerate(s)], F.col("_b").alias("_bb")) if s \
        else F.col("_b")
    x = x.withColumn("_key", key)
    ranked = dealt_rank(x, ["_key", "_h", *ties], part=part)
    kk = F.lit(k) if isinstance(k, int) else k
    return ranked.withColumn("fold", (F.col("_rank") % kk).cast("int")).drop("_h", "_b", "_key", "_rank")


def grouped_folds(windows: DataFrame, k: int = 5, seed: int = 42, y: str = "y",
                  subject: str = "subject_id") -> DataFrame:
    """Stratified grouped k-fold — folds are assigned per subject
    (no subject in two folds), stratified by the subject's class."""
    subj = windows.groupBy(subject).agg(F.max(y).alias("_cls"))
    return deal_folds(subj, k, seed, strata=["_cls"], subject=subject).select(subject, "fold")


def multilabel_folds(subject_labels: DataFrame, labels: Sequence[str], k: int = 3,
                     seed: int = 42, subject: str = "subject_id") -> DataFrame:
    """Multi-label stratified folds over subjects: subjects ordered by
    their label combination and md5, dealt round-robin, so every combination
    (and hence every label) is spread evenly over the folds."""
    combo = F.concat_ws("", *[F.col(l).cast("int").cast("string") for l in labels])
    return deal_folds(subject_labels.withColumn("_combo", combo), k, seed,
                      strata=["_combo"], subject=subject).select(subject, "fold")


def _deal_quota(subjects: DataFrame, cls: Sequence[str], extras: dict[tuple, list[int]], k: int, seed: int, subject: str) -> DataFrame:
    """Folds by class: in md5 order inside a class, whole rounds over all folds,
    then the class's last subjects one by one to the folds in ``extras``."""
    spark = subjects.sparkSession
    kinds = dict(subjects.dtypes)
    table = [(*c, i, f) for c, fs in extras.items() for i, f in enumerate(fs)]
    extra = spark.createDataFrame(table, ", ".join([*(f"`{c}` {kinds[c]}" for c in cls), "_i long", "_f int"]))
    h = subjects.withColumn("_h", md5_key(seed, subject)).withColumn("_b", rank_block(F.col("_h")))
    n = subjects.groupBy(*cls).agg(F.count(F.lit(1)).alias("_n"))
    ranked = dealt_rank(h, ["_b", "_h"], part=list(cls)).join(F.broadcast(n), list(cls))  # one row per class
    whole = F.col("_n") - F.col("_n") % k
    ranked = ranked.withColumn("_i", F.when(F.col("_rank") >= whole, F.col("_rank") - whole))
    return ranked.join(F.broadcast(extra), [*cls, "_i"], "left").select(
        subject, F.coalesce("_f", (F.col("_rank") % k).cast("int")).alias("fold"))


def balance_extras(sizes: dict[tuple[int, int], int], k: int) -> dict[tuple[int, int], list[int]]:
    """Folds of the last ``n mod k`` subjects of each (negative, positive)
    window count: the most uneven counts first, each to the fold that leaves
    the classes' shares of the folds most alike (ties: the smaller fold, the
    earlier one)."""
    held = [[sum(c[i] * (n // k) for c, n in sizes.items()) for i in range(2)] for _ in range(k)]
    total = [max(1, sum(c[i] * n for c, n in sizes.items())) for i in range(2)]

    def spread(f, c):
        out = 0.0
        for i in range(2):
            share = [(h[i] + (c[i] if g == f else 0)) / total[i] for g, h in enumerate(held)]
            mean = sum(share) / k
            out += (sum((x - mean) ** 2 for x in share) / k) ** 0.5
        return round(out / 2, 12)

    extras: dict[tuple[int, int], list[int]] = {c: [] for c in sizes}
    for c in sorted(sizes, key=lambda c: (-abs(c[0] - c[1]), -c[0], -c[1])):
        for _ in range(sizes[c] % k):
            f = min(range(k), key=lambda f: (spread(f, c), sum(held[f]), f))
            held[f] = [held[f][i] + c[i] for i in range(2)]
            extras[c].append(f)
    return extras


def balanced_folds(windows: DataFrame, k: int = 5, seed: int = 42, y: str = "y", subject: str = "subject_id") -> DataFrame:
    """C1 by windows: folds of whole subjects whose shares of the negative and
    of the positive windows are alike. The greedy placement runs on the
    histogram of (negative, positive) counts per subject, which is what the
    driver gets: one row per distinct pair, whatever the number of subjects."""
    subj = windows.groupBy(subject).agg(F.count_if(F.col(y) == 0).alias("_neg"), F.count_if(F.col(y) == 1).alias("_pos"))
    sizes = {(r["_neg"], r["_pos"]): r["n"] for r in subj.groupBy("_neg", "_pos").agg(F.count(F.lit(1)).alias("n")).collect()}
    return _deal_quota(subj, ["_neg", "_pos"], balance_extras(sizes, k), k, seed, subject)


def iterative_extras(sizes: dict[str, int], k: int) -> dict[str, list[int]]:
    """Folds of the last ``n mod k`` subjects of each label combination (a
    string of 0 and 1), by iterative stratification: the label with the fewest
    subjects left goes first, each of its subjects to the fold that wants the
    label most (ties: wants most subjects, the earlier fold)."""
    left = {c: n % k for c, n in sizes.items() if n % k}
    extras: dict[str, list[int]] = {c: [] for c in sizes}
    width = len(next(iter(sizes), ""))
    want = [[sum(r for c, r in left.items() if c[j] == "1") / k for j in range(width)] for _ in range(k)]
    room = [sum(left.values()) / k] * k
    while left:
        open_ = {j: sum(r for c, r in left.items() if c[j] == "1") for j in range(width)}
        rarest = min((j for j in open_ if open_[j]), key=lambda j: (open_[j], j), default=None)
        for c in sorted(c for c in left if rarest is None or c[rarest] == "1"):
            for _ in range(left.pop(c)):
                f = min(range(k), key=lambda f: (-round(want[f][rarest], 9) if rarest is not None else 0, -round(room[f], 9), f))
                extras[c].append(f)
                room[f] -= 1
                for j in range(width):
                    want[f][j] -= c[j] == "1"
    return extras


def stratified_folds(subject_labels: DataFrame, labels: Sequence[str], k: int = 3, seed: int = 42, subject: str = "subject_id") -> DataFrame:
    """C2 by iterative stratification: quotas of (label combination, fold) from
    the combination counts (one row per combination on the driver), then
    dealing in md5 order inside a combination."""
    combo = F.concat_ws("", *[F.col(l).cast("int").cast("string") for l in labels])
    subj = subject_labels.select(subject, combo.alias("_combo"))
    sizes = {r["_combo"]: r["n"] for r in subj.groupBy("_combo").agg(F.count(F.lit(1)).alias("n")).collect()}
    extras = {(c,): fs for c, fs in iterative_extras(sizes, k).items()}
    return _deal_quota(subj, ["_combo"], extras, k, seed, subject)


def split(windows: DataFrame, folds: DataFrame, fold: int, subject: str = "subject_id") -> DataFrame:
    """``part`` = test for the subjects of ``fold``, train otherwise."""
    return (windows.join(folds.select(subject, F.col("fold").alias("_f")), on=subject)
            .withColumn("part", F.when(F.col("_f") == fold, "test").otherwise("train")).drop("_f"))


def all_splits(windows: DataFrame, folds: DataFrame, k: int, subject: str = "subject_id") -> DataFrame:
    """C3 for every outer fold at once: rows replicated k times with
    ``fold`` (the outer fold) and ``part``."""
    f = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold")
    x = windows.join(folds.select(subject, F.col("fold").alias("_f")), on=subject).select("*", f)
    return x.withColumn("part", F.when(F.col("_f") == F.col("fold"), "test").otherwise("train")).drop("_f")


def disjoint_check(splits: DataFrame, subject: str = "subject_id", by: Sequence[str] = ("fold",)) -> DataFrame:
    """C3 invariant: number of subjects in both train and test per fold (0)."""
    tr = splits.filter(F.col("part") == "train").select(*by, subject).distinct()
    te = splits.filter(F.col("part") == "test").select(*by, subject).distinct()
    both = tr.intersect(te)
    return (splits.select(*by).distinct()
            .join(both.groupBy(*by).agg(F.count(F.lit(1)).alias("n_overlap")), on=list(by), how="left")
            .select(*by, F.coalesce("n_overlap", F.lit(0)).alias("n_overlap")))


def inner_folds(subject_labels: DataFrame, outer: DataFrame, labels: Sequence[str], k_outer: int,
                k_inner: int = 3, seed: int = 42, subject: str = "subject_id") -> DataFrame:
    """C4: inner folds over each outer fold's train subjects, with
    min(k_inner, n_train) splits, stratified by label combination.
    Returns ``(fold, subject, inner_fold)``."""
    f = F.explode(F.sequence(F.lit(0), F.lit(k_outer - 1))).alias("fold")
    tr = (subject_labels.join(outer.select(subject, F.col("fold").alias("_of")), on=subject)
          .select("*", f).filter(F.col("_of") != F.col("fold")).drop("_of"))
    n = tr.groupBy("fold").agg(F.count(F.lit(1)).alias("_n"))
    combo = F.concat_ws("", *[F.col(l).cast("int").cast("string") for l in labels])
    tr = tr.join(F.broadcast(n), on="fold").withColumn("_combo", combo)  # one row per outer fold
    kk = F.least(F.lit(k_inner), F.col("_n"))
    h = md5_key(f"{seed}:inner", subject)
    x = tr.withColumn("_h", h).withColumn(
        "_key", F.struct("_combo", rank_block(h).alias("_b")))
    r = dealt_rank(x, ["_key", "_h"], part=["fold"])
    return r.select("fold", subject, (F.col("_rank") % kk).cast("int").alias("inner_fold"))


def valid_folds(rows: DataFrame, by: Sequence[str] = ("fold", "label"), y: str = "y") -> DataFrame:
    """Groups with both classes present (others are skipped)."""
    return (rows.groupBy(*by).agg(F.countDistinct(y).alias("n_classes"))
            .withColumn("valid", F.col("n_classes") == 2))


def downsample(train: DataFrame, tol: float = 0.2, replacement: bool = True, seed: int = 42,
               by: Sequence[str] = (), y: str = "y", row_id: str = "row_id") -> DataFrame:
    """When |n0 − n1| / max(n0, n1) > tol, keep the minority and draw
    n_min majority rows (with replacement: draw j picks majority rank
    ``md5(seed:j) mod n_maj``; without: the n_min smallest md5 ranks).
    Balanced groups pass unchanged."""
    by = list(by)
    cnt = train.groupBy(*by).agg(F.count_if(F.col(y) == 0).alias("_n0"), F.count_if(F.col(y) == 1).alias("_n1"))
    cnt = cnt.withColumns({
        "_maj": F.when(F.col("_n0") > F.col("_n1"), 0).otherwise(1),
        "_nmin": F.least("_n0", "_n1"), "_nmaj": F.greatest("_n0", "_n1"),
        "_do": (F.abs(F.col("_n0") - F.col("_n1")) / F.greatest("_n0", "_n1") > tol)})
    x = train.join(cnt, on=by) if by else train.crossJoin(F.broadcast(cnt))  # cnt: one row per group
    keep = x.filter(~F.col("_do") | (F.col(y) != F.col("_maj")))
    maj = x.filter(F.col("_do") & (F.col(y) == F.col("_maj")))

    def numbered(df):
        h = df.withColumn("_h", md5_key(seed, row_id))
        return dealt_rank(h.withColumn("_k", rank_block(F.col("_h"))), ["_k", "_h"], part=by)

    ranked = numbered(maj)
    if not replacement:
        picked = ranked.filter(F.col("_rank") < F.col("_nmin")).drop("_h", "_k", "_rank")
    else:
        # one draw per minority row: its rank is the number of the draw
        minority = x.filter(F.col("_do") & (F.col(y) != F.col("_maj")))
        draws = numbered(minority).select(
            *by, (F.conv(F.substring(md5_key(seed, F.col("_rank")), 1, 12), 16, 10).cast("long")
                  % F.col("_nmaj")).alias("_pick")).withColumnRenamed("_pick", "_rank").withColumn("_j", F.lit(0))
        picked = ranked.join(draws, on=[*by, "_rank"]).drop("_h", "_k", "_rank", "_j")
    cols = train.columns
    return keep.select(*cols).unionByName(picked.select(*cols))


def class_weights(train: DataFrame, by: Sequence[str] = (), y: str = "y") -> DataFrame:
    """Balanced weights n / (2 · n_class) per group and class (only
    when both classes are present; otherwise 1)."""
    c = train.groupBy(*by, y).agg(F.count(F.lit(1)).alias("_nc"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    return c.select(*by, y, F.when(F.count(F.lit(1)).over(w) == 2,
                                   F.sum("_nc").over(w) / (F.lit(2.0) * F.col("_nc")))
                    .otherwise(F.lit(1.0)).alias("weight"))


def smote_plan(train: DataFrame, by: Sequence[str] = (), y: str = "y", k: int = 5,
               ratio: float = 0.25) -> DataFrame:
    """Per group: k = min(k, minority − 1) (none below 2), and the
    target ratio when positives are the minority and below ``ratio``."""
    c = train.groupBy(*by).agg(F.count_if(F.col(y) == 1).alias("n_pos"), F.count_if(F.col(y) == 0).alias("n_neg"))
    m = F.least("n_pos", "n_neg")
    kk = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0) & (m >= 2), F.least(F.lit(k), m - 1))
    strat = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0) & (F.col("n_pos") < F.col("n_neg"))
                   & (F.col("n_pos") / F.greatest(F.col("n_neg"), F.lit(1)) < ratio), F.lit(ratio))
    return c.select(*by, "n_pos", "n_neg", kk.cast("int").alias("smote_k"), strat.alias("smote_ratio"),
                    (kk.isNotNull() & strat.isNotNull()).alias("smote_used"))
