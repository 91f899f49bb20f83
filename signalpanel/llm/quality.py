"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression over the whole text and every rule is
a comparison of two integer products, so the verdict is one projection with
no user function, no shuffle and no rounding.

Defined results: a NULL text has no words and fails the base rule; an empty
text likewise; repeated rows are judged alike, each on its own; columns of
the input are never read by name except the text (and id) column given.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, count_chars, words

# Symbol characters, window length and base limits of the contract.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Frequent function words of the corpus languages (English, German, French, Spanish).
STOP_WORDS = """
the of and to a in is was for that it with as on be by this are or an not from at which have
der die und das den von zu mit des auf für ist im dem nicht ein eine als auch es an werden aus er
le la les de et à en un une du que est pour dans qui sur par pas plus au ce il ne se sont
el los las y con del no su al lo como más pero sus para una por
""".split()


@dataclass(frozen=True)
class Rule:
    """``times * measure <op> limit * base`` (base: another measure)."""
    name: str
    measure: str
    op: str
    limit: int
    base: str
    times: int = 100


#: The threshold table: per cent of ``base`` (times = 100) unless said otherwise.
RULES = (
    Rule("mean word length, low", "word_chars", ">=", 2, "n_words", 1),
    Rule("mean word length, high", "word_chars", "<=", 12, "n_words", 1),
    Rule("symbols per word", "n_symbols", "<=", 10, "n_words"),
    Rule("exclamation marks per word", "n_exclamations", "<=", 30, "n_words"),
    Rule("upper-case characters", "n_upper", "<=", 30, "word_chars"),
    Rule("stop words", "n_stop_words", ">=", 3, "n_words"),
    Rule("duplicate lines", "n_dup_lines", "<=", 50, "n_lines"),
    Rule("lines that end in an ellipsis", "n_ellipsis_lines", "<=", 30, "n_lines"),
    Rule("lines that start with a bullet", "n_bullet_lines", "<=", 90, "n_lines"),
)


def compile_rules(rules: tuple[Rule, ...], measures: dict[str, Column]) -> Column:
    """One boolean expression: every rule of the table holds."""
    verdict = F.lit(True)
    for r in rules:
        left, right = measures[r.measure] * F.lit(r.times), measures[r.base] * F.lit(r.limit)
        verdict = verdict & (left <= right if r.op == "<=" else left >= right)
    return verdict


def _covered(starts: Column, width: int) -> Column:
    """Positions covered by windows of ``width`` at the ascending ``starts``."""
    steps = F.transform(starts, lambda p, i: F.least(
        F.lit(width), F.coalesce(F.get(starts, i + 1) - p, F.lit(width))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` inside struct ``row``, and all measures.

    Repeated 8-word windows are found in the row: word hashes, window hashes,
    and only for texts whose window hashes are not all different a sort of
    (hash, position) to pair equal neighbours. All steps are linear or a sort.
    """
    kept = docs.columns if keep is None else keep
    t = F.coalesce(F.col("t"), F.lit(""))
    a = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
                    F.col(f"`{text}`").alias("t"))
    a = a.select("row", t.alias("t"), words(F.col("t")).alias("w"),
                 F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n = F.size("w")
    stops = STOP_WORDS + [s[0].upper() + s[1:] for s in STOP_WORDS]
    b = a.select(
        "row", n.cast("long").alias("n_words"),
        (F.length("t") - count_chars(F.col("t"), SPACE_CHARS)).cast("long").alias("word_chars"),
        count_chars(F.col("t"), SYMBOLS).alias("n_symbols"),
        count_chars(F.col("t"), "!").alias("n_exclamations"),
        count_chars(F.col("t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        F.size(F.filter("w", lambda x: x.isin(stops))).cast("long").alias("n_stop_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$")))
        .cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]")))
        .cast("long").alias("n_bullet_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    rest = [c for c in b.columns if c != "h"]
    c = b.select(*rest, F.when(F.size("h") >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.size("h") - (WINDOW - 1)),
        lambda i: F.xxhash64(F.slice("h", i, WINDOW))))
        .otherwise(F.array().cast("array<bigint>")).alias("win"))
    c = c.select(*rest, F.when(
        F.size(F.array_distinct("win")) < F.size("win"),
        F.sort_array(F.transform("win", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
        .otherwise(F.array().cast("array<struct<x:bigint,i:int>>")).alias("by_hash"))

    def twin(s, i):
        return (s["x"].eqNullSafe(F.get(F.col("by_hash"), i - 1)["x"])
                | s["x"].eqNullSafe(F.get(F.col("by_hash"), i + 1)["x"]))

    c = c.select(*rest, F.sort_array(F.transform(F.filter("by_hash", twin), lambda s: s["i"]))
                 .alias("starts"))
    return c.select(*rest, _covered(F.col("starts"), WINDOW).alias("n_repeat_words"))


def judge(docs: DataFrame, text: str = "text", keep: list[str] | None = None,
          rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``measure`` plus ``base_failed`` and the table's verdict ``kept``."""
    m = measure(docs, text, keep)
    failed = ((F.col("n_words") < MIN_WORDS)
              | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
    named = {c: F.col(c) for c in m.columns if c != "row"}
    return m.select("*", failed.alias("base_failed"),
                    (~failed & compile_rules(rules, named)).alias("kept"))


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input rows (all their columns) that the rules keep. The partition
    number in the condition keeps the verdict a computed column: the optimizer
    would copy its whole expression into a pushed-down filter, once per use."""
    judged = judge(docs, text).select("row", "kept", F.spark_partition_id().alias("at"))
    return judged.filter(F.col("kept") & (F.col("at") >= 0)).select("row.*")


def op4_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, "text", ["doc_id"]).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


_SQL_STOPS = ", ".join(f"'{s}'" for s in STOP_WORDS + [s[0].upper() + s[1:] for s in STOP_WORDS])
_SQL_RULES = "\n     AND ".join(
    f"{r.times} * {r.measure} {r.op} {r.limit} * {r.base}" for r in RULES)

OP4_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS s
      FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - {WINDOW - 1})) AS i FROM w)),
hit AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt
        FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::BIGINT AS n_repeat_words FROM hit GROUP BY r),
ln AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclamations,
    (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
    len(list_filter(ws, lambda x: x IN ({_SQL_STOPS})))::BIGINT AS n_stop_words,
    len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')))::BIGINT AS n_ellipsis_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]')))::BIGINT AS n_bullet_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (r) JOIN ln USING (r) LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND {_SQL_RULES}) AS kept
FROM f
"""
