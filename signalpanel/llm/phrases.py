"""Phrase collocation mining on a weighted de Bruijn graph.

Texts are cut into pieces and words. The graph's edges are the longest grams
(``max_words`` words), its nodes the grams one word shorter; an edge leads from
its first words to its last ones. Each position of a piece gives one edge, cut
short by the piece's end where fewer words are left; these short rows are the
piece-end corrections.

1. Slabs of documents count their distinct words; the words that reach the
   count threshold in their lang (no phrase has others) get dense numbers, and
   every slab takes back the numbers of its own. A rarer word ends a gram as a
   piece's end does.
2. Slabs sum their edges; Spark adds them up to the edges' weights.
3. Counts of shorter grams are flows: what leaves a node, plus the pieces that
   end there, is the node's count, and so on down to words. Each level is the
   grouped prefix of the level above, and of the longer grams just those that
   reach the count threshold are kept on the way.
4. Unary paths are compacted: a node whose whole flow comes in by one edge and
   leaves by one edge only ever occurs inside the longer gram, so it is dropped
   before anything is scored. Paths are contracted by pointer doubling, in
   joins, over the edges that reach the threshold.
5. Candidates are scored at their weakest cut in exact decimals and ranked.

Defined results: a NULL or empty text has no words; a NULL lang is ``und``;
rows are counted each, whatever their id, so repeated rows count once each;
ties of the score go to the higher count, then the phrase in byte order; a
lang without candidates has no rows; an empty table gives no rows; other
columns are not looked at. A piece may be as long as a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, stored
from .slabs import cut_slabs, store_slabs

# Fixed values of the contract.
MAX_WORDS, MIN_COUNT, TOP, INSIDE_PERCENT, SCALE = 3, 10, 2000, 50, 1_000_000
NO_LANG = "und"
#: Parts in which a lang's candidates are ranked before they meet.
_PARTS = 64

_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_LETTERS = bytes(range(ord("A"), ord("Z") + 1))
#: Piece ends become line ends, tabs become spaces, A-Z become a-z.
_PLAIN = bytes.maketrans(_PIECE_ENDS + b"\t" + _LETTERS, b"\n" * len(_PIECE_ENDS) + b" " + _LETTERS.lower())

_SLAB = "slab long, langs array<string>, words array<string>, counts array<long>, codes binary"
_ARROW = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]


def _read_slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slab: its distinct (lang, word) pairs with their counts, and its
    words in text order as places in that list, 0 at the end of each piece
    (places start at 1)."""
    import zstandard

    for number, rows in cut_slabs(batches):
        plain = [t.translate(_PLAIN).replace(b"\n", b" \n ") + b" \n" for t in
                 pc.fill_null(rows.column("t").combine_chunks(), "").cast(pa.binary()).to_pylist()]
        lists = pc.split_pattern(pa.array(plain, pa.binary()).cast(pa.string()), " ")
        lang = rows.column("lang").combine_chunks().dictionary_encode()
        flat = lists.flatten().dictionary_encode()
        n_langs, n_words = len(lang.dictionary), len(flat.dictionary)
        # (word, lang) as one number, in as few bytes as hold it
        kind = np.int32 if n_words * n_langs < 2 ** 31 else np.int64
        code = flat.indices.to_numpy(zero_copy_only=False).astype(kind) * kind(n_langs)
        code += np.repeat(lang.indices.to_numpy(zero_copy_only=False).astype(kind), np.diff(lists.offsets.to_numpy()))
        del plain, lists
        empty, end = (pc.index_in(pa.array([x]), value_set=flat.dictionary)[0].as_py() for x in ("", "\n"))
        if empty is not None:
            code = code[code // n_langs != empty]
        if n_words * n_langs <= 4 * len(code):  # a table of all pairs is no larger than the words themselves
            distinct, n = np.arange(n_words * n_langs), np.bincount(code, minlength=n_words * n_langs)
        else:
            distinct, code, n = np.unique(code, return_inverse=True, return_counts=True)
        is_end = distinct // n_langs == end
        held = (n > 0) & ~is_end
        place = np.where(held, np.cumsum(held), 0).astype("<i4")[code]  # the piece end is 0
        distinct = distinct[held]
        cells = [number, lang.dictionary.take(pa.array(distinct % n_langs)).to_pylist(),
                 flat.dictionary.take(pa.array(distinct // n_langs)).to_pylist(), n[held],
                 zstandard.ZstdCompressor(level=1).compress(place.tobytes())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c], _ARROW[k]) for k, c in enumerate(cells)], names=[c.split(" ")[0] for c in _SLAB.split(", ")])


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with dense numbers from 1 in ``id``, in the order of the tasks:
    each task's count gives the next one's start (one row per task)."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = stored(rows.select("*", F.spark_partition_id().alias("task"), place.alias("place")))
    before = W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    starts = (placed.groupBy("task").agg(F.count("*").alias("n"))
              .select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    return placed.join(F.broadcast(starts), "task").select(*rows.columns, (F.col("start") + F.col("place") + 1).alias("id"))


def _cells(max_words: int) -> list[str]:
    """Columns of a gram: two word numbers (of 31 bits) to a long, 0 where there is no word."""
    return [f"c{k}" for k in range((max_words + 1) // 2)]


def _word(k: int) -> Column:
    """The k-th word of the cells."""
    cell = F.col(f"c{k // 2}")
    return F.shiftright(cell, 32) if k % 2 == 0 else cell.bitwiseAND(F.lit(0xFFFFFFFF))


def _prefix(m: int, max_words: int) -> list[Column]:
    """The cells with only their first m words."""
    out = []
    for k, name in enumerate(_cells(max_words)):
        cell = F.col(name) if 2 * k + 2 <= m else F.shiftleft(F.shiftright(name, 32), 32) if 2 * k + 1 == m else F.lit(0).cast("long")
        out.append(cell.alias(name))
    return out


def _sum_edges(max_words: int):
    def run(key, slab: pa.Table, own: pa.Table) -> pa.Table:
        """Distinct edges of a slab and their counts; 0 behind the end of a piece, or of its frequent words."""
        import zstandard

        codes = np.frombuffer(zstandard.ZstdDecompressor().decompress(slab.column("codes")[0].as_py()), "<i4")
        ids = np.zeros(int(codes.max(initial=0)) + 1, np.int32)
        ids[own.column("place").to_numpy()] = own.column("id").to_numpy()
        seq = np.concatenate([ids[codes], np.zeros(max_words, np.int32)])
        del codes
        at = np.flatnonzero(seq)
        columns, alive = [seq[at]], np.ones(len(at), bool)
        for k in range(1, max_words):
            w = np.where(alive, seq[at + k], 0)
            alive = w > 0
            columns.append(w)
        # number the prefixes one word at a time, in order: pairs of (prefix, word) fit a long
        prefix = columns[0]
        for w in columns[1:]:
            words, word = np.unique(w, return_inverse=True)
            _, prefix = np.unique(np.unique(prefix, return_inverse=True)[1].astype(np.int64) << 32 | word, return_inverse=True)
        _, first, n = np.unique(prefix, return_index=True, return_counts=True)
        if max_words % 2:
            columns.append(np.zeros(len(at), np.int32))
        packed = [columns[k][first].astype(np.int64) << 32 | columns[k + 1][first] for k in range(0, max_words, 2)]
        return pa.table({**dict(zip(_cells(max_words), packed)), "n": n.astype(np.int64)})
    return run


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS,
                min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(grams, words, totals)``: ``gram`` (array of word numbers, 1 to
    ``max_words``) and its count ``f`` for every gram with at least
    ``min_count``; ``lang, word, id`` of the words in them; ``lang, n`` of all words."""
    d = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit(NO_LANG)).alias("lang"), F.col(f"`{text}`").alias("t"))
    slabs = store_slabs(d.mapInArrow(_read_slabs, _SLAB))
    held = slabs.select(F.col("slab").alias("taker"), F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("place", "x"))
    held = held.select("taker", (F.col("place") + 1).alias("place"), F.col("x.langs").alias("lang"), F.col("x.words").alias("word"),
                       F.col("x.counts").alias("n"))
    totals = held.groupBy("lang").agg(F.sum("n").alias("n"))
    # a word has one row per slab: its total and its first slab in the same pass
    of_word = W.partitionBy("lang", "word")
    often = stored(held.select("taker", "place", "lang", "word", F.sum("n").over(of_word).alias("f"), F.min("taker").over(of_word).alias("first"))
                   .filter(F.col("f") >= min_count))
    # frequent words first: small numbers make small shuffles
    words = stored(_numbered(often.filter("taker = first").orderBy(F.col("f").desc(), "lang", "word").select("lang", "word")))
    own = often.join(words, ["lang", "word"]).select("taker", "place", "id")
    cells = _cells(max_words)
    edges = (slabs.select("slab", "codes").groupBy("slab").cogroup(own.groupBy("taker"))
             .applyInArrow(_sum_edges(max_words), ", ".join(f"{c} long" for c in [*cells, "n"])))
    # slabs are summed already: no second sum in front of the exchange
    counts = edges.repartition(*cells).groupBy(*cells).agg(F.sum("n").alias("n")).withColumn("done", F.lit(False))
    for m in range(max_words - 1, 0, -1):
        # every gram passes its weight to its first m words; those of m + 1 words that reach the count stay as well
        flow = F.struct(*_prefix(m, max_words), F.col("n"), F.lit(False).alias("done"))
        whole = F.struct(*[F.col(c) for c in cells], F.col("n"), F.lit(True).alias("done"))
        frequent = (_word(m) > 0) & (F.col("n") >= min_count)
        kept = F.when(F.col("done"), F.array(whole)).when(frequent, F.array(flow, whole)).otherwise(F.array(flow))
        counts = (counts.select(F.explode(kept).alias("x")).select("x.*")
                  .groupBy(*cells, "done").agg(F.sum("n").alias("n")))
    gram = F.filter(F.array(*[_word(k) for k in range(max_words)]), lambda w: w > 0)
    return stored(counts.select(gram.alias("gram"), F.col("n").alias("f"))), words, totals


def unary_paths(grams: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """Per edge that reaches the count: ``gram, f, head`` (the first edge of
    its compacted path) and ``step`` (its place there, from 0). Pointer
    doubling: the rounds grow with the logarithm of the longest path."""
    size = F.size("gram")
    edges = grams.filter((size == max_words) & (F.col("f") >= min_count))
    nodes = grams.filter((size == max_words - 1) & (F.col("f") >= min_count)).select(F.col("gram").alias("node"), F.col("f").alias("flow"))
    into = edges.select(F.slice("gram", 2, max_words - 1).alias("node"), F.col("gram").alias("before"), F.col("f").alias("f_in"))
    out = edges.select(F.slice("gram", 1, max_words - 1).alias("node"), F.col("gram").alias("gram"), F.col("f").alias("f_out"))
    # an edge that carries a node's whole flow is its only one on that side, and no piece begins or ends there
    joint = (nodes.join(into, "node").filter("f_in = flow").join(out, "node").filter("f_out = flow").select("gram", "before"))
    links = cut(edges.join(joint, "gram", "left").select(
        "gram", "f", F.coalesce("before", "gram").alias("head"), F.col("before").isNotNull().cast("int").alias("step")))
    while True:
        up = links.filter("step > 0").select(F.col("gram").alias("head"), F.col("head").alias("further"), F.col("step").alias("more"))
        moved = links.join(up, "head", "left")
        links = cut(moved.select("gram", "f", F.coalesce("further", "head").alias("head"),
                                 (F.col("step") + F.coalesce("more", F.lit(0))).alias("step"), F.col("more").isNotNull().alias("moved")))
        if links.filter("moved").isEmpty():
            return links.drop("moved")
        links = links.drop("moved")


def compact_paths(grams: DataFrame, words: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """The compacted graph: per path ``path`` (its word numbers in a row) and
    ``f``, the count of the path and of every longest gram on it. A path is
    bounded by the longest piece."""
    by_head = unary_paths(grams, max_words, min_count).groupBy("head", "f").agg(
        F.sort_array(F.collect_list(F.struct("step", F.element_at("gram", -1).alias("w")))).alias("x"))
    return by_head.select(F.concat(F.slice("head", 1, max_words - 1), F.col("x.w")).alias("path"), "f")


def _exact(x: str):
    return F.col(x).cast("decimal(15,0)")


def scored_candidates(grams: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT,
                      inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """``gram, a, l, r, score`` of the candidates that no longer one hides."""
    frequent = grams.filter((F.size("gram") > 1) & (F.col("f") >= min_count)).withColumnRenamed("f", "a")
    if 1 < max_words - 1 and inside_percent <= 100:
        # nodes inside a path lie in a longer gram of the same count
        inner = (unary_paths(grams, max_words, min_count).filter("step > 0")
                 .select(F.slice("gram", 1, max_words - 1).alias("gram")).distinct())
        tested = frequent.join(inner, "gram", "left_anti")
    else:
        tested = frequent
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.size("gram") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.size("gram") - m + 1), lambda k: F.slice("gram", k, m))))
    longer = (frequent.filter(F.size("gram") > 2).select(F.explode(parts).alias("gram"), "a")
              .groupBy("gram").agg(F.max("a").alias("longer")))
    tested = (tested.join(longer, "gram", "left")
              .filter(F.coalesce(100 * F.col("longer") < inside_percent * F.col("a"), F.lit(True))).drop("longer"))
    cuts = tested.select("gram", "a", F.explode(F.sequence(F.lit(1), F.size("gram") - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("gram", F.lit(1), F.col("k")).alias("left"),
                       F.slice("gram", F.col("k") + 1, F.size("gram") - F.col("k")).alias("right"))
    counts = grams.select(F.col("gram").alias("part"), "f")
    cuts = (cuts.join(counts.withColumnsRenamed({"part": "left", "f": "l"}), "left")
            .join(counts.withColumnsRenamed({"part": "right", "f": "r"}), "right"))
    cuts = cuts.select("gram", "a", "k", "l", "r", (F.lit(SCALE).cast("decimal(7,0)") * _exact("a") * _exact("a")).alias("top"),
                       (_exact("l") * _exact("r")).alias("bottom")).withColumn("score", F.expr("top div bottom"))
    weakest = cuts.groupBy("gram", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    return weakest.select("gram", "a", "x.l", "x.r", "x.score")


def mine_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS,
                 min_count: int = MIN_COUNT, top: int = TOP, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """Each lang's ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    grams, words, total = gram_counts(docs, text, lang, max_words, min_count)
    scored = stored(scored_candidates(grams, max_words, min_count, inside_percent))
    spelled = (scored.select("gram", F.posexplode("gram").alias("pos", "id")).join(words, "id")
               .groupBy("gram").agg(F.first("lang").alias("lang"), F.array_join(F.transform(
                   F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    best = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    # a lang's first rows are among the first of each of its parts, so the last ranking meets a bounded number of rows
    part = F.pmod(F.xxhash64("phrase"), F.lit(_PARTS))
    ranked = scored.join(spelled, "gram").withColumn("part", part)
    for keys in (["lang", "part"], ["lang"]):
        place = F.row_number().over(W.partitionBy(*keys).orderBy(*best)).cast("long")
        ranked = ranked.withColumn("rank", place).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark, sf_dir):
    return mine_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '{NO_LANG}') AS lang,
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT doc, lang, unnest(generate_series(1, len(ps))) AS piece, unnest(ps) AS t FROM d),
q AS (SELECT doc, lang, piece, regexp_extract_all(t, '[^\x20\x09]+') AS ws FROM p),
w AS (SELECT lang, unnest(ws) AS a, unnest(ws[2:] || [NULL]) AS b, unnest(ws[3:] || [NULL, NULL]) AS c FROM q WHERE len(ws) > 0),
f1 AS (SELECT lang, a, count(*) AS f FROM w WHERE a IS NOT NULL GROUP BY ALL),
f2 AS (SELECT lang, a, b, count(*) AS f FROM w WHERE b IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, a, b, c, count(*) AS f FROM w WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
hide AS (SELECT lang, a, b, max(f) AS f FROM (SELECT lang, a, b, f FROM f3 UNION ALL SELECT lang, b, c, f FROM f3) GROUP BY ALL),
cuts AS (
  SELECT f2.lang, f2.a || ' ' || f2.b AS phrase, f2.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.a = f2.a JOIN f1 y ON y.lang = f2.lang AND y.a = f2.b
  LEFT JOIN hide h ON h.lang = f2.lang AND h.a = f2.a AND h.b = f2.b
  WHERE f2.f >= {MIN_COUNT} AND (h.f IS NULL OR 100 * h.f < {INSIDE_PERCENT} * f2.f)
  UNION ALL SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, f3.f, 1, x.f, y.f
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.a = f3.a JOIN f2 y ON y.lang = f3.lang AND y.a = f3.b AND y.b = f3.c
  UNION ALL SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, f3.f, 2, x.f, y.f
  FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.a = f3.a AND x.b = f3.b JOIN f1 y ON y.lang = f3.lang AND y.a = f3.c),
s AS (SELECT *, (({SCALE}::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n.n AS n, score
FROM o JOIN n USING (lang) WHERE rank <= {TOP}
"""
