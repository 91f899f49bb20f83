"""Language-model scoring by partial matching over a byte-context trie.

The model's symbols are the bytes of the lower-cased (A-Z) text and one end; a
text begins after ``order`` marks that are context only. The trie holds, for
every context of up to ``order`` symbols in the training texts, how often each
symbol followed. A symbol is coded at the longest context that knows it, with
probability ``count / (total + distinct)``; each longer context is left by an
escape, ``distinct / (total + distinct)``. Symbols that the longer context
knows are excluded from the totals below it (they would have been coded
there), and what no context knows is spread evenly over the symbols that the
empty context has not seen.

With every training symbol counted in all its contexts, a context's symbols
are among those of its next shorter one. So an exclusion takes away one sum per
context, whatever the symbol: the counts that its symbols have one level below.
The probability of a symbol is then a function of the last ``order + 1``
symbols, and the trie is a few grouped tables: slabs of documents count their
distinct grams, Spark adds them up, rolls each level up into the next shorter
one, scores each distinct gram once (levels joined by context, only unknown
grams going on), and every slab takes back the grams and words that it holds.
All tables grow with the corpus and stay distributed.

``adaptive_scores`` is the same model without a corpus: it starts empty for
each document and counts each symbol after coding it.

The base score is a word unigram with half a count added: words
``[^\\x20\\x09-\\x0D]+`` and one end per document.

Defined results: a NULL or empty text is one end; a NULL id belongs to the
training part (it has no checksum); every row is a document of its own, so
repeated rows are learnt, and scored, once each; without any training row the
base is zero and each symbol costs log10(257); an empty table gives no rows;
other columns are not looked at. A very long text is a slab of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, stored
from .slabs import cut_slabs, store_slabs

# Fixed values of the contract: rows with this remainder of the id's checksum are held out.
FOLDS, HELD_OUT = 5, 1

#: Longest context, 5 at most: a gram of order + 1 symbols of 9 bits, and a flag, fit a long.
ORDER = 4
_BITS, _MOST_ORDER = 9, 5
_END, _START = 256, 257  # the end is coded, the start only context
N_SYMBOLS = 257
_WINDOW = 1 << 21  # symbols worked on at a time


def held_out(id_: Column) -> Column:
    """Whether the row is scored only (a NULL id is not)."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


class Text:
    """The texts of a slab as symbols and words."""

    def __init__(self, texts: pa.StringArray, order: int):
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        self.order, sizes = order, np.diff(offsets)
        # order start marks, the bytes, an end
        self.first = np.cumsum(sizes + order + 1) - (sizes + order + 1)
        self.symbols = np.full(len(data) + n * (order + 1), _START, np.uint16)
        for a, b, at in zip((offsets[:-1] - offsets[0]).tolist(), (offsets[1:] - offsets[0]).tolist(), (self.first + order).tolist()):
            self.symbols[at:at + b - a] = data[a:b]
        self.symbols[self.first + order + sizes] = _END
        lists = pc.ascii_split_whitespace(texts)
        bounds = np.asarray(lists.offsets.to_numpy(), np.int64)
        flat = lists.flatten().dictionary_encode()
        self.words = flat.dictionary
        self.word = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.word_doc = np.repeat(np.arange(n), np.diff(bounds))
        real = np.asarray(pc.not_equal(self.words, "").to_numpy(zero_copy_only=False), bool)[self.word]
        self.word, self.word_doc = self.word[real], self.word_doc[real]

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Packed gram that ends at each coded symbol, and its document, in windows."""
        k = self.order
        for a in range(0, len(self.symbols), _WINDOW):
            part = self.symbols[max(0, a - k):a + _WINDOW].astype(np.int64)
            skip = min(a, k)
            at = np.flatnonzero(part[skip:] != _START) + skip
            at = at[at >= k]
            g = np.zeros(len(at), np.int64)
            for j in range(k + 1):
                g = (g << _BITS) | part[at - k + j]
            yield g, np.searchsorted(self.first, at - skip + a, "right") - 1


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum (key, count) lists by key."""
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


_SLAB = ("slab long, id array<long>, held array<boolean>, sizes array<int>, body binary, "
         "words array<string>, word_n array<long>, grams array<long>, gram_n array<long>")
_ARROW = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(),
          pa.list_(pa.string()), *[pa.list_(pa.int64())] * 3]


def _count_slabs(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct words and grams of each slab, counted over its training rows."""
        import zstandard

        for number, rows in cut_slabs(batches):
            texts = pc.ascii_lower(pc.fill_null(rows.column("t").combine_chunks(), ""))
            held = np.asarray(rows.column("held").to_numpy(), bool)
            x = Text(texts, order)
            parts = []
            for g, doc in x.grams():
                keys, n = np.unique((g << 1) | ~held[doc], return_counts=True)
                parts.append((keys >> 1, n * (keys & 1)))
            grams, gram_n = _counted(parts)
            word_n = np.bincount(x.word[~held[x.word_doc]], minlength=len(x.words))
            here = np.flatnonzero(np.bincount(x.word, minlength=len(x.words)))
            body = zstandard.ZstdCompressor(level=1).compress(b"".join(texts.cast(pa.binary()).to_pylist()))
            cells = [number, rows.column("id").to_pylist(), held, np.diff(np.concatenate(([0], np.cumsum(pc.binary_length(texts))))),
                     body, x.words.take(pa.array(here)).to_pylist(), word_n[here], grams, gram_n]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c], _ARROW[k]) for k, c in enumerate(cells)], names=[c.split(" ")[0] for c in _SLAB.split(", ")])
    return run


def _mask(symbols: int) -> int:
    return (1 << _BITS * symbols) - 1


def build_trie(grams: DataFrame, order: int) -> list[tuple[DataFrame, DataFrame]]:
    """Per level k: ``g, c`` (gram of k + 1 symbols, count) and ``s, n, q, e``
    (context of k symbols, its total, its distinct symbols, and the total of
    these symbols one level below). No group has more than 258 rows."""
    levels = []
    counts = grams
    for k in range(order, -1, -1):
        suffix = F.col("g").bitwiseAND(F.lit(_mask(k)))
        below = F.sum("c").over(W.partitionBy(suffix)) if k else F.lit(0).cast("long")
        contexts = (counts.select(F.shiftright("g", _BITS).alias("s"), "c", below.alias("below"))
                    .groupBy("s").agg(F.sum("c").alias("n"), F.count("*").alias("q"), F.sum("below").alias("e")))
        levels.append((counts, stored(contexts)))
        if k:
            counts = stored(counts.groupBy(suffix.alias("g")).agg(F.sum("c").alias("c")))
    return levels[::-1]


def gram_scores(grams: DataFrame, order: int) -> DataFrame:
    """``g, logp`` of every gram of ``g, c`` (c is 0 where no training text has it)."""
    levels = build_trie(grams.filter("c > 0"), order)
    total = F.col("n") + F.col("q")
    top = grams.join(levels[order][1], F.shiftright("g", _BITS) == F.col("s"), "left")
    known = top.filter("c > 0").select("g", F.log10(F.col("c") / total).alias("logp"))
    parts = [known]
    # grams unknown so far: cost of the escapes, and distinct symbols and excluded total of the context left
    zero = F.lit(0).cast("long")
    rest = top.filter("c = 0").select("g", F.coalesce(F.log10(F.col("q") / total), F.lit(0.0)).alias("acc"),
                                      F.coalesce("q", zero).alias("q0"), F.coalesce("e", zero).alias("e0"))
    for k in range(order - 1, -1, -1):
        counts, contexts = levels[k]
        counts, contexts = counts.withColumnRenamed("g", "sub"), contexts.select("s", "n", "q", "e")
        if k < 2:  # at most 258 contexts of one symbol, 257 symbols each
            counts, contexts = F.broadcast(counts), F.broadcast(contexts)
        rest = rest.withColumn("sub", F.col("g").bitwiseAND(F.lit(_mask(k + 1))))
        rest = rest.join(contexts, F.shiftright("sub", _BITS) == F.col("s"), "left").join(counts, "sub", "left")
        room = F.col("n") - F.col("e0") + F.col("q") - F.col("q0")
        escape = F.when(room > 0, F.log10((F.col("q") - F.col("q0")) / room)).otherwise(0.0)
        step = cut(rest.select("g", F.col("c").isNotNull().alias("known"),
                               (F.col("acc") + F.when(F.col("c").isNotNull(), F.log10(F.col("c") / room)).otherwise(escape)).alias("acc"),
                               F.coalesce("q", zero).alias("q0"), F.coalesce("e", zero).alias("e0")))
        parts.append(step.filter("known").select("g", F.col("acc").alias("logp")))
        rest = step.filter("not known").drop("known")
    parts.append(rest.select("g", (F.col("acc") - F.log10(N_SYMBOLS - F.col("q0"))).alias("logp")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _score_slab(order: int, n_train: int, n_distinct: int, n_ends: int):
    def run(key, slab: pa.Table, own: pa.Table) -> pa.Table:
        import zstandard

        row = slab.to_pylist()[0]
        ends = np.concatenate(([0], np.cumsum(row["sizes"], dtype=np.int64))).astype(np.int32)
        body = zstandard.ZstdDecompressor().decompress(row["body"])
        n = len(row["id"])
        x = Text(pa.StringArray.from_buffers(n, pa.py_buffer(ends.tobytes()), pa.py_buffer(body)), order)
        is_word = pc.is_valid(own.column("word"))
        words, grams = own.filter(is_word), own.filter(pc.invert(is_word))

        # the slab's own counts, and the corpus's where they differ
        held = np.array(row["held"], bool)
        count = np.bincount(x.word[~held[x.word_doc]], minlength=len(x.words))
        place = pc.index_in(words.column("word").combine_chunks(), value_set=x.words).to_numpy(zero_copy_only=False)
        count[place[~np.isnan(place)].astype(np.int64)] = words.column("c").to_numpy()[~np.isnan(place)]
        cost = np.log10((np.append(count, n_ends) + 0.5) / (n_train + 0.5 * (n_distinct + 1)))
        base = np.bincount(x.word_doc, cost[x.word], n) + cost[-1]
        n_tokens = np.bincount(x.word_doc, minlength=n) + 1
        n_known = np.bincount(x.word_doc, count[x.word] > 0, n).astype(np.int64) + int(n_ends > 0)

        keys = grams.column("g").to_numpy()
        by_key = np.argsort(keys)
        keys, logp = keys[by_key], grams.column("logp").to_numpy()[by_key]
        score = np.zeros(n)
        for g, doc in x.grams():
            score += np.bincount(doc, logp[np.searchsorted(keys, g)], n)
        return pa.table({
            "id": pa.array(row["id"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()),
            "n_tokens": n_tokens, "n_known": n_known, "train_tokens": np.full(n, n_train, np.int64),
            "base_score": base, "score": score})
    return run


_RESULT = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(docs: DataFrame, held: Column, id_col: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """Per document row: ``id``, whether it was held out, words and end, those
    that training knows, all training tokens, and both log10 scores. The model
    learns from the rows where ``held`` is false."""
    if not 0 <= order <= _MOST_ORDER:
        raise ValueError(f"order {order} is not in 0..{_MOST_ORDER}")
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), held.alias("held"), F.col(f"`{text}`").alias("t"))
    slabs = store_slabs(d.mapInArrow(_count_slabs(order), _SLAB))
    words = (slabs.select(F.explode(F.arrays_zip("words", "word_n")).alias("x"))
             .groupBy(F.col("x.words").alias("word")).agg(F.sum("x.word_n").alias("c")))
    words = stored(words)
    ends = slabs.agg(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    grams = stored(slabs.select(F.explode(F.arrays_zip("grams", "gram_n")).alias("x"))
                   .groupBy(F.col("x.grams").alias("g")).agg(F.sum("x.gram_n").alias("c")))
    totals = words.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    # a word whose count in the slab is its count in the corpus need not come back
    own_words = (slabs.select(F.col("slab").alias("taker"), F.explode(F.arrays_zip("words", "word_n")).alias("x"))
                 .select("taker", F.col("x.words").alias("word"), "x.word_n").join(words, "word").filter("c <> word_n")
                 .select("taker", "word", "c", F.lit(None).cast("long").alias("g"), F.lit(None).cast("double").alias("logp")))
    own_grams = (slabs.select(F.col("slab").alias("taker"), F.explode("grams").alias("g")).join(gram_scores(grams, order), "g")
                 .select("taker", F.lit(None).cast("string").alias("word"), F.lit(None).cast("long").alias("c"), "g", "logp"))
    return (slabs.select("slab", "id", "held", "sizes", "body").groupBy("slab")
            .cogroup(own_words.unionByName(own_grams).groupBy("taker"))
            .applyInArrow(_score_slab(order, (totals["n"] or 0) + ends, (totals["v"] or 0) + int(ends > 0), ends), _RESULT))


class AdaptiveModel:
    """The model of one text: it starts empty and counts what it has coded."""

    def __init__(self, order: int = ORDER):
        self.order, self.counts = order, {}

    def code(self, symbols: list[int]) -> float:
        """log10 probability of the symbols, each counted after it is coded."""
        past, out = (_START,) * self.order, 0.0
        for x in symbols:
            excluded = set()
            contexts = [past[k:] for k in range(self.order + 1)]
            for s in contexts:
                seen = {y: n for y, n in self.counts.get(s, {}).items() if y not in excluded}
                if seen:
                    room = sum(seen.values()) + len(seen)
                    if x in seen:
                        out += math.log10(seen[x] / room)
                        break
                    out += math.log10(len(seen) / room)
                    excluded |= seen.keys()
            else:
                out -= math.log10(N_SYMBOLS - len(excluded))
            for s in contexts:
                own = self.counts.setdefault(s, {})
                own[x] = own.get(x, 0) + 1
            past = (*past[1:], x) if self.order else ()
        return out


def adaptive_scores(docs: DataFrame, id_col: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """``id, score``: log10 probability of each text under its own adaptive model."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = pc.ascii_lower(pc.fill_null(b.column("t"), "")).cast(pa.binary())
            scores = [AdaptiveModel(order).code([*t.as_py(), _END]) for t in low]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(scores, pa.float64())], names=["id", "score"])

    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t"))
    return d.mapInArrow(run, "id long, score double")


def op11_ppm(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_texts(docs, held_out(F.col("doc_id"))).withColumnRenamed("id", "doc_id")
