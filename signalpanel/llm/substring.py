"""Substring dedup by de Bruijn compaction over token k-mers.

A text is a walk over word k-mers. Windows of ``WINDOW`` words that choose the
same occurrence of a short k-mer (their anchor: the smallest hash in the
window, leftmost on ties) form a run, so equal windows always lie in runs of
the same anchor. Runs are the edges of the graph, about one per eight words.

1. Count anchors; only runs of repeated anchors go on.
2. Group equal runs: count, first source coordinate, and a fingerprint of the
   coordinates where the run starts and where the next would start. Two runs
   meet in a nonbranching node if these fingerprints and the counts agree:
   then every occurrence of one is followed by the other.
3. Join each run with its successor and compact maximal nonbranching paths;
   from here on, one row per path occurrence stands for a long repeated span.
4. Every occurrence of a path but its first is a repeated span. For anchors
   with several different runs (the ends of shared passages, edited copies)
   the first occurrence of each run is opened into windows, and windows whose
   sequence starts earlier elsewhere are marked.
5. Marks are joined to the texts, checked against the text at their source
   coordinates (so a mark can never hit other words), and the words they
   cover are cut.

Hashes: anchors and runs (or windows) are 64 bits each and always compared
together. Hot anchors and passages are counted with partial aggregation and
joined through plain exchanges that adaptive execution splits.

Defined results: NULL text has no words; a NULL id sorts before all others;
rows with one id count as one document, so equal rows keep the same words;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, packed, stored, unpack

# Fixed value of the contract.
WINDOW = 20
#: Words of an anchor.
ANCHOR = 6

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_NO_ID = -(2 ** 63)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch of texts, and where each text starts."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten().dictionary_encode()
    codes, names = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary.cast(pa.binary()).to_pylist()
    table = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))
    real = np.fromiter((len(w) > 0 for w in names), bool, len(names))[codes] if len(names) else np.zeros(0, bool)
    bounds = np.asarray(lists.offsets.to_numpy(), np.int64)
    bounds = bounds - bounds[0]
    offsets = np.concatenate(([0], np.cumsum(real)))[bounds].astype(np.int64)
    return (table[codes[real]] if len(names) else np.zeros(0, np.uint64)), offsets


class Runs:
    """Runs of a batch of texts, from word hashes and text offsets."""

    def __init__(self, words: np.ndarray, offsets: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR):
        n = len(words)
        if len(_powers[0]) <= n:
            for k, base in enumerate((_BASE, _INVERSE)):
                _powers[k] = np.concatenate(([np.uint64(1)], np.cumprod(np.full(2 * n, base, np.uint64))))
        self.offsets, self.window = offsets, window
        self._sums = np.concatenate(([np.uint64(0)], np.cumsum(words * _powers[0][:n], dtype=np.uint64)))
        lengths = np.diff(offsets)
        left = np.repeat(offsets[1:], lengths) - np.arange(n)  # words from here to the end of the text
        starts = np.flatnonzero(left >= window)
        if not len(starts):
            self.at = self.text = self.count = np.zeros(0, np.int64)
            self.anchor = self.run = np.zeros(0, np.uint64)
            return
        key = self.hash(np.arange(n - anchor + 1), anchor)
        low, where = key, np.arange(len(key))
        have, want = 1, window - anchor + 1
        while have < want:
            step = min(have, want - have)
            a, b = low[:len(low) - step], low[step:]
            take = b < a
            low, where = np.where(take, b, a), np.where(take, where[step:], where[:len(where) - step])
            have += step
        chosen = where[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (starts[1:] != starts[:-1] + 1) | (chosen[1:] != chosen[:-1])
        first = np.flatnonzero(new)
        self.count = np.diff(np.append(first, len(starts)))  # windows in the run
        begin = starts[first]
        self.anchor = key[chosen[first]]
        self.run = self.hash(begin, self.count + window - 1)
        self.text = np.searchsorted(offsets, begin, "right") - 1
        self.at = begin - offsets[self.text]

    def hash(self, begin: np.ndarray, length) -> np.ndarray:
        """Hash of ``length`` words from ``begin`` (positions in the batch)."""
        return _mix((self._sums[begin + length] - self._sums[begin]) * _powers[1][begin])


_BITS = 6  # of the number of windows in a packed (start, windows) coordinate


def _rows(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(v.view(np.int64) if isinstance(v, np.ndarray) and v.dtype == np.uint64 else v) for v in columns.values()],
        names=list(columns))


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield _rows(anchor=Runs(*word_hashes(b.column("t"))).anchor)


def _emit_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        r = Runs(*word_hashes(b.column("t")))
        yield _rows(anchor=r.anchor, run=r.run, doc=b.column("doc").to_numpy()[r.text],
                    at=(r.at << _BITS) | r.count)


def _open_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the runs named in ``runs`` (coordinate and hash)."""
    for b in batches:
        r = Runs(*word_hashes(unpack(b.column("t"))))
        packed = (r.at << _BITS) | r.count
        wanted = [{(x["at"], x["run"]) for x in runs} for runs in b.column("runs").to_pylist()]
        named = np.fromiter(((p, h) in wanted[t] for p, h, t in
                             zip(packed.tolist(), r.run.view(np.int64).tolist(), r.text.tolist())), bool, len(packed))
        count, at, text, anchor = r.count[named], r.at[named], r.text[named], r.anchor[named]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        pos, text = np.repeat(at, count) + step, np.repeat(text, count)
        hashes = r.hash(r.offsets[text] + pos, WINDOW) if len(pos) else np.zeros(0, np.uint64)
        yield _rows(anchor=np.repeat(anchor, count), window=hashes, doc=b.column("doc").to_numpy()[text], pos=pos)


def _cover(r: Runs, k: int, n: int, spans: list[dict]) -> np.ndarray:
    """Which words of text ``k`` (``n`` words) verified spans cover."""
    own = slice(*np.searchsorted(r.text, [k, k + 1]))
    at = r.at[own]
    upto = np.concatenate(([np.uint64(0)], np.bitwise_xor.accumulate(r.run[own]))) if len(at) else np.zeros(1, np.uint64)
    edge = np.zeros(n + 1, np.int64)
    for s in spans:
        begin, windows = s["begin"], s["windows"]
        end = begin + windows + WINDOW - 1
        if end > n:
            continue
        if s["single"]:
            found = r.hash(np.array([r.offsets[k] + begin]), WINDOW)[0]
        else:
            i, j = np.searchsorted(at, [begin, begin + windows])
            found = upto[i] ^ upto[j]
        if int(found) == s["check"] % (1 << 64):
            edge[begin] += 1
            edge[end] -= 1
    return np.cumsum(edge[:-1]) > 0


def _cut_words(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = unpack(b.column("t")), b.column("spans").to_pylist()
            marked = [k for k, s in enumerate(spans) if s]
            r = Runs(*word_hashes(texts.take(pa.array(marked, pa.int64())))) if marked else None
            place = {k: i for i, k in enumerate(marked)}
            n_words, n_removed, kept = [], [], []
            for k, text in enumerate(texts.cast(pa.binary()).to_pylist()):
                w = (text or b"").split()
                gone = 0
                n = len(w)
                if k in place and n:
                    away = _cover(r, place[k], n, spans[k])
                    gone = int(away.sum())
                    w = [x for x, a in zip(w, away.tolist()) if not a]
                left = b" ".join(w)
                n_words.append(n)
                n_removed.append(gone)
                kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode("utf-8"))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                names=["id", "n_words", "n_removed", "kept"])
    return run


def _paths(runs: DataFrame) -> DataFrame:
    """Compact nonbranching paths: ``anchor, run`` of the head, its first
    coordinate ``doc0, at0``, ``windows`` of the whole path and ``check``."""
    order = W.partitionBy("doc0").orderBy("at0", "anchor", "run")
    ahead = F.lag(F.struct("n", "x1", "s1", "end0")).over(order)
    same = ((F.col("p.n") == F.col("n")) & (F.col("p.x1") == F.col("x0")) & (F.col("p.s1") == F.col("s0"))
            & (F.col("p.end0") == F.col("begin0")))
    a = runs.withColumn("p", ahead).withColumn("head", F.when(same, 0).otherwise(1))
    a = a.withColumn("path", F.sum("head").over(order))
    head = F.min(F.struct("at0", "anchor", "run"))
    return a.groupBy("doc0", "path").agg(head.alias("h"), F.sum("windows").alias("windows"), F.bit_xor("run").alias("check")
                                         ).select("h.anchor", "h.run", "doc0", "h.at0", "windows", "check")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Spans to remove per document ``(doc, begin, windows, check, single)``
    from ``(doc, t)`` rows."""
    spark = docs.sparkSession
    anchors = docs.select("t").mapInArrow(_emit_anchors, "anchor long")
    repeated = stored(anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"))
    runs = docs.select("doc", "t").mapInArrow(_emit_runs, "anchor long, run long, doc long, at long")
    runs = stored(runs.join(repeated, "anchor"))
    begin, windows = F.shiftright("at", _BITS), F.col("at").bitwiseAND(F.lit((1 << _BITS) - 1))
    start, end = F.xxhash64("doc", begin), F.xxhash64("doc", begin + windows)
    first = F.min(F.struct("doc", "at"))
    groups = runs.groupBy("anchor", "run").agg(
        F.count("*").alias("n"), first.alias("f"), F.bit_xor(start).alias("x0"), F.bit_xor(end).alias("x1"),
        F.sum(F.shiftright(start, 32)).alias("s0"), F.sum(F.shiftright(end, 32)).alias("s1"))
    groups = stored(groups.select("anchor", "run", "n", F.col("f.doc").alias("doc0"), F.col("f.at").alias("at0"),
                                  "x0", "x1", "s0", "s1"))
    nodes = groups.filter("n > 1").select(
        "*", F.shiftright("at0", _BITS).alias("begin0"), F.col("at0").bitwiseAND(F.lit((1 << _BITS) - 1)).alias("windows"))
    paths = stored(_paths(nodes.withColumn("end0", F.col("begin0") + F.col("windows"))))
    later = (runs.join(paths, ["anchor", "run"]).filter("doc <> doc0 OR at <> at0")
             .select("doc", begin.alias("begin"), "windows", "check", F.lit(False).alias("single")))
    several = stored(groups.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1").select("anchor"))
    firsts = stored(groups.select("anchor", "run", "doc0", "at0").join(several, "anchor"))
    per_doc = firsts.groupBy(F.col("doc0").alias("doc")).agg(F.collect_list(F.struct(F.col("at0").alias("at"), "run")).alias("runs"))
    opened = stored(packed(docs.select("doc", "t"), "t").join(per_doc, "doc").mapInArrow(
        _open_runs, "anchor long, window long, doc long, pos long"))
    earliest = stored(opened.groupBy("anchor", "window").agg(F.count("*").alias("n"), F.min(F.struct("doc", "pos")).alias("f"))
                      .filter("n > 1").select("anchor", "window", F.col("f.doc").alias("doc0"), F.col("f.pos").alias("pos0")))
    single = (opened.join(earliest, ["anchor", "window"]).filter("doc <> doc0 OR pos <> pos0")
              .select("doc", F.col("pos").alias("begin"), F.lit(1).cast("long").alias("windows"),
                      F.col("window").alias("check"), F.lit(True).alias("single")))
    return later.unionAll(single)


def _cut_all(docs: DataFrame, id_col: str, text: str, digest: bool) -> DataFrame:
    bounded_batches(docs.sparkSession)
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t"))
    d = d.select("id", F.coalesce("id", F.lit(_NO_ID)).alias("doc"), "t")
    spans = repeated_spans(d.select("doc", "t")).groupBy("doc").agg(
        F.collect_list(F.struct("begin", "windows", "check", "single")).alias("spans"))
    return packed(d, "t").join(spans, "doc", "left").select("id", "t", "spans").mapInArrow(
        _cut_words(digest), "id long, n_words long, n_removed long, kept string")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``id, n_words, n_removed, kept`` (the words that stay, joined by one space)."""
    return _cut_all(docs, id_col, text, False)


def op7_substring_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return _cut_all(docs, "doc_id", "text", True).withColumnsRenamed({"id": "doc_id", "kept": "kept_sha256"})
