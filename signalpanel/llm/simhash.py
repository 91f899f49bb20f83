"""SimHash near-dedup by multi-index hashing.

1. Each whole text gets a 64-bit fingerprint: a bit is 1 if it is set in over
   half of the XXH64 hashes of its word shingles.
2. Distinct fingerprints (with the smallest id that has each) are cut into
   segments. By the pigeonhole rule two fingerprints within ``max_bits`` agree
   on a segment up to a small radius; every fingerprint is entered in the table
   of each segment under its own value (home) and under the values of the small
   Hamming ball around it (probes). Of two values that differ, only the one
   with a 0 in the lowest differing bit probes the other, so a pair meets once.
3. Per table entry, the complete distance of home-home and home-probe pairs is
   verified with vectorised bit counts; only a spanning star of each linked
   set leaves the task, so an entry with n members emits fewer than n links
   however dense it is. Entries with many members are split into block pairs.
4. Star contraction joins the links to components; ids are joined back.

Defined results: NULL and empty texts have fingerprint 0 and are linked like
any other; equal rows have equal results; a NULL id never becomes a
component_id unless no other id is reachable; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut
from .components import components

# Fixed values of the contract.
SHINGLE_WORDS = 4
MAX_BITS = 4
HASH_SEED = 42

#: Distinct fingerprints above which two segments (32-bit keys, larger balls)
#: cost less than three (21-bit keys). The result is the same either way.
TWO_SEGMENTS_FROM = 50_000_000
#: Members of one table entry that a task compares; larger entries are split.
BLOCK_ROWS, MOST_BLOCKS, BLOCK_ROWS_MAX = 4096, 32, 1 << 20
#: Members from which an entry is searched by absorbing instead of pair by pair.
ABSORB_FROM = 2000
_FLUSH_ROWS = 1 << 16
_PAIRS_AT_ONCE = 1 << 21


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit fingerprint of one text."""
    import xxhash

    w = (text or "").encode("utf-8").lower().split()  # bytes: ASCII only, both for case and space
    if not w:
        return 0
    joined = b" ".join(w)
    digest = xxhash.xxh64_digest
    if len(w) <= shingle:
        return int.from_bytes(digest(joined, HASH_SEED), "big", signed=True)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = len(w) - shingle + 1
    starts, ends = starts[:n], ends[shingle - 1:] - 1
    ones = np.zeros(64, np.int64)
    for k in range(0, n, _FLUSH_ROWS):
        h = b"".join([digest(joined[s:e], HASH_SEED) for s, e in
                      zip(starts[k:k + _FLUSH_ROWS].tolist(), ends[k:k + _FLUSH_ROWS].tolist())])
        bits = np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, shingle) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(fps, pa.int64())],
                                             names=["id", "th", "fp"])
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                 shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``(id, th, fp)`` per row; ``th`` tells rows with one id apart."""
    bounded_batches(docs.sparkSession)
    t = F.col(f"`{text}`")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(t).alias("th"), t.alias("t")
                       ).mapInArrow(_fingerprints(shingle), "id long, th long, fp long")


def segments(count: int, max_bits: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment: with r = a * m + b, the first
    b + 1 segments are searched to radius a and the others to a - 1, so the
    sum of all radii plus one each exceeds r. Radius -1: not searched."""
    a, b = divmod(max_bits, count)
    out, shift = [], 0
    for k in range(count):
        width = 64 // count + (k >= count - 64 % count)
        out.append((shift, width, a if k <= b else a - 1))
        shift += width
    return out


def _entry_array(k: int, shift: int, width: int, radius: int) -> Column:
    """Home and probes of one segment as an array of structs."""
    value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
    tag = F.lit(k << 56)
    home = F.array(F.struct((value + tag).alias("entry"), F.lit(True).alias("home")))
    masks = [sum(1 << x for x in c) for r in range(1, radius + 1) for c in combinations(range(width), r)]
    if not masks:
        return home
    ball = F.filter(F.array(*[F.lit(m).cast("long") for m in masks]),
                    lambda m: value.bitwiseAND(m.bitwiseAND(-m)) == 0)  # a 0 in the lowest bit that differs
    return F.concat(home, F.transform(ball, lambda m: F.struct(
        (value.bitwiseXOR(m) + tag).alias("entry"), F.lit(False).alias("home"))))


def _entries(fps: DataFrame, segs: list[tuple[int, int, int]]) -> DataFrame:
    """``(entry, fp, home)``: one home and the ball's probes per segment."""
    arrays = [_entry_array(k, *s) for k, s in enumerate(segs) if s[2] >= 0]
    return fps.select("fp", F.explode(F.concat(*arrays)).alias("e")).select("e.entry", "fp", "e.home")


def _split_large(entries: DataFrame) -> DataFrame:
    """Add the block pair ``(p, q)``: entries with many members are compared
    block against block, all others in the one pair (0, 0)."""
    members = entries.groupBy("entry").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * BLOCK_ROWS)
    few = F.least(F.ceil(F.col("n") / BLOCK_ROWS), F.lit(MOST_BLOCKS))
    large = members.select("entry", F.greatest(few, F.ceil(F.col("n") / BLOCK_ROWS_MAX)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    a = entries.join(large, "entry", "left").select("entry", "fp", "home", "blocks", own.alias("own"))
    pairs = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                    lambda j: F.struct(F.least("own", j).alias("p"), F.greatest("own", j).alias("q"))))
    return a.select("entry", "fp", "home", F.explode(pairs).alias("pair")).select("entry", "pair.p", "pair.q", "fp", "home")


def _star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links to (member, smallest member) stars with the same components."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[:len(a)], inv[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _absorb(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one large entry: a member takes all that are near it
    out of the rest, so dense sets shrink at once."""
    rest, a, b = fp, [], []
    todo: list[np.ndarray] = []
    while len(rest) or todo:
        if not todo:
            todo, rest = [rest[:1]], rest[1:]
        now = todo.pop()
        for x in now:
            if not len(rest):
                break
            near = np.bitwise_count(rest ^ x) <= max_bits
            if near.any():
                got = rest[near]
                rest = rest[~near]
                a.append(np.full(len(got), x))
                b.append(got)
                todo.append(got)
    empty = fp[:0]
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _links_of(fp: np.ndarray, home: np.ndarray, starts: np.ndarray, max_bits: int):
    """Links in one run of whole groups (homes first in each)."""
    ends = np.append(starts[1:], len(fp))
    sizes = ends - starts
    a, b = [fp[:0]], [fp[:0]]
    large = sizes >= ABSORB_FROM
    for s, e in zip(starts[large].tolist(), ends[large].tolist()):
        x, y = _absorb(fp[s:e], max_bits)
        a.append(x)
        b.append(y)
    end_of = np.repeat(np.where(large, starts, ends), sizes)
    lefts = np.flatnonzero(home & ~np.repeat(large, sizes))
    counts = end_of[lefts] - lefts - 1
    upto = np.cumsum(counts)
    k = 0
    while k < len(lefts):
        base = upto[k - 1] if k else 0
        j = max(k + 1, int(np.searchsorted(upto, base + _PAIRS_AT_ONCE, "right")))
        c = counts[k:j]
        left = np.repeat(lefts[k:j], c)
        first = np.repeat(np.cumsum(c) - c, c)
        right = left + 1 + np.arange(len(left)) - first
        near = np.bitwise_count(fp[left] ^ fp[right]) <= max_bits
        a.append(fp[left[near]])
        b.append(fp[right[near]])
        k = j
    return np.concatenate(a), np.concatenate(b)


def _link(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def work(last: bool):
            nonlocal held, rows
            t = pa.Table.from_batches(held)
            col = {c: t.column(c).to_numpy() for c in ("entry", "p", "q", "fp", "home")}
            new = np.ones(len(t), bool)
            new[1:] = ((col["entry"][1:] != col["entry"][:-1]) | (col["p"][1:] != col["p"][:-1])
                       | (col["q"][1:] != col["q"][:-1]))
            starts = np.flatnonzero(new)
            upto = len(t) if last else int(starts[-1])  # the last group may go on in the next batch
            held, rows = ([] if last else t.slice(upto).to_batches()), len(t) - upto
            if not upto:
                return None
            a, b = _links_of(col["fp"][:upto].view(np.uint64), col["home"][:upto].astype(bool),
                             starts[starts < upto], max_bits)
            a, b = _star(a, b)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        due = _FLUSH_ROWS
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
                if rows >= due:
                    out = work(False)
                    due = max(_FLUSH_ROWS, 2 * rows)
                    if out is not None:
                        yield out
        if rows:
            yield work(True)
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                    shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                    n_segments: int | None = None) -> DataFrame:
    """Per input row: ``id, th, fp, component_id``."""
    prints = cut(fingerprints(docs, id_col, text, shingle))
    fps = cut(prints.groupBy("fp").agg(F.min("id").alias("first_id")))
    if n_segments is None:
        n_segments = 3 if fps.count() < TWO_SEGMENTS_FROM else 2
    entries = _entries(fps.select("fp"), segments(n_segments, max_bits))
    pairs = _split_large(entries)
    links = (pairs.repartition("entry", "p", "q")
             .sortWithinPartitions("entry", "p", "q", F.col("home").desc(), "fp")
             .mapInArrow(_link(max_bits), "a long, b long"))
    roots = components(links)
    placed = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = placed.join(smallest, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("id", "th", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The input rows, all columns, of one document per component: the one
    with the smallest id (ties: by text hash; equal rows: any one of them)."""
    found = near_duplicates(docs, id_col, text, **options)
    best = found.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "th")).alias("k"))
    best = best.select(F.col("k.id").alias("__keep_id"), F.col("k.th").alias("__keep_th"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        F.col(f"`{id_col}`").cast("long").alias("__id"), F.xxhash64(F.col(f"`{text}`")).alias("__th"))
    kept = keyed.join(best, keyed["__id"].eqNullSafe(best["__keep_id"]) & (keyed["__th"] == best["__keep_th"]))
    return kept.dropDuplicates(["__id", "__th"]).select("row.*")


def op1_simhash(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select(
        F.col("id").alias("doc_id"), hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")
