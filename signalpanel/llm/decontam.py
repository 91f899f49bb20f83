"""Benchmark decontamination by q-gram lemma filtering.

Benchmark items are cut into overlapping pieces of each of ``PIECE_SIZES``, one
every ``PIECE_STEP`` characters: a verbatim run of the shorter size and
``PIECE_STEP - 1`` characters holds a whole piece wherever it starts in the
item; the longer pieces find what has its edits close together. A piece of m characters that
occurs in a text with at most e edits shares at least m - q + 1 - q * e of its
character q-grams with it, all within e neighbouring diagonals (text position
minus item position). Per batch of whole texts, shared q-grams are counted per
item in overlapping diagonal bands; in bands that reach the bound, each piece
that reaches it by itself is a region, and each region is verified by a banded
alignment of the whole piece.

The benchmark is the stated query set. It is cut into blocks of at most
``BLOCK_CHARS`` characters, counted beforehand; one block at a time is sent to
the tasks, and every text meets every block, so the size of what is sent is
bounded however large the benchmark is. Texts are never shuffled.

Texts and items are compared in lower case with white space collapsed.

Defined results: NULL and empty texts match nothing; an item under ``MIN_CHARS``
characters matches a text that is just this item (longer texts hold such
strings by chance); equal
rows match alike; an empty benchmark or corpus gives no matches; a text with
a NULL id is matched like any other.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

Q = 8
#: For whole items whose bound would fall under 1 (30 and 31 characters).
SMALL_Q = 6
#: Edits allowed per hundred characters of a piece.
EDIT_PERCENT = 10
#: The step is no larger than the edits allowed in a piece.
PIECE_SIZES, PIECE_STEP = (64, 96), 6
PIECE_CHARS = max(PIECE_SIZES)
MIN_CHARS = 24
#: Benchmark characters that one pass sends to the tasks.
BLOCK_CHARS = 2_000_000
#: Diagonals of a band, besides its overlap with the next.
BAND = 16
#: Characters looked at at once; longer texts go through in overlapping parts.
_PART_CHARS = 1 << 20
_HITS_AT_ONCE = 1 << 21
_NOTHING = 0x110000  # above all code points

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def starts_of(length: int, piece: int, step: int = PIECE_STEP, least: int = MIN_CHARS) -> list[int]:
    """Where the pieces of one size start; the last one ends where the text ends."""
    if length < least:
        return []
    starts = list(range(0, max(1, length - piece + 1), step))
    if starts[-1] + piece < length:
        starts.append(length - piece)
    return starts


def pieces_of(text: str) -> list[str]:
    """Overlapping pieces of a normalised text, size by size; a text no longer
    than a size is one piece."""
    return list(dict.fromkeys(text[s:s + m] for m in PIECE_SIZES for s in starts_of(len(text), m)))


def edit_budget(length: int) -> int:
    return length * EDIT_PERCENT // 100


def q_bound(length, q: int = Q):
    """q-grams that a piece shares with a text at least (lengths, or an array of them)."""
    return length - q + 1 - q * (length * EDIT_PERCENT // 100)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, b, np.uint64)))) for b in (_BASE, _INVERSE))


def _grams(codes: np.ndarray, powers: tuple[np.ndarray, np.ndarray], q: int = Q) -> np.ndarray:
    """Hash of the q-gram at each position."""
    n = len(codes)
    if n < q:
        return np.zeros(0, np.uint64)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(codes.astype(np.uint64) * powers[0][:n], dtype=np.uint64)))
    h = (sums[q:] - sums[:-q]) * powers[1][:n - q + 1]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Index:
    """q-grams of one block of benchmark items."""

    def __init__(self, items: list[tuple[int | None, str]], q: int = Q):
        self.q = q
        rows = [(i, normalise(text)) for i, text in items]
        exact = [(i, t) for i, t in rows if 0 < len(t) < MIN_CHARS]
        least = {m for m in range(MIN_CHARS, PIECE_SIZES[0]) if q > SMALL_Q and q_bound(m, q) < 1}
        small = [(i, t) for i, t in rows if len(t) in least]
        rows = [(i, t) for i, t in rows if len(t) >= MIN_CHARS and len(t) not in least]
        whole = [_codes(t) for _, t in rows]
        chars = np.array([len(c) for c in whole], np.int64)
        self.longest = int(chars.max(initial=0))
        found = [(m, r, s) for k, m in enumerate(PIECE_SIZES) for r, c in enumerate(whole)
                 if not k or len(c) > PIECE_SIZES[k - 1] for s in starts_of(len(c), m)]
        self.items = [rows[r][0] for _, r, _ in found]
        self.codes = [whole[r][s:s + m] for m, r, s in found]
        self.start = np.array([s for _, _, s in found], np.int64)
        self.length = np.array([len(c) for c in self.codes], np.int64)
        self.budget = np.array([edit_budget(len(c)) for c in self.codes], np.int64)
        # per size: its first piece, the places of its pieces, and the span of q-grams and the bound of each row's pieces
        self.sizes = []
        for m in PIECE_SIZES:
            mine = [k for k, x in enumerate(found) if x[0] == m]
            place = np.array([found[k][1] * (self.longest + 1) + found[k][2] for k in mine], np.int64)
            held = np.minimum(chars, m)
            self.sizes.append((mine[0] if mine else 0, place, held - q, q_bound(held, q)))
        self.row_budget = np.minimum(chars, PIECE_CHARS) * EDIT_PERCENT // 100
        self.row_bound = np.min([x[3] for x in self.sizes], axis=0)
        self.powers = _powers(2 * _PART_CHARS)
        grams = [_grams(c, self.powers, q) for c in whole]
        sizes = [len(g) for g in grams]
        h = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.row = np.repeat(np.arange(len(grams)), sizes)[order]
        self.pos = (np.concatenate([np.arange(n) for n in sizes]) if grams else np.zeros(0, np.int64))[order]
        self.bits = 16 + max(0, len(h).bit_length() - 10)
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.hash >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        self.most = int(self.length.max(initial=0))
        self.slack = int(self.budget.max(initial=0))
        self.gap = self.most + 2 * BAND + 4 * self.slack  # between texts: no band of a piece reaches two of them
        # items found otherwise, numbered after the pieces
        self.small, self.first_small = Index(small, SMALL_Q) if small else None, len(self.items)
        self.items += self.small.items if small else []
        self.exact: dict[str, list[int]] = {}
        for i, t in exact:
            self.exact.setdefault(t, []).append(len(self.items))
            self.items.append(i)

    def _hits(self, at, low, n, width):
        """(row and band, item position) of the shared q-grams, part by part."""
        upto, k = np.cumsum(n), 0
        while k < len(at):
            base = upto[k - 1] if k else 0
            j = max(k + 1, int(np.searchsorted(upto, base + _HITS_AT_ONCE, "right")))
            m = n[k:j]
            entry = np.repeat(low[k:j] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            row, pos = self.row[entry], self.pos[entry]
            diagonal = np.repeat(at[k:j], m) - pos + self.longest  # never negative
            key = row * width + diagonal // BAND + 1
            also = diagonal % BAND < self.row_budget[row]  # the overlap with the band before
            yield np.concatenate([key, key[also] - 1]), np.concatenate([pos, pos[also]])
            k = j

    def regions(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, first diagonal) of the bands in which a piece reaches the q-gram bound."""
        h = _grams(codes, self.powers, self.q)
        at = np.flatnonzero(self.seen[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
        low = np.searchsorted(self.hash, h[at], "left")
        n = np.searchsorted(self.hash, h[at], "right") - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        width = (len(codes) + 2 * self.longest) // BAND + 3
        none = np.zeros(0, np.int64)
        counted = [np.unique(key, return_counts=True) for key, _ in self._hits(at, low, n, width)]
        keys, counts = (np.concatenate([none, *x]) for x in (zip(*counted) if counted else ([], [])))
        u, inv = np.unique(keys, return_inverse=True)
        total = np.bincount(inv, counts, len(u)).astype(np.int64)
        u = u[total >= self.row_bound[u // width]] if len(u) else u
        if not len(u):
            return none, none
        held = []
        for key, pos in self._hits(at, low, n, width):
            k = np.minimum(np.searchsorted(u, key), len(u) - 1)
            good = u[k] == key
            held.append(np.unique(k[good] * (self.longest + 1) + pos[good]))
        band, pos = np.divmod(np.unique(np.concatenate(held)), self.longest + 1)
        row = u[band] // width
        pieces, diagonals = [], []
        for base, place, span, bound in self.sizes:
            # runs of as many positions as the bound: all pieces that hold one
            last = np.arange(len(band)) + bound[row] - 1
            end = np.minimum(last, len(band) - 1)
            good = (last == end) & (band[end] == band) & (pos[end] - pos <= span[row])
            b, r, first, end = band[good], row[good], pos[good], pos[end[good]]
            lo = np.searchsorted(place, r * (self.longest + 1) + np.maximum(0, end - span[r]), "left")
            m = np.maximum(0, np.searchsorted(place, r * (self.longest + 1) + first, "right") - lo)
            piece = np.repeat(lo - (np.cumsum(m) - m), m) + np.arange(m.sum())
            b, piece = np.divmod(np.unique(np.repeat(b, m) * (len(place) + 1) + piece), len(place) + 1)
            pieces.append(base + piece)
            diagonals.append((u[b] % width - 1) * BAND - self.longest + self.start[base + piece])
        return np.concatenate(pieces), np.concatenate(diagonals)

    def align(self, codes: np.ndarray, piece: np.ndarray, diagonal: np.ndarray):
        """Least edits of each whole piece within its band of diagonals, and
        the text position where that alignment ends."""
        edits, ends = np.empty(len(piece), np.int64), np.empty(len(piece), np.int64)
        for k in range(0, len(piece), 4096):
            edits[k:k + 4096], ends[k:k + 4096] = self._align(codes, piece[k:k + 4096], diagonal[k:k + 4096])
        return edits, ends

    def _align(self, codes, piece, diagonal):
        m = self.length[piece]
        e = self.slack
        start = diagonal - e
        width = BAND + 3 * e + 1
        pattern = np.full((len(piece), int(m.max(initial=0))), _NOTHING + 1, np.uint32)
        for i, p in enumerate(piece.tolist()):
            pattern[i, :len(self.codes[p])] = self.codes[p]
        step = np.arange(width)
        padded = np.concatenate([np.full(width + e, _NOTHING, np.uint32), codes,
                                 np.full(self.most + width + e, _NOTHING, np.uint32)])
        base = start + width + e
        cost = np.zeros((len(piece), width), np.int32)
        edits, ends = np.full(len(piece), 1 << 30, np.int64), np.zeros(len(piece), np.int64)
        for j in range(pattern.shape[1]):
            text = padded[np.clip(base[:, None] + j + step, 0, len(padded) - 1)]
            new = cost + (text != pattern[:, j:j + 1])
            new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(new - step, axis=1) + step
            done = m == j + 1
            if done.any():
                best = cost[done].argmin(axis=1)
                edits[done] = cost[done, best]
                ends[done] = start[done] + j + 1 + best
        return edits, ends

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, piece, begin, end, edits) of verified pieces; positions
        count characters of the normalised text, ``begin`` by the piece's length."""
        out: set[tuple[int, int, int, int, int]] = set()
        if self.exact:
            for k, t in enumerate(map(normalise, texts)):
                out.update((k, p, 0, len(t), 0) for p in self.exact.get(t, ()))
        if self.small:
            out.update((k, self.first_small + p, *rest) for k, p, *rest in self.small.matches(texts))
        if not self.codes:
            return sorted(out)
        held, size = [], 0

        def work():
            nonlocal held, size
            blank = np.full(self.gap, _NOTHING, np.uint32)
            parts = [x for _, _, c in held for x in (c, blank)]
            codes = np.concatenate([blank, *parts])
            starts = self.gap + np.cumsum([0] + [len(c) + self.gap for _, _, c in held])[:-1]
            piece, diagonal = self.regions(codes)
            edits, ends = self.align(codes, piece, diagonal)
            good = edits <= self.budget[piece]
            piece, edits, ends = piece[good], edits[good], ends[good]
            owner = np.searchsorted(starts, ends - 1, "right") - 1
            for p, o, d, z in zip(piece.tolist(), owner.tolist(), edits.tolist(), ends.tolist()):
                text, offset, _ = held[o]
                end = z - int(starts[o]) + offset
                out.add((text, p, max(0, end - len(self.codes[p])), end, d))
            held, size = [], 0

        overlap = 2 * (self.most + BAND + 2 * self.slack)
        for k, t in enumerate(texts):
            codes = _codes(normalise(t))
            for s in range(0, max(1, len(codes) - overlap), _PART_CHARS - overlap):
                part = codes[s:s + _PART_CHARS]
                if size and size + len(part) + self.gap * (len(held) + 2) > _PART_CHARS:
                    work()
                held.append((k, s, part))
                size += len(part)
        if held:
            work()
        return sorted(out)


_indexes: dict[object, Index] = {}


def _index(shared) -> Index:
    """The index of a broadcast block, built once in each Python worker."""
    if shared.value[0] not in _indexes:
        _indexes.clear()
        _indexes[shared.value[0]] = Index(shared.value[1])
    return _indexes[shared.value[0]]


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text: str = "text",
                     block_chars: int = BLOCK_CHARS) -> list:
    """Broadcast handles of the blocks. Items are cut into parts that overlap
    by a piece, so no row is larger than a fraction of a block; parts are dealt
    to blocks by hash and one block at a time passes through the driver."""
    spark = benchmark.sparkSession
    part = max(4 * PIECE_CHARS, block_chars // 64)
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), r"\s+", " "))
    b = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("item"), t.alias("t"))
    b = b.select("item", "t", F.explode(F.sequence(
        F.lit(0), F.greatest(F.lit(0), F.floor((F.length("t") - PIECE_CHARS) / part)).cast("int"))).alias("k"))
    b = b.select("item", "k", F.col("t").substr(F.col("k") * part + 1, F.lit(part + PIECE_CHARS)).alias("p"))
    total = b.agg(F.sum(F.length("p"))).first()[0] or 0
    blocks = -(-total // block_chars)
    out = []
    for k in range(blocks):
        rows = b.filter(F.pmod(F.xxhash64("item", "k", "p"), F.lit(blocks)) == k).select("item", "p").distinct().collect()
        key = str(uuid.uuid4())
        out.append(spark.sparkContext.broadcast((key, sorted((tuple(r) for r in rows), key=str))))
    return out


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index = _index(shared)
            found = index.matches(b.column("t").to_pylist())
            ids = b.column("id").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[m[0]] for m in found], pa.int64()),
                 pa.array([index.items[m[1]] for m in found], pa.int64()),
                 *[pa.array([m[c] for m in found], pa.int64()) for c in (2, 3, 4)]],
                names=["doc_id", "item_id", "begin", "end", "edits"])
    return run


def _drop(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = np.zeros(b.num_rows, bool)
            hit[[m[0] for m in _index(shared).matches(b.column(text).to_pylist())]] = True
            yield b.filter(pa.array(~hit))
    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per (text, item) that matches: ``doc_id, item_id, n_regions,
    edits`` (the fewest), and the extent ``begin, end`` in the normalised text."""
    bounded_batches(docs.sparkSession)
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t"))
    schema = "doc_id long, item_id long, begin long, end long, edits long"
    found = docs.sparkSession.createDataFrame([], schema)
    for shared in benchmark_blocks(benchmark):
        found = found.unionAll(d.mapInArrow(_find(shared), schema))
    return found.groupBy("doc_id", "item_id").agg(
        F.count("*").alias("n_regions"), F.min("edits").alias("edits"), F.min("begin").alias("begin"), F.max("end").alias("end"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The input rows (all columns) that match no benchmark item."""
    bounded_batches(docs.sparkSession)
    for shared in benchmark_blocks(benchmark):
        docs = docs.mapInArrow(_drop(shared, text), docs.schema)
    return docs


def op9_decontaminate(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
