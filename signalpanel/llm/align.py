"""Cross-tokenizer alignment: which tokens of one vocabulary cover the same
bytes as which tokens of another, and how often each pair meets.

Each text is encoded by both tokenizers. The running byte ends of each side
become an end-to-index dictionary; the sorted intersection of their keys cuts
both id lists into groups, and the links of a group are the pairs of tokens
whose byte ranges overlap. Documents are encoded and cut in slabs; a slab sums
its distinct id pairs (how many of its documents hold each), Spark adds the
sums of all slabs and marks each first id's highest counts, and every slab
takes back the counts of its own pairs to score its documents.

The first vocabulary is byte-level BPE. Its vocabulary file's merges stand in
id order (checked when it is read), which makes the file a table of ranks for
the rank-based encoder; texts over ``RANKED_CHARS`` characters go to the
file's own library, whose pattern matcher has no bound on runs of white space.
Both give the same ids (tested). The second is a piece model with byte
fallback, whose encoder puts a space in front of the text.

Defined results: a NULL or empty text, or one that either tokenizer does not
give back byte for byte (an U+2581 in the text, say), has no tokens, zeros and
the digest ''; every row is a document of its own, whatever its id (NULL
included), so repeated rows count once each; an empty table gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .slabs import cut_slabs, store_slabs

# Fixed values of the contract.
VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"

#: Longer texts are encoded by the vocabulary's own library.
RANKED_CHARS = 100_000
TEXTS_AT_ONCE = 64
_B_BITS = 24  # of the second id in a packed pair
_B_MASK = (1 << _B_BITS) - 1


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: Latin-1's
    visible characters stand for themselves, the rest follow from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE vocabulary: ids of a text, and the bytes of each id."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items()}
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"the merges of {path} do not stand in id order")
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError(f"{path} lacks single bytes: a text might not be given back whole")
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self._ranked = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._own = Tokenizer.from_file(path)
        self._own.encode_special_tokens = True

    def encode(self, text: str) -> list[int]:
        if len(text) > RANKED_CHARS:
            return self._own.encode(text, add_special_tokens=False).ids
        return self._ranked.encode_ordinary(text)


class Pieces:
    """A piece model with byte fallback; it encodes a space and the text."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(m.id_to_piece(i)[1:-1], 16)]) if m.is_byte(i)
                      else m.id_to_piece(i).replace("▁", " ").encode("utf-8") for i in range(m.get_piece_size())]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1) if texts else []


def end_index(ends: np.ndarray, length: int) -> np.ndarray:
    """The end-to-index dictionary of a side: the byte offset is its own hash,
    so the table is addressed by it; 0 where no token ends, else the number of
    tokens up to here."""
    at = np.zeros(length + 1, np.int32)
    at[ends] = np.arange(1, len(ends) + 1)
    return at


def cut_points(at_a: np.ndarray, at_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the byte ends common to both dictionaries cut the token lists."""
    common = np.flatnonzero((at_a > 0) & (at_b > 0))
    return at_a[common], at_b[common]


def linked(ids_a: np.ndarray, at_a: np.ndarray, ids_b: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """Packed id pairs of the tokens whose byte ranges overlap, in order: the
    stretch up to each end of either side lies in one token of both."""
    is_a, is_b = at_a > 0, at_b > 0
    ends = np.flatnonzero(is_a | is_b)
    in_a, in_b = (np.cumsum(x, dtype=np.int32)[ends] - x[ends] for x in (is_a, is_b))
    return ids_a[in_a].astype(np.int64) << _B_BITS | ids_b[in_b]


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self._size_a, self._size_b = (np.array([len(x) for x in side.bytes]) for side in (self.a, self.b))
        self._name_a, self._name_b = [f"{i}|" for i in range(len(self._size_a))], [str(i) for i in range(len(self._size_b))]

    def encode_all(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of both sides of each text, none if the second does not give
        its bytes back (the first always does: it has every single byte)."""
        for text, b in zip(texts, self.b.encode_all([t or "" for t in texts])):
            if not text:
                yield [], []
                continue
            spaced = " " + text
            same = b"".join(map(self.b.bytes.__getitem__, b)) == spaced.encode("utf-8")
            yield (self.a.encode(spaced), b) if same else ([], [])

    def encode(self, text: str | None) -> tuple[list[int], list[int]]:
        return next(self.encode_all([text]))

    def align(self, a: list[int], b: list[int]) -> tuple[list[str], np.ndarray]:
        """The groups as ``a1,a2|b1`` and the packed id pairs of all links."""
        if not a:
            return [], np.zeros(0, np.int64)
        ids_a, ids_b = np.array(a), np.array(b)
        ends_a, ends_b = np.cumsum(self._size_a[ids_a]), np.cumsum(self._size_b[ids_b])
        at_a, at_b = end_index(ends_a, ends_a[-1]), end_index(ends_b, ends_a[-1])
        to_a, to_b = cut_points(at_a, at_b)
        from_a, from_b = np.append(0, to_a[:-1]), np.append(0, to_b[:-1])
        # most groups are one token of each side; the others are put in behind
        name_a, name_b = self._name_a, self._name_b
        groups = [name_a[x] + name_b[y] for x, y in zip(ids_a[from_a].tolist(), ids_b[from_b].tolist())]
        wide = np.flatnonzero((to_a - from_a != 1) | (to_b - from_b != 1))
        for g, i, j, k, m in zip(*(x.tolist() for x in (wide, from_a[wide], to_a[wide], from_b[wide], to_b[wide]))):
            groups[g] = f"{','.join(map(str, a[i:j]))}|{','.join(map(str, b[k:m]))}"
        return groups, linked(ids_a, at_a, ids_b, at_b)


_aligners: dict[tuple, Aligner] = {}


def _aligner(path_a: str, path_b: str) -> Aligner:
    """One per Python worker."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


#: A slab: per document id, counts and digest; its distinct pairs and how many
#: of its documents hold each; per document the distinct pairs (places in that
#: list, as packed differences) and how often each occurs.
_SLAB = ("slab long, id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
         "sha array<string>, pairs array<long>, holders array<long>, n_pairs array<int>, places binary, times binary")


def _pack(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.astype("<i4").tobytes())


def _unpack(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i4")


def _encode_slabs(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        for number, rows in cut_slabs(batches):
            docs = {c: [] for c in ("n_a", "n_b", "n_groups", "n_links", "sha")}
            pairs, times = [], []
            texts = rows.column("t").combine_chunks()
            for k in range(0, len(texts), TEXTS_AT_ONCE):
                for a, b in aligner.encode_all(texts[k:k + TEXTS_AT_ONCE].to_pylist()):
                    groups, links = aligner.align(a, b)
                    own, n = np.unique(links, return_counts=True)
                    pairs.append(own)
                    times.append(n)
                    sha = hashlib.sha256(";".join(groups).encode("ascii")).hexdigest() if groups else ""
                    for c, v in zip(docs, (len(a), len(b), len(groups), len(links), sha)):
                        docs[c].append(v)
            distinct, places, holders = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
            cells = [number, rows.column("id").to_pylist(), *docs.values(), distinct, holders,
                     [len(p) for p in pairs], _pack(np.diff(places, prepend=0)), _pack(np.concatenate(times))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c], _ARROW[k]) for k, c in enumerate(cells)], names=[c.split(" ")[0] for c in _SLAB.split(", ")])
    return run


_ARROW = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), *[pa.list_(pa.int64())] * 2,
          pa.list_(pa.int32()), pa.binary(), pa.binary()]


def pair_counts(slabs: DataFrame) -> DataFrame:
    """Per id pair ``pair, n, best``: documents that hold it, and whether no
    other pair of its first id has more. The rows of a first id are at most
    the second vocabulary."""
    held = slabs.select(F.explode(F.arrays_zip("pairs", "holders")).alias("x"))
    n = held.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.holders").alias("n"))
    most = F.max("n").over(W.partitionBy(F.shiftright("pair", _B_BITS)))
    return n.select("pair", "n", (F.col("n") == most).alias("best"))


def _score_slab(key, slab: pa.Table, counts: pa.Table) -> pa.Table:
    row = slab.to_pylist()[0]
    pair = counts.column("pair").to_numpy()
    order = np.argsort(pair)
    n = counts.column("n").to_numpy()[order]
    best = np.asarray(counts.column("best").to_numpy(zero_copy_only=False), bool)[order]
    places, times = np.cumsum(_unpack(row["places"])), _unpack(row["times"]).astype(np.int64)
    ends = np.cumsum(row["n_pairs"], dtype=np.int64)

    def per_document(x: np.ndarray) -> np.ndarray:
        upto = np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
        return np.diff(upto[np.concatenate(([0], ends))])

    return pa.table({
        **{c: pa.array(row[c], pa.int64()) for c in ("id", "n_a", "n_b", "n_groups", "n_links")},
        "n_best": per_document(times * best[places]), "count_sum": per_document(times * n[places]),
        "groups_sha256": pa.array(row["sha"], pa.string())})


_RESULT = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def encode_slabs(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored slabs of the aligned documents."""
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t"))
    return store_slabs(d.mapInArrow(_encode_slabs(path_a, path_b), _SLAB))


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: id, tokens of both sides, groups, links, links at
    their first id's highest count, the sum of the links' counts, and the
    digest of the groups."""
    slabs = encode_slabs(docs, path_a, path_b, id_col, text)
    own = slabs.select(F.col("slab").alias("taker"), F.explode("pairs").alias("pair")).join(pair_counts(slabs), "pair")
    return (slabs.drop("pairs", "holders").groupBy("slab")
            .cogroup(own.groupBy("taker")).applyInArrow(_score_slab, _RESULT))


def aligned_groups(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The alignment itself: per document ``id`` and ``groups``, an array of
    (ids of the first side, ids of the second side) in text order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in batches:
            out = []
            for t in batch.column("t"):
                groups, _ = aligner.align(*aligner.encode(t.as_py()))
                out.append([dict(zip("ab", ([int(i) for i in side.split(",")] for side in g.split("|")))) for g in groups])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, kind)], names=["id", "groups"])

    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t"))
    return d.mapInArrow(run, "id long, groups array<struct<a: array<int>, b: array<int>>>")


def op13_align(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path_a, path_b = (public_tokenizers.path(v) for v in (VOCABULARY_A, VOCABULARY_B))
    return align_tokens(docs, path_a, path_b).withColumnRenamed("id", "doc_id")
