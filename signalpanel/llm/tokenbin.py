"""Token-ID output: binary shards of context-mixing range-coded blocks.

Texts are ranged by id, tokenized, and cut into blocks of ``BLOCK_IDS`` ids.
Each block is coded on its own: models start afresh, and its header carries a
CRC-32 of the ids and of the coded bytes, so a block can be read or rejected
without any other.

The probability of an id mixes three predictions in one arithmetic-coding
interval: the id that last followed the two ids before it (order 2), the id
that last followed the id before it (order 1), and adaptive frequencies
(order 0). The weight of the first two grows with the hits and falls with the
misses of each context. Order 0 counts id classes, narrow where ids are small
and wider (powers of two) where they are large; the place inside a class is
coded evenly. Many blocks run through the coder side by side as NumPy lanes,
each with its own state, so the cost of a step is shared while every lane stays
an independent stream. The encoder knows all ids, so only its contexts and its
range go step by step; classes, weights and intervals are taken in spans.

Shards are written by Spark's text writer (raw bytes, one line end per block,
which the block headers count in) and read by its binary-file reader, so any
file system that Spark knows will do.

Defined results: NULL and empty texts are just the end id; documents with
equal ids are ordered by text hash, NULL ids come first; an empty table gives
no rows.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, cut, shared_folder

# Fixed values of the contract.
VOCABULARY = "word_bpe_49k.json"
N_IDS = 49_408
END_ID = 1

BLOCK_IDS = 4096
#: Blocks that run side by side at most.
LANES = 2048
#: Text bytes tokenized at once.
BATCH_BYTES = 16 << 20
#: Texts per shard file at most (a file is read in one task).
DOCS_PER_SHARD = 20_000
_MAGIC = b"TKC2"
_HEAD = struct.Struct("<4sIIIIIIII")  # magic, shard, block, ids, documents, index bytes, coded bytes, CRCs

# Coder: 63-bit low and range, 32-bit words out, carries added at the end; interval total 2^16, order 0 in 2^12.
_TOTAL, _SCALE = 16, 12
_WORD, _TOP, _TO16 = np.uint64(32), np.uint64(31), np.uint64(_TOTAL)
_LEAST, _LOW31, _LOW32 = np.uint64(1 << 31), np.uint64((1 << 31) - 1), np.uint64(0xFFFFFFFF)
_SLOTS = 1 << 11  # context slots per lane and order
_SPAN = 32  # ids whose classes and intervals are taken at once
_REFRESH = 1024  # ids between updates of the order-0 intervals, at most
_GAIN = 6  # what an id adds to the count of its class


def class_bounds(n_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """First ids of the classes and the bits of their widths: 8 wide below
    512, then the largest power of two within a fortieth of the distance from 512."""
    firsts, bits, at = [], [], 0
    while at < n_ids:
        b = 3 if at < 512 else max(1, (at - 512) // 40).bit_length() - 1
        firsts.append(at)
        bits.append(b)
        at += 1 << b
    return np.array(firsts, np.int64), np.array(bits, np.int64)


def _weights() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By 16 times the confidence of order 2 plus that of order 1 (0: no guess
    of its own): the end of order 2's interval, the end of both orders', and
    the sixteenths that are left to order 0 (one at least)."""
    two, both, left = (np.zeros(256, np.int64) for _ in range(3))
    share = [0.0] + [(c + 0.15) / (c + 3.0) for c in range(15)]  # hits over tries, roughly
    most = 1 - 2.0 ** (_SCALE - _TOTAL)
    for k in range(256):
        w2 = share[k >> 4] * most
        w12 = w2 + share[k & 15] * (most - w2)
        left[k] = min(15, max(1, round((1 - w12) * 16))) if k else 16
        both[k] = (16 - left[k]) << _SCALE
        two[k] = int(both[k] * w2 / w12) if k & 15 else both[k]
    return two, both, left


_TWO, _BOTH, _LEFT = _weights()
_PER_LEFT = 1 / _LEFT
#: What a confidence (0: empty, else 1 to 15) gains by a miss (0 to 15) and by a hit (16 and more).
_STEP = np.array([((c - 1) >> 1) + 1 - c for c in range(16)] + [1] * 15 + [0], np.int32)


class _Lanes:
    """Models of blocks that run side by side, longest first."""

    def __init__(self, n: int, n_ids: int, decode: bool):
        self.first, self.bits = class_bounds(n_ids)
        self.classes = len(self.first)
        self.class_of = np.repeat(np.arange(self.classes), np.diff(np.append(self.first, n_ids)))
        self.base = np.arange(2 * n).reshape(2, n) * _SLOTS  # order 2, order 1
        self.follow = np.zeros(2 * n * _SLOTS, np.int32)  # (id + 1) * 16 + confidence
        self.class_base = np.arange(n) * self.classes
        self.counts = np.ones((n, self.classes), np.int32)
        self.part = np.zeros(n * self.classes, np.int32)  # start * 2^13 + size of a class's interval
        # class of each of the 2^12 parts; 16 spare rows in front are met by lanes that hit a guess
        self.slot_base = (np.arange(n) + 16) << _SCALE
        self.slots = np.zeros((n + 16) << _SCALE, np.int16) if decode else None
        self.range = np.full(n, _LEAST)
        self._intervals(n)

    def _intervals(self, a: int) -> None:
        """Order-0 intervals in 2^12 parts, at least one part per class."""
        upto = np.cumsum(self.counts[:a], axis=1, dtype=np.int32)
        spare = (1 << _SCALE) - self.classes
        ends = (upto * (spare / upto[:, -1:])).astype(np.int32)
        ends[:, -1] = spare
        ends += np.arange(1, self.classes + 1, dtype=np.int32)
        sizes = np.diff(ends, axis=1, prepend=np.int32(0))
        self.part[:a * self.classes] = (((ends - sizes) << 13) | sizes).ravel()
        if self.slots is not None:
            classes = np.tile(np.arange(self.classes, dtype=np.int16), a)
            self.slots[16 << _SCALE:(a + 16) << _SCALE] = np.repeat(classes, sizes.ravel())

    def count(self, a: int, ids: np.ndarray) -> None:
        seen = (self.class_of.take(ids) + self.class_base[:a, None]).ravel()
        self.counts[:a] += _GAIN * np.bincount(seen, minlength=a * self.classes).reshape(a, self.classes).astype(np.int32)
        self._intervals(a)

    def learn(self, at: np.ndarray, held: np.ndarray, fresh: np.ndarray) -> None:
        """A context's guess gains confidence by a hit, loses half by a miss,
        and gives way at none."""
        conf = held & 15
        conf += ((held ^ fresh) < 16) * np.int32(16)
        self.follow[at] = np.where(conf < 2, fresh + 1, held + _STEP.take(conf))


def _in_lanes(lengths: list[int]) -> Iterator[np.ndarray]:
    order = np.argsort(-np.array(lengths, np.int64), kind="stable")
    groups = -(-len(order) // LANES)
    yield from np.array_split(order, groups) if groups else ()


def _due(t: int) -> bool:
    """Whether the order-0 intervals follow the counts at step ``t``."""
    return t % _REFRESH == 0 or (t < _REFRESH and t >= 4 * _SPAN and t & (t - 1) == 0)


def _spans(lengths: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Steps (from, to) and the number of lanes at work in all of them."""
    t = 0
    while t < lengths[0]:
        a = int(np.searchsorted(-lengths, -t, "left"))
        end = min(int(lengths[a - 1]), (t // _SPAN + 1) * _SPAN)
        yield t, end, a
        t = end


def encode_blocks(blocks: list[np.ndarray], n_ids: int = N_IDS) -> list[bytes]:
    """Coded bytes of each block of ids (each at least one id)."""
    out: list[bytes] = [b""] * len(blocks)
    for group in _in_lanes([len(b) for b in blocks]):
        lengths = np.array([len(blocks[g]) for g in group], np.int64)
        n, longest = len(group), int(lengths[0])
        ids = np.zeros((n, longest), np.int32)
        for k, g in enumerate(group):
            ids[k, :lengths[k]] = blocks[g]
        lanes, seen = _Lanes(n, n_ids, False), 0
        low, rng = np.zeros(n, np.uint64), lanes.range
        words, pos = np.zeros((longest + 1) * n, np.uint64), np.arange(n)  # a word of all lanes, then the next
        prev, mixed = np.zeros((1, n), np.int32), np.zeros((1, n), np.int32)
        for t, end, a in _spans(lengths):
            now = np.add(ids[:a, t:end].T, np.int32(1), order="C")
            prev = np.concatenate([prev[-1:, :a], now ^ (now >> 12)])
            mixed = np.concatenate([mixed[-1:, :a], _mixed(prev[:-1], now)])
            at = lanes.base[:, :a] + (np.stack([mixed[:-1], prev[:-1]], 1) & (_SLOTS - 1))
            held, fresh = np.zeros(at.shape, np.int32), now << 4
            for k in range(end - t):
                lanes.follow.take(at[k], out=held[k], mode="clip")
                lanes.learn(at[k], held[k], fresh[k])
            guess, conf = held >> 4, held & 15
            w = (conf[:, 0] * 16 + conf[:, 1] * (guess[:, 0] != guess[:, 1])).astype(np.intp)
            two, both, left = _TWO.take(w), _BOTH.take(w), _LEFT.take(w)
            hit2 = guess[:, 0] == now
            hit1 = (guess[:, 1] == now) & ~hit2
            miss = ~(hit1 | hit2)
            c = lanes.class_of.take(now - 1)
            p = lanes.part.take(lanes.class_base[:a] + c)
            lo = (np.where(hit1, two, both + left * (p >> 13)) * ~hit2).view(np.uint64)
            size = np.where(hit2, two, np.where(hit1, both - two, left * (p & 8191))).view(np.uint64)
            bits = (lanes.bits.take(c) * miss).view(np.uint64)
            place = ((now - 1 - lanes.first.take(c)) * miss).view(np.uint64)
            low_, rng_, pos_ = low[:a], rng[:a], pos[:a]
            for k in range(end - t):
                r = rng_ >> _TO16
                rng_ = (r * size[k]) >> bits[k]
                low_ = low_ + r * lo[k] + rng_ * place[k]
                words[pos_] = low_ >> _TOP  # stays if the lane moves on
                move = rng_ < _LEAST
                pos_ = pos_ + move * n
                low_ = np.where(move, (low_ & _LOW31) << _WORD, low_)
                rng_ = rng_ << (move * _WORD)
            low[:a], rng[:a], pos[:a] = low_, rng_, pos_
            if _due(end) and end < longest:
                lanes.count(a, ids[:a, seen:end])
                seen = end
        for k, g in enumerate(group):
            own = words[k:pos[k]:n]
            whole = int.from_bytes((own & _LOW32).astype(">u4").tobytes(), "big")
            whole += int.from_bytes((own >> _WORD).astype(">u4").tobytes(), "big") << 32  # carries
            out[g] = ((whole << 63) + int(low[k])).to_bytes(4 * len(own) + 4, "big")
    return out


def _mixed(prev: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Hash of the last two ids."""
    return (prev * np.int32(5) + now * np.int32(2333)) ^ (now >> 3)


def decode_blocks(coded: list[bytes], lengths_in: list[int], n_ids: int = N_IDS) -> list[np.ndarray]:
    """Ids of each coded block."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(coded)
    for group in _in_lanes(lengths_in):
        lengths = np.array([lengths_in[g] for g in group], np.int64)
        n, longest = len(group), int(lengths[0])
        words = np.zeros((max(len(coded[g]) for g in group) // 4 + 1, n), np.uint64)
        for k, g in enumerate(group):
            own = np.frombuffer(coded[g], ">u4")
            words[:len(own), k] = own
        code, pos, words = words[0].copy(), np.arange(n) + n, words.ravel()
        lanes, seen = _Lanes(n, n_ids, True), 0
        ids, first = np.zeros((n, longest), np.int32), lanes.first + 1
        at, prev, rng = lanes.base, np.zeros(n, np.int32), lanes.range
        for t, end, a in _spans(lengths):
            at, prev, code, pos, rng = at[:, :a].copy(), prev[:a], code[:a], pos[:a], rng[:a]
            base2, base1 = lanes.base[:, :a]
            slot_base, class_base = lanes.slot_base[:a], lanes.class_base[:a]
            done = np.zeros((end - t, a), np.int32)
            for k in range(end - t):
                held = lanes.follow.take(at)
                conf, (guess2, guess1) = held & 15, held >> 4
                w = (conf[0] * 16 + conf[1] * (guess2 != guess1)).astype(np.intp)
                two, both, left = _TWO.take(w), _BOTH.take(w), _LEFT.take(w)
                r = rng >> _TO16
                part = (code // r).view(np.int64)
                hit2, hit = part < two, part < both
                # exact in floating point: at least half a sixteenth from any border
                c = lanes.slots.take(slot_base + ((part - both + 0.5) * _PER_LEFT.take(w)).astype(np.intp)).astype(np.intp)
                p = lanes.part.take(class_base + c)
                lo = np.where(hit, two, both + left * (p >> 13)) * ~hit2
                size = np.where(hit2, two, np.where(hit, both - two, left * (p & 8191)))
                bits = lanes.bits.take(c) * ~hit
                code = code - r * lo.view(np.uint64)
                rng = (r * size.view(np.uint64)) >> bits.view(np.uint64)
                place = code // rng
                code -= rng * place
                now = np.where(hit2, guess2, np.where(hit, guess1, first.take(c) + place.view(np.int64))).astype(np.int32)
                done[k] = now
                move = rng < _LEAST
                shift = move * _WORD
                code = (code << shift) | (words.take(pos, mode="clip") * move)
                rng = rng << shift
                pos = pos + move * n
                lanes.learn(at, held, now << 4)
                np.add(base2, _mixed(prev, now) & (_SLOTS - 1), out=at[0])
                prev = now ^ (now >> 12)
                np.add(base1, prev & (_SLOTS - 1), out=at[1])
            ids[:a, t:end] = done.T - 1
            if _due(end) and end < longest:
                lanes.count(a, ids[:a, seen:end])
                seen = end
        for k, g in enumerate(group):
            out[g] = ids[k, :lengths[k]]
    return out


# ------------------------------------------------------------------ tokenizing

#: How the vocabulary cuts a text: what the pieces below rely on.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Pieces that the library is given as one text; longer ones are not kept.
_JOINED, _KEPT_CHARS = 200, 100


class WordTokenizer:
    """The library's tokenizer, asked once per distinct piece.

    The vocabulary's pre-tokenizer always splits at white space, so the ids of
    a text are those of its chunks between ASCII white space in a row. Plain
    chunks (printable ASCII but for the apostrophe and ``<``, and letters that
    the library was seen to take as such) are cut further, into runs of
    letters, single digits and runs of signs, ASCII letters lower-cased, as the
    vocabulary does. Pieces go to the library many to a text, one space between
    them; each is one word to it, so its ids end with the one that closes a
    word. Pieces in lower-case ASCII are in normal form, so just the library's byte and
    merge steps are left to them. Other chunks go to it one by one."""

    def __init__(self, path: str, end_id: int = END_ID, keep: int = 750_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.model, self.end_id, self.keep = Tokenizer.from_file(path), end_id, keep
        self.small = Tokenizer(self.model.model)  # for lower-case ASCII pieces, which need no more normalizing or cutting
        self.small.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        letters = self._letters() if self._known_cut() else None
        self.plain = None if letters is None else f"^[!-&(-;=-~{letters}]+$"
        self.one = f"^([A-Za-z{letters}]+|[0-9]|[^A-Za-z0-9{letters}]+)$"
        self.cut = f"([A-Za-z{letters}]+|[0-9]|[^A-Za-z0-9{letters}]+)"
        vocabulary = self.model.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _known_cut(self) -> bool:
        """Whether the vocabulary cuts and normalizes texts in the way that plain chunks rely on."""
        rules = json.loads(self.model.to_str())
        normal, cuts = rules.get("normalizer") or {}, rules.get("pre_tokenizer") or {}
        cuts = cuts.get("pretokenizers") or [{}]
        return (normal.get("normalizers") == _NORMAL and rules["model"].get("end_of_word_suffix") == "</w>"
                and cuts[0] == {"type": "Split", "pattern": {"Regex": _PIECES}, "behavior": "Removed", "invert": True}
                and [c.get("type") for c in cuts[1:]] == ["ByteLevel"] and not cuts[1].get("use_regex", True)
                and all("<" in t["content"] for t in rules["added_tokens"]))

    def _letters(self) -> str:
        """Letters up to the Cyrillic ones that stay letters when the library normalizes them."""
        def kept(c: str) -> bool:
            words = self.model.pre_tokenizer.pre_tokenize_str(self.model.normalizer.normalize_str(f"a{c}a.1{c}."))
            return [at for _, at in words] == [(0, 3), (3, 4), (4, 5), (5, 6), (6, 7)]

        return "".join(c for c in map(chr, range(0xAA, 0x530)) if c.isalpha() and kept(c))

    def _forget(self):
        self.known: dict[str, int] = {}  # places of pieces
        self.flat, self.ends, self.met = np.zeros(0, np.int32), np.zeros(1, np.int32), np.zeros(0, np.int32)

    def _thin(self):
        """Forget the pieces that one batch alone has met (all, if few are such)."""
        old, met = self.known, self.met > 1
        places = [(x, p) for x, p in old.items() if met[p]]
        held = pa.ListArray.from_arrays(pa.array(self.ends), pa.array(self.flat))
        self._forget()
        if 0 < len(places) <= self.keep // 2:
            got = held.take(pa.array([p for _, p in places], pa.int64()))
            self.known = {x: k for k, (x, _) in enumerate(places)}
            self.flat, self.ends = got.flatten().to_numpy(), got.offsets.to_numpy()
            self.met = np.zeros(len(places), np.int32)

    def _one_by_one(self, names: list[str]) -> list[np.ndarray]:
        got = []
        for k in range(0, len(names), 20_000):
            part = self.model.encode_batch_fast(names[k:k + 20_000], add_special_tokens=False)
            got += [np.array(e.ids, np.int32) for e in part]
        return got

    def _words(self, model, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids in a row and their numbers of pieces that are one word each."""
        ids, sizes = [], []
        for k in range(0, len(names), 100 * _JOINED):
            groups = [names[j:j + _JOINED] for j in range(k, min(len(names), k + 100 * _JOINED), _JOINED)]
            for group, e in zip(groups, model.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
                own = np.array(e.ids, np.int32)
                ends = np.flatnonzero(self.closes[own]) + 1
                if len(ends) == len(group) and ends[-1] == len(own):
                    ids.append(own)
                    sizes.append(np.diff(ends, prepend=0))
                else:  # a piece that is not one word to the library
                    apart = self._one_by_one(group)
                    ids += apart
                    sizes.append(np.array([len(x) for x in apart]))
        return np.concatenate(ids), np.concatenate(sizes)

    def _add(self, names: list[str]) -> np.ndarray:
        """Places of new pieces."""
        first, places = len(self.ends) - 1, np.zeros(len(names), np.int64)
        words = low = np.zeros(len(names), bool)
        if self.plain is not None:
            texts = pa.array(names, pa.string())
            words = pc.match_substring_regex(texts, self.plain)
            words = pc.and_(words, pc.match_substring_regex(texts, self.one)).to_numpy(zero_copy_only=False)
            low = pc.and_(pc.string_is_ascii(texts), pc.equal(pc.ascii_lower(texts), texts)).to_numpy(zero_copy_only=False)
        flat, sizes = [self.flat], []
        for own, model in ((words & low, self.small), (words & ~low, self.model), (~words, None)):
            which = np.flatnonzero(own)
            if len(which):
                part = [names[k] for k in which.tolist()]
                if model is not None:
                    ids, size = self._words(model, part)
                else:
                    got = self._one_by_one(part)
                    ids, size = np.concatenate(got), np.array([len(x) for x in got])
                flat.append(ids)
                sizes.append(size)
                places[which] = first + np.arange(len(which))
                first += len(which)
        self.flat = np.concatenate(flat)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes))]).astype(np.int32)
        self.met = np.concatenate([self.met, np.zeros(len(names), np.int32)])
        self.known.update((x, p) for x, p in zip(names, places.tolist()) if len(x) <= _KEPT_CHARS)
        return places

    def _pieces(self, chunks: pa.StringArray) -> pa.ListArray:
        """The pieces of distinct chunks."""
        if self.plain is None:
            return pa.ListArray.from_arrays(pa.array(np.arange(len(chunks) + 1, dtype=np.int32)), chunks)
        plain = pc.match_substring_regex(chunks, self.plain)
        small = pc.and_(plain, pc.string_is_ascii(chunks))
        chunks = pc.if_else(small, pc.ascii_lower(chunks), chunks)
        several = pc.and_(plain, pc.invert(pc.match_substring_regex(chunks, self.one)))
        apart = pc.replace_substring_regex(chunks.filter(several), self.cut, r"\1 ")
        return pc.ascii_split_whitespace(pc.replace_with_mask(chunks, several, pc.ascii_rtrim_whitespace(apart)))

    def _lists(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks in a row, and their numbers."""
        if len(self.known) > self.keep or len(self.flat) > 8 * self.keep:
            self._thin()
        lists = self._pieces(chunks)
        pieces = lists.flatten().dictionary_encode()
        names = pieces.dictionary.to_numpy(zero_copy_only=False)
        places = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(places < 0)
        if len(new):
            places[new] = self._add(names[new].tolist())
        self.met[places] += 1
        places = places[pieces.indices.to_numpy(zero_copy_only=False)]
        got = pa.ListArray.from_arrays(pa.array(self.ends), pa.array(self.flat)).take(pa.array(places))
        offsets = lists.offsets.to_numpy()
        return got.flatten().to_numpy(), np.diff(got.offsets.to_numpy()[offsets - offsets[0]])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, an end id behind each, and the lengths."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        flat = lists.flatten().dictionary_encode()
        bounds = np.asarray(lists.offsets.to_numpy(), np.int64)
        bounds = bounds - bounds[0]
        own, sizes = self._lists(flat.dictionary)
        own, sizes = np.append(np.int32(self.end_id), own), np.append(1, sizes)  # place 0 is the end id
        held = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(own, pa.int32()))
        places = np.insert(flat.indices.to_numpy(zero_copy_only=False) + np.int32(1), bounds[1:], 0)
        got = held.take(pa.array(places))
        ends = bounds + np.arange(len(bounds))
        return got.flatten().to_numpy(), np.diff(got.offsets.to_numpy()[ends]).astype(np.int64)


_tokenizers: dict[tuple, WordTokenizer] = {}


def tokenizer(path: str, end_id: int) -> WordTokenizer:
    """One per Python worker, so that its chunks serve all tasks of the worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, end_id) not in _tokenizers:
        _tokenizers[path, end_id] = WordTokenizer(path, end_id)
    return _tokenizers[path, end_id]


# ------------------------------------------------------------------ the format

def _index_bytes(docs: list[tuple[int | None, int]]) -> bytes:
    """Ids (with a NULL flag) and lengths of the documents that start in a block."""
    flags = np.array([d is None for d, _ in docs], np.uint8)
    ids = np.array([d or 0 for d, _ in docs], "<i8")
    return zlib.compress(flags.tobytes() + ids.tobytes() + np.array([n for _, n in docs], "<i8").tobytes(), 6)


def _index_of(data: bytes, n: int) -> list[tuple[int | None, int]]:
    raw = zlib.decompress(data)
    ids, sizes = np.frombuffer(raw, "<i8", n, n), np.frombuffer(raw, "<i8", n, 9 * n)
    return [(None if f else i, s) for f, i, s in zip(raw[:n], ids.tolist(), sizes.tolist())]


def pack_blocks(shard: int, first: int, blocks: list[tuple[np.ndarray, list]], n_ids: int) -> list[bytes]:
    """Whole block records, without the line end that the writer adds."""
    coded = encode_blocks([b for b, _ in blocks], n_ids)
    out = []
    for k, ((ids, docs), c) in enumerate(zip(blocks, coded)):
        index = _index_bytes(docs)
        head = _HEAD.pack(_MAGIC, shard, first + k, len(ids), len(docs), len(index), len(c),
                          zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(index + c))
        out.append(head + index + c)
    return out


def unpack_blocks(data: bytes) -> list[tuple[int, int, int, list, bytes, int]]:
    """(shard, block, ids, documents, coded bytes, CRC of the ids) of a file; a damaged record raises."""
    out, at = [], 0
    while at < len(data):
        magic, shard, block, n, docs, ni, nc, crc, check = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        body = data[at:at + ni + nc]
        if magic != _MAGIC or len(body) != ni + nc or zlib.crc32(body) != check:
            raise ValueError(f"damaged block at byte {at - _HEAD.size}")
        out.append((shard, block, n, _index_of(body[:ni], docs), body[ni:], crc))
        at += ni + nc + 1
    return out


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of some ``BATCH_BYTES``, so that words in many texts are looked up once."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= BATCH_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _write(path: str, end_id: int, n_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, first = TaskContext.get().partitionId(), 0
        ids, docs = np.zeros(0, np.int32), []  # documents: (id, length, start in ids)

        def flush(last: bool):
            nonlocal ids, docs, first
            upto = len(ids) if last else len(ids) // BLOCK_IDS * BLOCK_IDS
            blocks, d = [], 0
            for s in range(0, upto, BLOCK_IDS):
                own = []
                while d < len(docs) and docs[d][2] < s + BLOCK_IDS:
                    own.append(docs[d][:2])
                    d += 1
                blocks.append((ids[s:min(upto, s + BLOCK_IDS)], own))
            ids, docs = ids[upto:], [(i, n, s - upto) for i, n, s in docs[d:]]
            records = pack_blocks(shard, first, blocks, n_ids)
            first += len(blocks)
            return pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["value"])

        for b in _gathered(batches):
            new, sizes = tokenizer(path, end_id).encode(b.column("t"))
            starts = len(ids) + np.cumsum(sizes) - sizes
            ids = np.concatenate([ids, new])
            docs += list(zip(b.column("id").to_pylist(), sizes.tolist(), starts.tolist()))
            if len(ids) >= LANES * BLOCK_IDS:
                yield flush(False)
        if len(ids):
            yield flush(True)
    return run


def write_shards(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text: str = "text",
                 end_id: int = END_ID, n_ids: int = N_IDS, partitions: int | None = None) -> None:
    """Write the ids of all texts in ascending id order; shard k holds the
    k-th range of ids."""
    spark = docs.sparkSession
    bounded_batches(spark)
    t = F.col(f"`{text}`")
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(t).alias("h"), t.alias("t"))
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // DOCS_PER_SHARD))
    (d.repartitionByRange(n, "id").sortWithinPartitions("id", "h").select("id", "t")
     .mapInArrow(_write(vocabulary, end_id, n_ids), "value binary").select(F.col("value").cast("string"))
     .write.text(path))


def _read(n_ids: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content").to_pylist():
                yield from _read_file(data, n_ids, with_ids)
    return run


def _read_file(data: bytes, n_ids: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Documents of one shard file; ``LANES`` blocks are decoded at a time."""
    blocks = sorted(unpack_blocks(data), key=lambda x: x[1])
    ids, docs, place = np.zeros(0, np.int32), [], 0
    for k in range(0, len(blocks), LANES):
        part = blocks[k:k + LANES]
        decoded = decode_blocks([p[4] for p in part], [p[2] for p in part], n_ids)
        for p, x in zip(part, decoded):
            if zlib.crc32(x.astype("<u4").tobytes()) != p[5]:
                raise ValueError(f"block {p[1]} of shard {p[0]} does not hold the ids that its checksum names")
            docs += p[3]
        ids = np.concatenate([ids, *decoded])
        rows, at, d = [], 0, 0
        while d < len(docs) and at + docs[d][1] <= len(ids):
            own = ids[at:at + docs[d][1]].astype("<u4").tobytes()
            rows.append((part[0][0], place + at, docs[d][0], docs[d][1], zlib.crc32(own), own))
            at, d = at + docs[d][1], d + 1
        ids, docs, place = ids[at:], docs[d:], place + at
        columns = [pa.array(c, pa.int64()) for c in zip(*[r[:5] for r in rows])] or [pa.array([], pa.int64())] * 5
        names = ["shard", "place", "id", "n_tokens", "ids_crc32"]
        if with_ids:
            columns.append(pa.array([r[5] for r in rows], pa.binary()))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names=names)
    if docs or len(ids):
        raise ValueError("the shard ends inside a document")


def read_shards(spark: SparkSession, path: str, n_ids: int = N_IDS, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: ``shard, place, id, start, n_tokens,
    ids_crc32`` and, if asked, ``ids`` (little-endian 32-bit)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    schema = "shard long, place long, id long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    docs = cut(files.mapInArrow(_read(n_ids, with_ids), schema))
    totals = docs.groupBy("shard").agg(F.sum("n_tokens").alias("all"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("shard", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    return docs.join(totals, "shard").withColumn("start", F.col("base") + F.col("place"))


def op6_token_ids(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = shared_folder(spark, "tokens")
    write_shards(docs, path, public_tokenizers.path(VOCABULARY))
    return read_shards(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")
