"""Nulls, empty and very long texts, ties, repeated rows, empty tables and
clashing column names, against the plain versions."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from signalpanel.llm import components, decontam, htmltext, linededup, mixing, pii, quality, simhash, substring, tokenbin, warc

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _texts():
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared = prose(45)
    long = prose(30_000)
    base = prose(400)
    near = base.split()
    near[200] = "changed"
    loop = "a b c d e f g h " * 60
    text_line = "This Line stands in several documents."
    return [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "one two three"), (6, base), (7, base), (8, " ".join(near)),
        (9, f"{prose(30)} {shared} {prose(30)}"), (10, f"{prose(12)} {shared}"), (11, shared), (12, shared + " " + shared),
        (13, loop), (14, f"x\n{text_line}\n{prose(25)}\n  {text_line.upper()}\t\ny"), (15, f"{text_line}\n{text_line}"),
        (16, f"a\n{text_line}\nb\n\n"), (17, long), (18, long[:90_000]), (None, base), (None, "no id at all\n" + text_line),
        (6, base), (20, "é ü ß " * 40), (21, "a b c " * 30), (22, "\n\n\n"), (23, "ONE"), (19, shared.upper()),
        (24, "x" * 70_000), (25, "tab\tand space  mixed " * 20),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if (i or 0) % 5 == 0 else f"s{(i or 0) % 3}", len(t or "")) for i, t in _texts()]
    clash = ["id", "t", "th", "fp", "size", "key", "skey", "range", "row", "doc", "z", "pos", "kept", "gone", "rest", "epoch"]
    d = spark.createDataFrame(rows, SCHEMA)
    return d.select("*", *[F.lit(k).alias(c) for k, c in enumerate(clash)])


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_simhash(docs, empty):
    want = brute.classes([(i, brute.simhash(t)) for i, t in _texts()])
    for n in (None, 2, 3, 4):
        got = simhash.near_duplicates(docs, n_segments=n).select("id", simhash.hex_fingerprint(F.col("fp")), "component_id")
        assert _rows(got) == sorted(((i, f"{fp:016x}", c) for i, fp, c in want), key=str)
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_keep_one(docs, empty):
    want = brute.classes([(i, brute.simhash(t)) for i, t in _texts()])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(got, key=str) == sorted({c for _, _, c in want}, key=str)
    assert simhash.keep_one(empty).count() == 0


def test_simhash_large_entry(spark, monkeypatch):
    """A dense set and a chain: same components with tiny blocks."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 16)
    monkeypatch.setattr(simhash, "MOST_BLOCKS", 4)
    r = random.Random(5)
    fps = {0}
    while len(fps) < 220:
        f = r.choice(sorted(fps))
        for _ in range(r.choice([1, 2, 4])):
            f ^= 1 << r.randrange(64)
        fps.add(f)
    fps |= {r.getrandbits(64) for _ in range(100)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    pairs = simhash._split_large(simhash._entries(df, simhash.segments(3, 4)))
    links = (pairs.repartition("entry", "p", "q").sortWithinPartitions("entry", "p", "q", F.col("home").desc(), "fp")
             .mapInArrow(simhash._link(4), "a long, b long"))
    roots = {r["node"]: r["root"] for r in components.components(links).collect()}
    want = brute.classes([(s, f % (1 << 64)) for s, f in zip(signed, signed)])
    groups = {}
    for s, _, c in want:
        groups.setdefault(c, set()).add(roots.get(s, s))
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len({next(iter(g)) for g in groups.values()})


def test_absorb():
    import numpy as np

    r = random.Random(6)
    fps = np.array([sum(1 << b for b in r.sample(range(64), r.randrange(0, 5))) for _ in range(400)], np.uint64)
    fps = np.unique(fps)
    a, b = simhash._absorb(fps, 4)
    assert (np.bitwise_count(a ^ b) <= 4).all()
    want = {c for _, _, c in brute.classes([(int(f), int(f)) for f in fps])}
    assert len(fps) - len(a) == len(want)


def test_components_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 100), (200, 201), (201, 200)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {**{k: 0 for k in range(61)}, 200: 200, 201: 200}
    assert components.components(links.filter("a < 0")).count() == 0


def test_substring(docs, empty):
    got = substring._cut_all(docs, "doc_id", "text", True)
    assert _rows(got) == sorted(brute.substring(_texts()), key=str)
    assert substring.dedup_substrings(empty).count() == 0


def test_substring_same_id_other_text(spark):
    r = random.Random(9)
    prose = " ".join(r.choice("abcdefghijk") + str(r.randrange(40)) for _ in range(80))
    rows = [(1, prose), (1, "x " + prose + " y"), (2, "p q " + prose), (2, prose[:200])]
    got = substring._cut_all(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", True)
    assert _rows(got) == sorted(brute.substring(rows), key=str)


def test_lines(docs, empty):
    got = linededup._marked(docs, "doc_id", "text", 20, 3).mapInArrow(
        linededup._digest_kept, "id long, n_lines long, n_dropped long, kept_sha256 string")
    assert _rows(got) == sorted(brute.lines(_texts()), key=str)
    assert linededup.dedup_lines(empty).count() == 0


def _doubled(n):
    """Two texts of n characters built by doubling: equal sums under many polynomial hashes."""
    s, t = "a", "b"
    while len(s) < n:
        s, t = s + t, t + s
    return s, t


def test_lines_built_by_doubling(spark):
    s, t = _doubled(4096)
    rows = [(1, s), (2, t), (3, t), (4, f"{s}\nx")]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("id", "n_lines", "n_dropped", "kept")
    assert _rows(got) == sorted(((i, x.count("\n") + 1, 0, x) for i, x in rows), key=str)


def test_tokens_edges(spark, docs, empty, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path(tokenbin.VOCABULARY)
    model = Tokenizer.from_file(path)
    tokenbin.write_shards(docs, str(tmp_path / "a"), path, partitions=3)
    got = tokenbin.read_shards(spark, str(tmp_path / "a"), with_ids=True).collect()
    want = brute.tokens([(i, t) for i, t in _texts()], model)
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[3])  # noqa: E731  equal ids: any order
    assert sorted(((r["id"], 0, r["n_tokens"], r["ids_crc32"]) for r in got), key=key) == sorted(((i, 0, n, c) for i, _, n, c in want), key=key)
    ordered = sorted(got, key=lambda r: r["start"])
    at = 0
    for r in ordered:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        at += r["n_tokens"]
    assert [r["id"] for r in ordered] == sorted([i for i, _ in _texts()], key=lambda i: (i is not None, i or 0))
    tokenbin.write_shards(empty, str(tmp_path / "b"), path)
    assert tokenbin.read_shards(spark, str(tmp_path / "b")).count() == 0


def test_tokens_doubled_texts(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path(tokenbin.VOCABULARY)
    s, t = _doubled(2048)
    rows = [(1, s), (2, t), (3, s + "x"), (4, t + " " + s)]
    tokenbin.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "a"), path, partitions=1)
    got = tokenbin.read_shards(spark, str(tmp_path / "a")).select("id", "start", "n_tokens", "ids_crc32")
    assert _rows(got) == sorted(brute.tokens(rows, Tokenizer.from_file(path)), key=str)


def test_tokens_asked_in_pieces():
    """The library is asked for each piece once, many at a time, whatever its case and the signs beside it."""
    P = pytest.importorskip("public_tokenizers")
    path = P.path(tokenbin.VOCABULARY)
    w, asked = tokenbin.WordTokenizer(path), []

    class Counting:
        def __init__(self, model):
            self.model = model

        def encode_batch_fast(self, texts, **how):
            asked.extend(texts)
            return self.model.encode_batch_fast(texts, **how)

    library, w.model, w.small = w.model, Counting(w.model), Counting(w.small)
    texts = ["House, house. (HOUSE) \u00e9tude; house", "house! \u00e9tude \u00e9tude:", None, ""]
    ids, sizes = w.encode(pa.array(texts))
    ids2, _ = w.encode(pa.array(texts))
    want = [library.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    assert ids.tolist() == ids2.tolist() == sum(want, []) and sizes.tolist() == [len(x) for x in want]
    assert sum(t.split().count("house") for t in asked) == 1 and sum(t.split().count("\u00e9tude") for t in asked) == 1
    assert len([t for t in asked if t]) == 2  # pieces in ASCII, and others


def test_tokens_odd_characters():
    """Random texts of characters that change by case, composition or neighbours: the library's own ids."""
    P = pytest.importorskip("public_tokenizers")
    path = P.path(tokenbin.VOCABULARY)
    w, rng = tokenbin.WordTokenizer(path, keep=3000), np.random.default_rng(5)
    odd = list("aAhHkKsStTiI19.,;'!<|>-_=~ \t\n\x0b\x1c\x1f\x7f\x85\xa0") + list(
        "\u00e9\u00c9\u00df\u0130\u0131\u0149\u017f\u01c5\u0300\u0301\u0307\u0331\u0338\u0345\u037a\u03a3\u03c2\u0416\u1e9e\u1e96"
        "\u212a\u2126\u00bd\u00b2\u0663\u4e2d\u6587\u1100\u1161\u11a8\u3000\u200b\u2028\ufb01\U0001d400\U0001f600\U00010400") + [
        "'re", "'S", "don't", "<|endoftext|>", "<|STARTOFTEXT|>", "house", "House."]
    texts = ["".join(rng.choice(odd, int(rng.integers(1, 25)))) for _ in range(4000)]
    for k in range(0, 4000, 1000):
        part = texts[k:k + 1000]
        ids, sizes = w.encode(pa.array(part))
        want = [e.ids + [1] for e in w.model.encode_batch_fast(part, add_special_tokens=False)]
        assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])


def test_tokens_coder_round_trip():
    """Blocks of unlike lengths and ids at class bounds; guesses that always hit; ids that never repeat."""
    rng = np.random.default_rng(6)
    for n_ids in (600, 49_408, 250_000):
        first, bits = tokenbin.class_bounds(n_ids)
        edge = np.unique(np.concatenate([first, np.minimum(first + (1 << bits), n_ids) - 1]))
        blocks = [rng.integers(0, n_ids, int(n)) for n in rng.integers(1, 1300, 20)]
        blocks += [rng.choice(edge, 700), np.zeros(4096, np.int64), np.full(2049, n_ids - 1), rng.permutation(n_ids)[:4096], edge[:1]]
        coded = tokenbin.encode_blocks(blocks, n_ids)
        got = tokenbin.decode_blocks(coded, [len(b) for b in blocks], n_ids)
        assert all(np.array_equal(x, y) for x, y in zip(blocks, got))
        assert coded == [tokenbin.encode_blocks([b], n_ids)[0] for b in blocks]  # a block stands alone
    assert len(tokenbin.encode_blocks([np.zeros(4096, np.int64)])[0]) < 1200


def test_quality(docs, empty):
    got = {(r["doc_id"], r["n_words"], r["n_repeat_words"]) for r in quality.judge(docs, "text").select("row.doc_id", "n_words", "n_repeat_words").collect()}
    for i, t in _texts():
        w = brute.words(t)
        seen = {}
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k:k + 8]), []).append(k)
        cover = {p for starts in seen.values() if len(starts) > 1 for s in starts for p in range(s, s + 8)}
        assert (i, len(w), len(cover)) in got
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and quality.quality_filter(empty).count() == 0


def test_mixing(docs, empty):
    rows = mixing.plan_mix(docs, rows_per_range=2).collect()
    assert len(rows) == len(_texts())
    by = {}
    for r in rows:
        by.setdefault((r["skey"], r["target"], r["source_size"]), []).append(r)
    assert sum(k[2] for k in by) == sum(len(brute.words(t)) for _, t in _texts())
    for (_, target, size), own in by.items():
        assert sum(r["taken"] for r in own) == int(target) and target <= 3 * size
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)
    mixed = mixing.mixed_rows(docs, rows_per_range=2)
    assert mixed.columns == docs.columns
    words = sum(len(brute.words(r["text"])) for r in mixed.collect())
    assert words == sum(r["taken"] for r in rows)
    again = mixing.mixed_rows(docs.repartition(3), rows_per_range=2)
    assert _rows(mixed) == _rows(again)
    assert mixing.plan_mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0


def test_decontaminate(spark, docs, empty):
    texts = dict((i, t) for i, t in _texts() if i)
    item = " ".join(texts[11].split()[:30])
    edited = item[:40] + "#" + item[42:]
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (None, "short"), (4, edited)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(d, i) for d in (9, 10, 11, 12, 19) for i in (1, 4)}
    left = decontam.decontaminate(docs, bench)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == sorted((i for i, _ in _texts() if i not in (9, 10, 11, 12, 19)), key=str)
    assert decontam.contaminated(empty, bench).count() == 0
    assert decontam.contaminated(docs, bench.filter("false")).count() == 0
    assert decontam.decontaminate(docs, bench.filter("false")).count() == docs.count()


def test_decontaminate_blocks(spark, docs, monkeypatch):
    """Several blocks and parts of a long text give what one gives."""
    long = dict((i, t) for i, t in _texts() if i)[17]
    items = [(k, long[s:s + 220]) for k, s in enumerate(range(0, 90_000, 9_000))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = _rows(decontam.contaminated(docs, bench).select("doc_id", "item_id", "n_regions", "edits"))
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 700)
    blocks = decontam.benchmark_blocks(bench, block_chars=700)
    assert len(blocks) > 2
    index = decontam.Index(items)
    monkeypatch.setattr(decontam, "_PART_CHARS", 5_000)
    parts = {(m[0], m[1]) for m in index.matches([long])}
    monkeypatch.setattr(decontam, "_PART_CHARS", 1 << 20)
    assert parts == {(m[0], m[1]) for m in index.matches([long])}
    assert {(r[0], r[1]) for r in one} >= {(17, k) for k in range(10)}


def test_decontaminate_excerpts():
    """Verbatim runs of long items are found at any offset; edited ones as by brute force."""
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [prose(r.randint(40, 60)) for _ in range(2)] + [prose(7)]
    index = decontam.Index(list(enumerate(items)))
    long = items[0]
    texts = [prose(20) + " " + long[s:s + 70].strip() + " " + prose(20) for s in range(len(long) - 70)]
    assert {m[0] for m in index.matches(texts)} == set(range(len(texts)))
    texts = [prose(20)]
    for _ in range(20):
        i = r.randrange(len(items))
        cut = list(items[i][(s := r.randrange(max(1, len(items[i]) - 75))):s + 75])
        for _ in range(r.randint(2, 10)):
            k = r.randrange(len(cut))
            cut[k:k + r.randint(0, 1)] = [r.choice("xyz"), ""][r.randint(0, 1)]
        texts.append(prose(5) + " " + "".join(cut) + " " + prose(5))
    got = {(m[0], index.items[m[1]]) for m in index.matches(texts)}
    want = {(k, i) for k, t in enumerate(texts) for i, item in enumerate(items) for p in decontam.pieces_of(item)
            if brute.edit_distance_in(p, decontam.normalise(t)) <= decontam.edit_budget(len(p))}
    assert got == want and 0 < len(want) < 20


def test_decontaminate_short_items():
    """Items of 30 and 31 characters with spread edits; items under the least length as whole texts."""
    r = random.Random(2)
    for n in (24, 29, 30, 31, 32, 40, 63, 64, 65):
        item = "".join(r.choice("abcdefghijklmnop") for _ in range(n))
        e = decontam.edit_budget(n)
        at = [(k + 1) * n // (e + 1) - 1 for k in range(e)]
        text = "x y " + "".join("#" if k in at else c for k, c in enumerate(item)) + " z"
        index = decontam.Index([(7, item), (8, "no such text at all " * 5)])
        assert {(m[0], index.items[m[1]], m[4]) for m in index.matches(["", text])} >= {(1, 7, e)}, n
    index = decontam.Index([(1, "What is 2 + 2?"), (2, "yes"), (None, ""), (3, "what is  2 + 2?")])
    got = index.matches(["what is 2 +\n2?", "yes and no", None, "", " YES "])
    assert [(k, index.items[p], *rest) for k, p, *rest in got] == [(0, 1, 0, 14, 0), (0, 3, 0, 14, 0), (4, 2, 0, 3, 0)]


def test_decontaminate_two_benchmarks(spark, monkeypatch):
    """A worker never takes the index of another benchmark, also if that is freed."""
    monkeypatch.setattr(decontam, "id", lambda _: 1, raising=False)
    bench = [spark.createDataFrame([(1, f"{w} " * 12)], "item_id long, text string") for w in ("first", "second")]
    assert len({decontam.benchmark_blocks(b)[0].value[0] for b in bench}) == 2


def test_warc(spark, tmp_path):
    magic = "WARC/1.1\r\n"
    inner = magic + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    same = "<p>" + "same page " * 20
    pages = [(1, "u", None), (2, None, ""), (3, "http://é x\r\n", same), (4, "u", same), (None, "u", same), (3, "u", same),
             (5, "u", "x" * 99), (6, "u", "x" * 99), (7, "u", inner * 3), (8, "u", "a" + magic), (9, "u", magic),
             (10, "u", "y" * 300_000 + inner + "z" * 300_000), (11, "u", "\r\n\r\n" + inner), (12, "u", inner)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(df.coalesce(2), path, records_per_file=5)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for split in ("1000", "65536", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        got = [r.asDict() for r in warc.read_archives(spark, path, payload=True).collect()]
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert len(got) == len(pages)
        bodies = sorted((r["page_id"] or -1, bytes(r["payload"])) for r in got if r["type"] == "response")
        want = sorted((i or -1, (h or "").encode()) for i, _, h in pages if not (h == same and i != 3))
        assert bodies == want
        assert sorted(r["page_id"] or -1 for r in got if r["type"] == "revisit") == [-1, 4]
        assert all(r["refers_to"] == 3 for r in got if r["type"] == "revisit")
        import hashlib
        assert all(r["sha"] == hashlib.sha256(bytes(r["payload"])).hexdigest() for r in got)
    none = str(tmp_path / "none")
    warc.write_archives(df.filter("false"), none)
    assert warc.read_archives(spark, none).count() == 0


def test_html(spark):
    pages = [(1, None), (2, ""), (3, "<p>unclosed <b>bold<p>next"), (None, "x"), (4, "<" * 50 + "a" * 5000)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract_text(spark.createDataFrame(pages, "page_id long, html string")).collect()}
    assert got[1] == got[2] == "" and got[3] == "unclosed bold\n\nnext" and got[None] == "x" and "aaaaa" in got[4]


def test_pii_edges(docs, empty):
    got = pii.find_pii(docs)
    assert got.count() == len(_texts()) and pii.find_pii(empty).count() == 0
    assert got.filter("base_sha256 is null or spans is null").count() == 0
