"""Plain versions of the operators' contracts, for small tables."""

import hashlib
import math
import re
import zlib

import xxhash

SCALE = 1_000_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def simhash(text, shingle=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(lowered)
    if not w:
        return 0
    grams = [" ".join(w[k:k + shingle]) for k in range(max(1, len(w) - shingle + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(prints, bits=4):
    """Smallest id reachable, by label spreading over all pairs."""
    rows = list(prints)
    best = {}
    for i, fp in rows:
        if i is not None:
            best[fp] = min(best.get(fp, i), i)
        else:
            best.setdefault(fp, None)
    fps = list(best)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for k, a in enumerate(fps):
        for b in fps[k + 1:]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    low = {}
    for f in fps:
        r = find(f)
        if best[f] is not None:
            low[r] = min(low.get(r, best[f]), best[f])
    return [(i, fp, low.get(find(fp))) for i, fp in rows]


def substring(rows, window=20):
    """rows: (id, text); equal ids: one document."""
    low = -(2 ** 63)
    first = {}
    for i, t in rows:
        w = words(t)
        d = low if i is None else i
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            first[key] = min(first.get(key, (d, k)), (d, k))
    out = []
    for i, t in rows:
        w = words(t)
        d = low if i is None else i
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < (d, k):
                gone[k:k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), sha(kept)))
    return out


def lines(rows, min_chars=20, min_docs=3):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    low = -(2 ** 63)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(low if i is None else i)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        d = low if i is None else i
        kept = [x for x in ls if not (len(holders.get(key(x), ())) >= min_docs and d != max(holders[key(x)]))]
        out.append((i, len(ls), len(ls) - len(kept), sha("\n".join(kept))))
    return out


def tokens(rows, model, end_id=1):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = model.encode(t or "", add_special_tokens=False).ids + [end_id]
        crc = zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
        out.append((i, start, len(ids), crc))
        start += len(ids)
    return out


def edit_distance_in(pattern, text):
    """Least edits of the whole pattern against any part of the text."""
    row = [0] * (len(text) + 1)
    for k, p in enumerate(pattern, 1):
        new = [k]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def align(rows, model_a, model_b):
    """rows: (id, text); model_a from the tokenizers library, model_b from sentencepiece."""
    def token_bytes_b(i):
        return bytes([int(model_b.id_to_piece(i)[3:5], 16)]) if model_b.is_byte(i) else model_b.id_to_piece(i).replace("▁", " ").encode()

    def spans(ids, texts):
        out, at = [], 0
        for i, t in zip(ids, texts):
            out.append((i, at, at + len(t)))
            at += len(t)
        return out

    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    back = {chr(b): b for b in printable}
    for b in range(256):
        if b not in printable:
            back[chr(256 + len(back) - len(printable))] = b
    docs, held = [], {}
    for i, t in rows:
        a = b = []
        if t:
            a = model_a.encode(" " + t, add_special_tokens=False).ids
            b = model_b.encode(t)
            bytes_a = [bytes(back[c] for c in model_a.id_to_token(x)) for x in a]
            bytes_b = [token_bytes_b(x) for x in b]
            if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
                a = b = []
        if not a:
            docs.append((i, [], [], [], []))
            continue
        sa, sb = spans(a, bytes_a), spans(b, bytes_b)
        links = [(x, y) for x, f, g in sa for y, h, k in sb if f < k and h < g] if len(sa) * len(sb) < 4e6 else _sweep(sa, sb)
        cuts = sorted({g for _, _, g in sa} & {g for _, _, g in sb})
        names, low = [], 0
        for c in cuts:
            names.append(",".join(str(x) for x, f, g in sa if low <= f and g <= c) + "|"
                         + ",".join(str(x) for x, f, g in sb if low <= f and g <= c)) if len(cuts) < 3000 else None
            low = c
        docs.append((i, a, b, names if len(cuts) < 3000 else cuts, links))
        for pair in set(links):
            held[pair] = held.get(pair, 0) + 1
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    return [(i, len(a), len(b), len(g), len(ls), sum(held[p] == best[p[0]] for p in ls), sum(held[p] for p in ls),
             (sha(";".join(g)) if isinstance(g[0], str) else None) if g else "") for i, a, b, g, ls in docs]


def _sweep(sa, sb):
    out, k = [], 0
    for x, f, g in sa:
        while k and sb[k - 1][2] > f:
            k -= 1
        while k < len(sb) and sb[k][1] < g:
            if sb[k][2] > f:
                out.append((x, sb[k][0]))
            k += 1
        k = max(0, k - 1)
    return out


def ppm(rows, held, order):
    """rows: (id, text); held: flags. Base and model scores, contexts as tuples, exclusions as sets."""
    def lower(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")

    seen, nodes = {}, {}
    for (_, t), out in zip(rows, held):
        if out:
            continue
        for w in [*words(lower(t)), None]:
            seen[w] = seen.get(w, 0) + 1
        s = (257,) * order + tuple(lower(t).encode()) + (256,)
        for p in range(order, len(s)):
            for k in range(order + 1):
                node = nodes.setdefault(s[p - k:p], {})
                node[s[p]] = node.get(s[p], 0) + 1
    n, v = sum(seen.values()), len(seen)
    cache = {}

    def cost(context, x):
        if (context, x) not in cache:
            out, gone = 0.0, set()
            for k in range(len(context) + 1):
                node = {y: c for y, c in nodes.get(context[k:], {}).items() if y not in gone}
                room = sum(node.values()) + len(node)
                if x in node:
                    out += math.log10(node[x] / room)
                    break
                if node:
                    out += math.log10(len(node) / room)
                gone |= set(node)
            else:
                out -= math.log10(257 - len(gone))
            cache[context, x] = out
        return cache[context, x]

    result = []
    for (i, t), out in zip(rows, held):
        ws = [*words(lower(t)), None]
        s = (257,) * order + tuple(lower(t).encode()) + (256,)
        result.append((i, out, len(ws), sum(w in seen for w in ws), n,
                       sum(math.log10((seen.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in ws),
                       sum(cost(s[p - order:p], s[p]) for p in range(order, len(s)))))
    return result


def phrases(rows, max_words=3, min_count=10, top=2000, inside=50):
    """rows: (text, lang)."""
    f, n = {}, {}
    for t, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            for k in range(len(ws)):
                n[lang] = n.get(lang, 0) + 1
                for m in range(1, max_words + 1):
                    if k + m <= len(ws):
                        g = (lang, *ws[k:k + m])
                        f[g] = f.get(g, 0) + 1
    hidden = {}
    frequent = [g for g, c in f.items() if len(g) > 2 and c >= min_count]
    for g in frequent:
        for m in range(2, len(g) - 1):
            for k in range(1, len(g) - m + 1):
                sub = (g[0], *g[k:k + m])
                hidden[sub] = max(hidden.get(sub, 0), f[g])
    out = {}
    for g in frequent:
        a = f[g]
        if g in hidden and 100 * hidden[g] >= inside * a:
            continue
        cuts = [(SCALE * a * a // (f[g[:k + 1]] * f[(g[0], *g[k + 1:])]), k) for k in range(1, len(g) - 1)]
        score, k = min(cuts)
        out.setdefault(g[0], []).append((-score, -a, " ".join(g[1:]).encode(), f[g[:k + 1]], f[(g[0], *g[k + 1:])]))
    return [(lang, i + 1, p.decode(), -a, lf, r, n[lang], -s)
            for lang, rs in out.items() for i, (s, a, p, lf, r) in enumerate(sorted(rs)[:top])]
