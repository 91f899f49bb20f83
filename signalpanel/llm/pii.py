"""Personal data: base patterns plus a character BiLSTM-CRF tagger.

Base spans come from four patterns with checks and always stay. A tagger adds
spans that the patterns miss (telephone numbers without a country code, other
separators). It is a bidirectional LSTM over characters with CRF transitions,
trained in NumPy on labelled windows: a bounded sample of the corpus
(``SAMPLE_DOCS`` texts that hold a digit or @, in hash order), labelled by the
base spans, partly rewritten into variants that the patterns do not match.

Every whole text is cut into overlapping windows. All four kinds hold a digit
or an @, so a window without either can only be outside and is not scored. The
emissions of overlapping windows are blended by the distance to the window's
edge, and one Viterbi path per connected region (which may be the whole text)
reconciles them, so a span never depends on where a window was cut.

Defined results: NULL and empty texts have no spans (and the hash of the empty
string); equal rows give equal results; an empty corpus gives no rows, and a
sample without any base span leaves the tagger out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

# Fixed values of the contract: kinds in order, patterns and limits.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Texts that the tagger is fitted on at most and their longest, windows drawn from them; passes, rows and least number of steps.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_WINDOWS = 2000, 8000, 3000
EPOCHS, BATCH, LEAST_STEPS = 8, 64, 150
WINDOW, STEP = 96, 48
EMBED, HIDDEN = 16, 24
SEED = 11

#: The same matches in linear time on any text: an address is looked for
#: around each @ only, and a run of digits is tried once, from its start.
_EMAIL_HOST = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
_IP_ONCE = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_TRIGGER = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]")
_SYMBOLS = 131  # ASCII, other letters, other characters, padding
_PAD = 130
_TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    upto, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > upto and text[start - 1] in _NAME_CHARS:
            start -= 1
        host = _EMAIL_HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
        upto = host.end() if host else at + 1
        at = text.find("@", upto)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start. A text without the character
    that a pattern cannot do without is not searched for it."""
    out = []
    if "@" in text:
        out += [(0, s, e) for s, e in _emails(text)]
    if _DIGITS.search(text):
        out += [(1, *m.span()) for m in _IP_ONCE.finditer(text)
                if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            d = re.sub(r"[^0-9]", "", m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def symbols(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = c.astype(np.int64)
    for k in np.flatnonzero(c >= 128).tolist():
        out[k] = 128 if text[k].isalpha() else 129
    return out


# --------------------------------------------------------------------- model

def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Embedding, one LSTM per direction, a linear layer and CRF transitions."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)

        def init(*shape):
            return (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.w = {"E": init(_SYMBOLS, EMBED) * 3, "O": init(2 * HIDDEN, _TAGS), "o": np.zeros(_TAGS, np.float32),
                  "T": np.zeros((_TAGS, _TAGS), np.float32)}
        for d in "fb":
            self.w["W" + d] = init(EMBED + HIDDEN, 4 * HIDDEN)
            self.w["c" + d] = np.zeros(4 * HIDDEN, np.float32)
            self.w["c" + d][HIDDEN:2 * HIDDEN] = 1  # forget gates start open

    def _lstm(self, x, d, keep):
        """Hidden states of one direction; ``x``: time, rows, EMBED."""
        n, rows, _ = x.shape
        h, c = np.zeros((rows, HIDDEN), np.float32), np.zeros((rows, HIDDEN), np.float32)
        out, tape = np.empty((n, rows, HIDDEN), np.float32), []
        a, b = self.w["W" + d][:EMBED], self.w["W" + d][EMBED:]
        fed = x @ a + self.w["c" + d]
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            g = fed[t] + h @ b
            s = _sigmoid(g[:, :3 * HIDDEN])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN:2 * HIDDEN], s[:, 2 * HIDDEN:]
            u = np.tanh(g[:, 3 * HIDDEN:])
            before, c = (h, c), f * c + i * u
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                tape.append((t, *before, i, f, o, u, tc))
        return out, tape

    def emissions(self, ids, keep=False):
        """Scores per time, row and tag for ``ids`` (time, rows)."""
        x = self.w["E"][ids]
        hf, tf = self._lstm(x, "f", keep)
        hb, tb = self._lstm(x, "b", keep)
        h = np.concatenate([hf, hb], axis=2)
        return h @ self.w["O"] + self.w["o"], (x, h, tf, tb)

    def _crf(self, e, tags, real):
        """Mean negative log-likelihood and its gradients (forward-backward)."""
        n, rows, _ = e.shape
        T = self.w["T"]
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, n):
            new = _logsum(alpha[t - 1][:, :, None] + T[None], 1) + e[t]
            alpha[t] = np.where(real[t][:, None], new, alpha[t - 1])
        for t in range(n - 2, -1, -1):
            new = _logsum(T[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(real[t + 1][:, None], new, beta[t + 1])
        z = _logsum(alpha[-1], 1)
        grad = np.exp(alpha + beta - z[None, :, None]) * real[:, :, None]
        r = np.arange(rows)
        gT, gold = np.zeros_like(T), np.zeros(rows)
        for t in range(n):
            m = real[t]
            grad[t, r[m], tags[t][m]] -= 1
            gold[m] += e[t, r[m], tags[t][m]]
            if t:
                p = np.exp(alpha[t - 1][:, :, None] + T[None] + (e[t] + beta[t])[:, None, :] - z[:, None, None])
                gT += p[m].sum(axis=0)
                np.add.at(gT, (tags[t - 1][m], tags[t][m]), -1)
                gold[m] += T[tags[t - 1][m], tags[t][m]]
        return float((z - gold).mean()), grad / rows, gT / rows

    def gradients(self, ids, tags, real):
        e, (x, h, tf, tb) = self.emissions(ids, keep=True)
        loss, ge, gT = self._crf(e, tags, real)
        g = {"T": gT, "O": np.einsum("trh,trk->hk", h, ge), "o": ge.sum(axis=(0, 1))}
        gh, gx = ge @ self.w["O"].T, np.zeros_like(x)
        for d, tape, part in (("f", tf, gh[:, :, :HIDDEN]), ("b", tb, gh[:, :, HIDDEN:])):
            a, b = self.w["W" + d][:EMBED], self.w["W" + d][EMBED:]
            ga, gb, gc = np.zeros_like(a), np.zeros_like(b), np.zeros(4 * HIDDEN, np.float32)
            dh, dc = np.zeros_like(part[0]), np.zeros_like(part[0])
            for t, h0, c0, i, f, o, u, tc in reversed(tape):
                dh = dh + part[t]
                dc = dc + dh * o * (1 - tc * tc)
                dg = np.concatenate([dc * u * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o),
                                     dc * i * (1 - u * u)], axis=1)
                ga += x[t].T @ dg
                gb += h0.T @ dg
                gc += dg.sum(axis=0)
                gx[t] += dg @ a.T
                dh, dc = dg @ b.T, dc * f
            g["W" + d], g["c" + d] = np.concatenate([ga, gb]), gc
        g["E"] = np.zeros_like(self.w["E"])
        np.add.at(g["E"], ids, gx)
        return loss, g

    def fit(self, windows: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.01, seed: int = SEED):
        """Adam over shuffled batches of (symbols, tags) windows."""
        r, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        per_epoch = -(-len(windows) // BATCH)
        epochs = max(epochs, -(-LEAST_STEPS // per_epoch))
        total = epochs * per_epoch
        for _ in range(epochs):
            order = r.permutation(len(windows))
            for k in range(0, len(order), BATCH):
                ids, tags, real = stack([windows[j] for j in order[k:k + BATCH]])
                _, g = self.gradients(ids, tags, real)
                step += 1
                now = rate * (1 - 0.9 * step / total)
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                for key, v in g.items():
                    v = v * min(1.0, 5 / (norm + 1e-9))
                    m[key] = 0.9 * m[key] + 0.1 * v
                    s[key] = 0.999 * s[key] + 0.001 * v * v
                    self.w[key] = (self.w[key] - now * (m[key] / (1 - 0.9 ** step))
                                   / (np.sqrt(s[key] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return self

    def viterbi(self, e: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Best tags of each column of ``e`` (time, rows, tags)."""
        n, rows, _ = e.shape
        allowed = self.w["T"] + _FORBIDDEN
        score, back = e[0] + _FORBIDDEN[0], np.zeros((n, rows, _TAGS), np.int8)
        for t in range(1, n):
            step = score[:, :, None] + allowed[None]
            back[t] = step.argmax(axis=1)
            score = np.where((t < lengths)[:, None], step.max(axis=1) + e[t], score)
        tag = score.argmax(axis=1)
        out = np.zeros((n, rows), np.int8)
        for t in range(n - 1, -1, -1):
            live = t < lengths
            out[t] = np.where(live, tag, 0)
            tag = np.where(live & (t > 0), back[t, np.arange(rows), tag], tag)
        return [out[:m, k] for k, m in enumerate(lengths.tolist())]


#: An inside tag only follows the begin or inside tag of its kind.
_FORBIDDEN = np.zeros((_TAGS, _TAGS), np.float32)
for _k in range(len(KINDS)):
    _FORBIDDEN[:, 2 + 2 * _k] = -1e4
    _FORBIDDEN[1 + 2 * _k, 2 + 2 * _k] = _FORBIDDEN[2 + 2 * _k, 2 + 2 * _k] = 0


def stack(windows):
    n = max(len(x) for x, _ in windows)
    ids = np.full((n, len(windows)), _PAD, np.int64)
    tags, real = np.zeros((n, len(windows)), np.int64), np.zeros((n, len(windows)), bool)
    for k, (x, y) in enumerate(windows):
        ids[:len(x), k], tags[:len(x), k], real[:len(x), k] = x, y, True
    return ids, tags, real


def tags_of(length: int, spans) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for k, s, e in spans:
        if not out[s:e].any():
            out[s], out[s + 1:e] = 1 + 2 * k, 2 + 2 * k
    return out


def _variant(kind: int, found: str, r) -> str:
    """A labelled span rewritten into a form that the patterns do not match."""
    if kind == 0:
        return found.replace("@", (" @ ", "(@)", " @")[r.integers(3)])
    digits = re.sub(r"[^0-9]", "", found)
    if kind == 1:
        return found.replace(".", (" . ", "[.]", ",")[r.integers(3)])
    if kind == 2:
        return (".", "/", "_")[r.integers(3)].join(digits[k:k + 4] for k in range(0, len(digits), 4))
    d = digits[-10:].rjust(10, "5")
    return (f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}",
            f"00{digits}")[r.integers(4)]


def training_windows(texts: list[str], limit: int = SAMPLE_WINDOWS, seed: int = SEED):
    """Labelled windows around the base spans (half of them as variants) and
    around other digits; at most ``limit``, in random order."""
    r, out = np.random.default_rng(seed), []
    for text in texts:
        spans = sorted(base_spans(text), key=lambda x: x[1])
        covered = tags_of(len(text), spans)
        for k, s, e in spans:
            if covered[s] != 1 + 2 * k or e - s > WINDOW - 8:
                continue
            found = text[s:e] if r.random() < 0.5 else _variant(k, text[s:e], r)
            a = int(r.integers(0, WINDOW - 4 - len(found)))
            left, right = text[max(0, s - a):s], text[e:e + WINDOW - a - len(found)]
            if _TRIGGER.search(left + right):
                if found != text[s:e]:
                    continue  # other spans would lose their labels
                lo = max(0, s - a)
                out.append((symbols(text[lo:lo + WINDOW]), _inner_tags(covered, lo, len(text))))
            else:
                x = left + found + right
                out.append((symbols(x), tags_of(len(x), [(k, len(left), len(left) + len(found))])))
        free = [m.start() for m in _TRIGGER.finditer(text) if not covered[m.start()]]
        for p in r.permutation(free)[:2].tolist() if free else []:
            lo = max(0, p - int(r.integers(0, WINDOW)))
            out.append((symbols(text[lo:lo + WINDOW]), _inner_tags(covered, lo, len(text))))
    return [out[k] for k in r.permutation(len(out))[:limit].tolist()]


def _inner_tags(covered: np.ndarray, lo: int, n: int) -> np.ndarray:
    """Tags of a window; a span that the window cuts counts from its edge."""
    y = covered[lo:min(n, lo + WINDOW)].copy()
    if len(y) and y[0] and y[0] % 2 == 0:
        y[0] -= 1
    return y


# --------------------------------------------------------------------- tagging

def windows_of(text: str) -> list[tuple[int, int]]:
    """Window bounds that hold a digit or @ (every such character with context)."""
    hits = np.fromiter((m.start() for m in _TRIGGER.finditer(text)), np.int64)
    if not len(hits):
        return []
    k = np.unique(np.concatenate([hits // STEP, np.maximum(hits // STEP - 1, 0)]))
    return [(int(s), min(len(text), int(s) + WINDOW)) for s in k * STEP]


def plausible(kind: int, found: str) -> bool:
    n = len(_DIGITS.findall(found))
    if kind == 0:
        return "@" in found and "." in found
    if kind == 1:
        parts = re.findall(r"[0-9]+", found)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= n <= 19 and luhn(re.sub(r"[^0-9]", "", found)) and not re.search(r"[A-Za-z]", found)
    return 8 <= n <= 15 and not re.search(r"[A-Za-z]", found)


_blend = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(np.float32)


def tag_spans(model: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans of the tagger for each text."""
    bounds = [(t, s, e) for t, text in enumerate(texts) for s, e in windows_of(text)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not bounds:
        return out
    codes = {t: symbols(texts[t]) for t in {b[0] for b in bounds}}
    regions: list[tuple[int, int, int]] = []  # text, start, end of joined windows
    for t, s, e in bounds:
        if regions and regions[-1][0] == t and s <= regions[-1][2]:
            regions[-1] = (t, regions[-1][1], e)
        else:
            regions.append((t, s, e))
    sums = [np.zeros((e - s, _TAGS), np.float32) for _, s, e in regions]
    weights = [np.zeros(e - s, np.float32) for _, s, e in regions]
    owner, k = [], 0
    for t, s, e in bounds:
        while not (regions[k][0] == t and regions[k][1] <= s and e <= regions[k][2]):
            k += 1
        owner.append(k)
    for c in range(0, len(bounds), 512):
        part = bounds[c:c + 512]
        ids, _, _ = stack([(codes[t][s:e], np.zeros(e - s, np.int64)) for t, s, e in part])
        scores, _ = model.emissions(ids)
        for j, (t, s, e) in enumerate(part):
            g = owner[c + j]
            at = s - regions[g][1]
            w = _blend[:e - s]
            sums[g][at:at + e - s] += scores[:e - s, j] * w[:, None]
            weights[g][at:at + e - s] += w
    order = sorted(range(len(regions)), key=lambda g: len(weights[g]))
    k = 0
    while k < len(order):
        longest, j = len(weights[order[k]]), k
        while j < len(order) and j - k < 512 and len(weights[order[j]]) <= 2 * longest:
            j += 1
        group = order[k:j]
        lengths = np.array([len(weights[g]) for g in group])
        e = np.zeros((int(lengths.max()), len(group), _TAGS), np.float32)
        for c, g in enumerate(group):
            e[:lengths[c], c] = sums[g] / weights[g][:, None]
        for g, tags in zip(group, model.viterbi(e, lengths)):
            t, s0, _ = regions[g]
            for b in np.flatnonzero(tags % 2 == 1).tolist():
                end = b + 1
                while end < len(tags) and tags[end] == tags[b] + 1:
                    end += 1
                kind = (int(tags[b]) - 1) // 2
                if plausible(kind, texts[t][s0 + b:s0 + end]):
                    out[t].append((kind, s0 + b, s0 + end))
        k = j
    return out


def all_spans(texts: list[str], model: Tagger | None) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, both by kind, then start."""
    base = [base_spans(t) for t in texts]
    more = tag_spans(model, texts) if model else [[] for _ in texts]
    out = []
    for b, m in zip(base, more):
        taken = sorted((s, e) for _, s, e in b)
        starts = np.array([s for s, _ in taken], np.int64)
        reach = np.maximum.accumulate(np.array([e for _, e in taken], np.int64)) if taken else starts
        new = []
        for k, s, e in m:
            i = int(np.searchsorted(starts, e)) - 1  # the last base span that starts in front of the end
            if i < 0 or reach[i] <= s:
                new.append((k, s, e))
        out.append((b, sorted(b + new)))
    return out


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = all_spans([t or "" for t in b.column("t").to_pylist()], shared.value)
            counts = [[sum(1 for s in base if s[0] == k) for base, _ in found] for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), *[pa.array(c, pa.int64()) for c in counts],
                 pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]),
                 pa.array([joined(every) for _, every in found])],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])
    return run


def fit_tagger(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
               sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> Tagger | None:
    """Fit on a bounded sample: in hash order, the first ``sample_docs`` texts
    of at most ``SAMPLE_CHARS`` characters that hold a digit or @. A count sets
    a hash limit that lets twice as many through, so what all tasks together
    send to the driver does not grow with the corpus."""
    t = F.col(f"`{text}`")
    fit = docs.filter(t.rlike("[0-9@]") & (F.length(t) <= SAMPLE_CHARS))
    n = fit.count()
    part = 2 ** 62 if n <= 2 * sample_docs else int(2 ** 62 * 2 * sample_docs / n)
    rows = (fit.select(t.alias("t"), F.shiftrightunsigned(F.xxhash64(F.col(f"`{id_col}`"), t), 2).alias("k"))
            .filter(F.col("k") < part).orderBy("k", "t").select("t").limit(sample_docs).collect())
    windows = training_windows([r[0] for r in rows], sample_windows)
    return Tagger().fit(windows) if any(y.any() for _, y in windows) else None


def find_pii(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model: Tagger | None = None) -> DataFrame:
    """Per row: ``doc_id``, base counts, ``base_sha256`` and all ``spans``."""
    bounded_batches(docs.sparkSession)
    model = model or fit_tagger(docs, id_col, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string"
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t")
                       ).mapInArrow(_find(shared), schema)


def op10_pii(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_pii(docs)
