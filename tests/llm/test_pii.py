"""Base patterns against the plain expressions; the tagger on held-out windows."""

import random
import re

import numpy as np

from signalpanel.llm import pii

PLAIN = {"email": re.compile(pii.EMAIL), "ip": re.compile(pii.IP), "card": pii.CARD, "phone": pii.PHONE}


def plain(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in PLAIN[kind].finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                    "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((k, *m.span()))
    return out


def test_base_spans():
    r = random.Random(4)
    parts = ["a@b.c", "@", ".", "+", "1", "25", "255.", "300.1.2.3", "0001.2.3.4", "x_y%z@mail.co.uk", "4111 1111 1111 1111", "-", " ",
             "(", "+1 (743) 555-3824", "é", "a@b", "q@r..s", "1.2.3.4.5.6.7.8", "4111-1111-1111-1112", "text", "\n"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(1, 9)))
        assert pii.base_spans(t) == plain(t), t
    assert pii.base_spans("a" * 200_000 + "@") == [] and pii.base_spans("1" * 200_000 + ".") == []


def _corpus(seed, n):
    r = random.Random(seed)
    words = ["that", "heon", "ination", "ther", "onsen", "lle", "und", "der", "estion", "thon"]
    out = []
    for _ in range(n):
        text = [r.choice(words) for _ in range(60)]
        for _ in range(2):
            d = "".join(r.choice("0123456789") for _ in range(10))
            pick = r.randrange(5)
            text[r.randrange(60)] = (f"{r.choice(words)}.{d[:2]}@mail{d[3]}.example.com" if pick == 0 else
                                     f"{int(d[:2])}.{int(d[2:4])}.{int(d[4:6])}.{int(d[6:8])}" if pick == 1 else
                                     f"+1 ({d[:3]}) 555-{d[3:7]}" if pick == 2 else "4111 1111 1111 1111" if pick == 3 else d[:5])
        out.append(" ".join(text))
    return out


def test_held_out():
    model = pii.Tagger().fit(pii.training_windows(_corpus(1, 500), 1200))
    texts = _corpus(2, 120)
    found, base = pii.tag_spans(model, texts), [pii.base_spans(t) for t in texts]
    hits = sum(len(set(f) & set(b)) for f, b in zip(found, base))
    assert hits >= 0.9 * sum(map(len, base))
    assert hits >= 0.9 * sum(map(len, found))
    # forms that the patterns cannot match
    other = ["that heon 743-555-3824 ther", "lle und (743) 555-3824 estion"]
    assert all(any(k == 3 for k, _, _ in f) for f in pii.tag_spans(model, other))
    clean = ["that heon ination ther onsen lle und der " * 40]
    assert pii.tag_spans(model, clean) == [[]]


def test_windows_are_reconciled():
    model = pii.Tagger().fit(pii.training_windows(_corpus(3, 300), 600))
    text = _corpus(8, 1)[0]
    shifted = [" " * k + text for k in range(0, pii.WINDOW, 7)]
    spans = [sorted((k, s - n, e - n) for k, s, e in sp) for sp, n in zip(pii.tag_spans(model, shifted), range(0, pii.WINDOW, 7))]
    most = max(spans, key=spans.count)
    assert spans.count(most) >= 0.8 * len(spans)


def test_gradient():
    r = np.random.default_rng(0)
    model = pii.Tagger()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    ids = r.integers(0, 129, (7, 3))
    tags, real = r.integers(0, pii._TAGS, (7, 3)), np.ones((7, 3), bool)
    real[5:, 1] = False
    _, g = model.gradients(ids, tags, real)
    for key in ("T", "O", "Wf", "cb"):
        v = model.w[key]
        at = tuple(r.integers(0, n) for n in v.shape)
        keep = v[at]
        v[at] = keep + 1e-3
        up, _ = model.gradients(ids, tags, real)
        v[at] = keep - 1e-3
        down, _ = model.gradients(ids, tags, real)
        v[at] = keep
        assert abs((up - down) / 2e-3 - g[key][at]) < 2e-3
