"""What the classifiers' scoring says, against the same sums in plain Python with models drawn at random; and how trees are chosen, against all cuts."""

import math
import random
import zlib

import numpy as np
import pytest

from palimpsest.llm import language_id, quality, toxicity

WORDS = ["vile", "viler", "vileness", "good", "straße", "Ünder", "été", "naïve", "ab", "abcdefgh", "x1_y", "ⅷ", "日本語", "42", "don't"]


def said(r: random.Random) -> str:
    return "".join(r.choice(WORDS).upper() + r.choice([" ", ", ", "\n", ". ", "--"]) if r.random() < 0.2 else r.choice(WORDS) + r.choice([" ", ", ", "\n", ". ", " 7 "]) for _ in range(r.randint(0, 120)))


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(23)
    rows = [(i, said(r)) for i in range(60)] + [(100, None), (101, ""), (102, " \n"), (103, "!?"), (104, "vile " * 40_000), (100, "good"), (None, "vile")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def logistic(z: float) -> float:
    return 1 / (1 + math.exp(-min(max(z, -40), 40)))


def held(got, rows, want):
    """Rows in any order, equal but for rounding."""
    key = lambda v: (v[0] is not None, *(x for x in v if x is not None))
    got, want = sorted(map(tuple, got), key=key), sorted(((d, *want(t)) for d, t in rows), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=1e-9)


def test_chain_of_links(texts):
    import re

    rows, docs = texts
    r = np.random.default_rng(5)
    marks = lambda w: [f"w {w}"] + [f"{k} {w[:k]}" for k in (4, 5, 6) if len(w) > k]
    bucket = lambda m: zlib.crc32(m.encode()) % 2**20
    at = np.unique([bucket(m) for w in WORDS for m in marks(w.lower()) if r.random() < 0.7])
    weights = r.normal(size=(len(at), 3)).astype(np.float32)
    before = [r.normal(size=k) * 2 for k in range(3)]
    model = toxicity.Model(at, weights, before, [-0.3, 0.2, 0.1], 0.6)
    place = {int(b): k for k, b in enumerate(at)}

    def want(text):
        total = [0.0, 0.0, 0.0]
        for word in set(re.findall(r"\w+", (text or "").lower())):
            for m in marks(word):
                if bucket(m) in place:
                    for k in range(3):
                        total[k] += float(weights[place[bucket(m)], k])
        out = []
        for k in range(3):
            out.append(logistic(total[k] + sum(v * p for v, p in zip(before[k], out, strict=True)) + model.bias[k]))
        return [*out, int(out[2] >= 0.6)]

    got = toxicity.score(docs, model).collect()
    for a in got:
        assert a.toxic == int(a.p_toxic >= 0.6)
    for a, b in zip(sorted(got, key=lambda x: (x[0] is not None, x[0] or 0, x.p_toxic)), sorted(((d, *want(t)) for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[3])), strict=True):
        assert tuple(a) == pytest.approx(b, abs=1e-5)  # weights are single floats, added in any order
    kept = sorted(map(tuple, toxicity.not_toxic(docs, model).collect()), key=repr)
    assert kept == sorted([x for x in rows if want(x[1])[3] == 0], key=repr) and 0 < len(kept) < len(rows)


def test_additive_tables(texts):
    rows, docs = texts
    r, nf, bins = np.random.default_rng(6), len(quality.FEATURES), quality.BINS + 1
    x = np.array([quality.measure(t) for _, t in rows])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 8)[1:-1])) for f in range(nf)]
    model = quality.Model(edges, r.normal(size=(nf, bins)) * 0.2, [(0, 3), (2, 7), (1, 19)], r.normal(size=(3, bins, bins)), 0.25)

    def want(text):
        v = quality.measure(text)
        place = [sum(e <= v[f] for e in edges[f]) for f in range(nf)]
        z = 0.25 + sum(model.single[f][place[f]] for f in range(nf)) + sum(model.double[k][place[a]][place[b]] for k, (a, b) in enumerate(model.pairs))
        return [logistic(z), int(logistic(z) >= 0.5)]

    held(quality.score(docs, model).collect(), rows, want)


def test_average_of_subwords(texts):
    rows, docs = texts
    r = np.random.default_rng(7)
    langs = ["aa", "bb", "cc"]
    model = language_id.Model(langs, r.normal(size=(language_id.BUCKETS, 3)) * 3, np.array([0.1, -0.2, 0.0]), 1.7, 0.5)

    def bucket(gram):
        h = (2166136261 + len(gram)) % 2**32
        for c in gram:
            h = (h ^ ord(c)) * 16777619 % 2**32
        return (h ^ h >> 15) % language_id.BUCKETS

    def want(text):
        low = (text or "").lower()
        runs = "".join(c if c.isalpha() else " " for c in low).split(" ")
        runs = [w for w in runs if w]
        if not runs:
            return ["und", 0.0, True]
        line = " " + " ".join(runs) + ("" if low[-1].isalpha() else " ")
        seen: dict[int, int] = {}
        for n in language_id.GRAMS:
            for k in range(len(line) - n + 1):
                b = bucket(line[k : k + n])
                seen[b] = seen.get(b, 0) + 1
        n = sum(seen.values())
        z = [sum(c * model.table[b][k] for b, c in seen.items()) / n + model.bias[k] for k in range(3)]
        e = [math.exp((v - max(z)) / 1.7) for v in z]
        p = [v / sum(e) for v in e]
        k = p.index(max(p))
        return [langs[k], p[k], p[k] < 0.5]

    held(language_id.predict(docs, model).collect(), rows, want)


def test_cuts_are_the_best():
    r = np.random.default_rng(8)
    gain = lambda g, h: g * g / (h + 1)
    for _ in range(20):
        n = 7
        g, h = r.normal(size=(n, n)) * 4, r.uniform(0.1, 2, size=(n, n))
        added, saved = quality._quadrants(g, h)
        best = max(
            (sum(gain(g[a, b].sum(), h[a, b].sum()) for a in (slice(0, i), slice(i, n)) for b in (slice(0, j), slice(j, n))) - gain(g.sum(), h.sum()), i, j)
            for i in range(1, n)
            for j in range(1, n)
        )
        assert saved == pytest.approx(best[0])
        _, i, j = best
        for a in (slice(0, i), slice(i, n)):
            for b in (slice(0, j), slice(j, n)):
                assert added[a, b] == pytest.approx(np.full(g[a, b].shape, g[a, b].sum() / (h[a, b].sum() + 1)))
        one, cuts = quality._tree(g[0], np.full(n, 1.0), leaves=2), []
        for c in range(1, n):
            cuts.append((gain(g[0, :c].sum(), c) + gain(g[0, c:].sum(), n - c) - gain(g[0].sum(), n), c))
        if max(cuts)[0] > 1e-9:
            c = max(cuts)[1]
            assert one == pytest.approx(np.concatenate([np.full(c, g[0, :c].sum() / (c + 1)), np.full(n - c, g[0, c:].sum() / (n - c + 1))]))
        else:
            assert one == pytest.approx(np.full(n, g[0].sum() / (n + 1)))
