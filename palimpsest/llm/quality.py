"""Text quality by a generalised additive model with pairwise interactions.

A text is measured by FEATURES, each cut into quantile bins. The model is a sum of lookup tables: one
for each feature, then one for each of the PAIRS feature pairs that lower the loss most. Tables are
learnt by cyclic boosting: round after round, each feature in turn (then each pair) gets a shallow
tree on its bins, fitted to what the sum still misses and added at a small rate. So a score is the
logistic of an intercept and one table cell for each feature and pair.

At scale: the sample to learn from is bounded (MOST rows of each label), and only its measures leave
the executors; scoring is one pass without a shuffle over whole texts. Of a text, what is held at
once are its words and its bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import base

FEATURES = (
    "log_words", "word_length", "distinct", "top_word", "repeated", "upper", "upper_peak", "digit", "symbol", "symbol_peak",
    "marks", "marks_peak", "long_words", "short_words", "sentence", "line_repeats", "capitals", "pair_repeats", "space", "non_ascii",
)
BINS = 32
PAIRS = 6
#: Rows of each label to learn from, at most.
MOST = 4000
#: Words in a window, of which the peaks are taken.
WINDOW = 40

_KIND = np.zeros(256, np.uint8)
for _c in range(256):
    _s = chr(_c)
    _KIND[_c] = 1 if "a" <= _s <= "z" else 2 if "A" <= _s <= "Z" else 3 if "0" <= _s <= "9" else 4 if _s in " \t\r\n\x0b\x0c" else 5 if _s in ".,;:'\"()-?" else 7 if _c > 127 else 6


def measure(text: str | None) -> list[float]:
    """FEATURES of a whole text; a null counts as empty."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kind = _KIND[raw]
    count = np.bincount(kind, minlength=8).astype(float)
    letters = max(1.0, count[1] + count[2] + count[7])
    size = len(raw)
    freq = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    steps = np.linspace(0, size, max(1, n // WINDOW) + 1).astype(int)[:-1]
    width = np.diff(np.append(steps, size)).clip(1)
    peak = lambda k: float((np.add.reduceat((kind == k).astype(np.int32), steps) / width).max())
    length = [len(w) for w in words]
    same = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        float(np.log1p(n)), sum(length) / n, len(freq) / n**0.8, max(freq.values()) / n, same / n, count[2] / letters, peak(2), count[3] / size, count[6] / size, peak(6),
        count[5] / n, peak(5), sum(x > 14 for x in length) / n, sum(x < 3 for x in length) / n, (text.count(". ") + text.count(".\n") + 1) / n,
        1 - len(set(lines)) / len(lines), sum(w[0].isupper() for w in words) / n, 1 - pairs / max(1, n - 1), count[4] / size, count[7] / size,
    ]


@dataclass
class Model:
    edges: list[np.ndarray]
    single: np.ndarray  # feature, bin
    pairs: list[tuple[int, int]]
    double: np.ndarray  # pair, bin, bin
    intercept: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        at = _binned(x, self.edges)
        z = np.full(len(x), self.intercept)
        for f in range(at.shape[1]):
            z += self.single[f, at[:, f]]
        for k, (a, b) in enumerate(self.pairs):
            z += self.double[k, at[:, a], at[:, b]]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], 1)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """What a regression tree of so many leaves adds in each bin, of sums of gradients and curvatures by bin."""
    cuts = [0, len(g)]
    G, H = np.append(0, g.cumsum()), np.append(0, h.cumsum())
    while len(cuts) <= leaves:
        best = (1e-9, None)
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            m = np.arange(lo + 1, hi)
            if len(m):
                gains = _gain(G[m] - G[lo], H[m] - H[lo]) + _gain(G[hi] - G[m], H[hi] - H[m]) - _gain(G[hi] - G[lo], H[hi] - H[lo])
                gains[(H[m] - H[lo] < 0.5) | (H[hi] - H[m] < 0.5)] = 0
                if gains.max() > best[0]:
                    best = (gains.max(), int(m[gains.argmax()]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        out[lo:hi] = (G[hi] - G[lo]) / (H[hi] - H[lo] + 1.0)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """What a tree of one cut on either feature adds in each cell, and how much loss that saves."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = []
    for S in (G, H):
        row, col, total = S[:-1, -1:], S[-1:, :-1], S[-1, -1]
        a = S[:-1, :-1]
        parts.append((a, row - a, col - a, total - row - col + a))
    gain = sum(_gain(p, q) for p, q in zip(*parts, strict=True)) - _gain(G[-1, -1], H[-1, -1])
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    leaf = [p[i, j] / (q[i, j] + 1.0) for p, q in zip(*parts, strict=True)]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return out, float(gain.max())


def train(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15) -> Model:
    """Both labels weigh the same. With one label alone, or none, every score is that label's share (0.5 if there is none)."""
    nf = len(FEATURES)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(nf)]
    model = Model(edges, np.zeros((nf, BINS + 1)), [], np.zeros((0, BINS + 1, BINS + 1)), 0.0)
    if not len(y) or y.min() == y.max():
        model.intercept = 0.0 if not len(y) else float(20 * y[0] - 10)
        return model
    at, w = _binned(x, edges), np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    z = np.zeros(len(y))

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return w * (y - p), w * p * (1 - p)

    for _ in range(rounds):
        for f in range(nf):
            g, h = slopes()
            step = rate * _tree(np.bincount(at[:, f], g, BINS + 1), np.bincount(at[:, f], h, BINS + 1))
            model.single[f] += step
            z += step[at[:, f]]
    cell = lambda a, b: at[:, a] * (BINS + 1) + at[:, b]
    grid = lambda c, v: np.bincount(c, v, (BINS + 1) ** 2).reshape(BINS + 1, BINS + 1)
    g, h = slopes()
    gains = {(a, b): _quadrants(grid(cell(a, b), g), grid(cell(a, b), h))[1] for a in range(nf) for b in range(a + 1, nf)}
    model.pairs = sorted(gains, key=gains.get, reverse=True)[:PAIRS]
    model.double = np.zeros((len(model.pairs), BINS + 1, BINS + 1))
    for _ in range(rounds // 3):
        for k, (a, b) in enumerate(model.pairs):
            g, h = slopes()
            c = cell(a, b)
            step = rate * _quadrants(grid(c, g), grid(c, h))[0]
            model.double[k] += step
            z += step[at[:, a], at[:, b]]
    return model


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Model:
    """Fits on a bounded, deterministic sample of ``labels``: of either label the ``most`` rows whose doc_id has the least
    hash. Rows without a doc_id or label teach nothing; a doc_id with both labels counts as low."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = (F.xxhash64("doc_id"), "doc_id")
    ids = known.where("quality = 1").orderBy(*order).limit(most).union(known.where("quality = 0").orderBy(*order).limit(most))
    got = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "quality").mapInArrow(base.tidied(_measured), f"doc_id {base.id_type(docs)}, quality int, x array<double>")
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(2 * most).collect()
    return train(np.array([r["x"] for r in got]).reshape(-1, len(FEATURES)), np.array([r["quality"] for r in got], float))


def _measured(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for part in base.slices(batch, 1):
            x = [measure(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2).cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])


class _Score:
    def __init__(self, model: Model):
        self.model = model

    def __call__(self, batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in base.slices(batch, 1):
                s = self.model.score(np.array([measure(t) for t in part.column(1).to_pylist()]).reshape(-1, len(FEATURES)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1, higher for better texts) and predicted (1 from 0.5) for each row; empty and null texts are scored too."""
    return docs.select("doc_id", "text").mapInArrow(base.tidied(_Score(model)), f"doc_id {base.id_type(docs)}, score double, predicted int")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "labels")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return score(docs, learn(docs, labels.where(~held))).select("doc_id", held.alias("held_out"), "score", "predicted")


QUERIES = {"op2_quality": op2_quality}
ORACLE: dict[str, str] = {}
