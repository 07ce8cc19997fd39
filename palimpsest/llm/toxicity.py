"""Toxicity by a classifier chain.

The labels know one thing, whether a text is toxic. The chain's categories are made from that and the
texts to learn from: ``open`` (toxic, with a word that many toxic texts and no clean one have),
``coined`` (toxic, without such a word: word families that only their stems give away) and, last,
``toxic`` itself. A link is a linear model over a text's distinct words and their stems, hashed, and
the probabilities of the links before it. In training those probabilities are out of fold: made by
models that didn't see the row, so a later link meets the errors that it will meet in use.

At scale: the sample to learn from is bounded (MOST rows of each label, as bags of hashes made on the
executors, and fitted in one task there); scoring is one pass without a shuffle over whole texts. A worker adds up the weights of
a text's distinct words, looked up in a bounded cache. To drop texts, the text alone goes to Python, and a number comes back.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from palimpsest.llm import base

CATEGORIES = ("open", "coined", "toxic")
BUCKETS = 1 << 20
STEMS = (4, 5, 6)
FOLDS = 4
#: Rows of each label to learn from, at most.
MOST = 4000
#: A word or stem counts if it is in so large a share of the toxic texts, and so many times as often as in clean ones.
LEAST, LIFT = 0.005, 8
#: Characters of words that a worker remembers; beyond that it starts afresh.
CACHE = 2_000_000

_words = re.compile(r"\w+").findall


def _features(word: str) -> list[int]:
    """The buckets of a word and of its stems."""
    marks = [f"w {word}", *(f"{k} {word[:k]}" for k in STEMS if len(word) > k)]
    return [zlib.crc32(m.encode()) % BUCKETS for m in marks]


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the distinct words, buckets of words and stems with repeats counted once for each distinct word)."""
    words = set(_words((text or "").lower()))
    feats = [_features(w) for w in words]
    own = np.unique(np.array([f[0] for f in feats], np.int32))
    return own, np.sort(np.array([x for f in feats for x in f], np.int32))


@dataclass
class Link:
    weights: np.ndarray
    before: np.ndarray  # of the earlier links' probabilities
    bias: float


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _fit(rows: list[np.ndarray], before: np.ndarray, y: np.ndarray, width: int, rounds: int = 150, rate: float = 0.5, l2: float = 1e-5) -> Link:
    """Logistic regression by full-batch AdaGrad on compact columns; both labels weigh the same."""
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    starts = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, v, b = np.zeros(width), np.zeros(before.shape[1]), 0.0
    gw, gv, gb = np.full(width, 1e-8), np.full(before.shape[1], 1e-8), 1e-8
    if not len(y) or y.min() == y.max():
        return Link(w, v, float(20 * y.mean() - 10) if len(y) else -10.0)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    for _ in range(rounds):
        d = (_sigmoid(np.bincount(starts, w[at], len(rows)) + before @ v + b) - y) * weight
        dw = np.bincount(at, d[starts], width) + l2 * w
        dv, db = d @ before, d.sum()
        gw += dw**2
        gv += dv**2
        gb += db**2
        w -= rate * dw / np.sqrt(gw)
        v -= rate * dv / np.sqrt(gv)
        b -= rate * db / np.sqrt(gb)
    return Link(w, v, float(b))


def _score(rows: list[np.ndarray], before: np.ndarray, link: Link) -> np.ndarray:
    return _sigmoid(np.array([link.weights[r].sum() for r in rows]) + before @ link.before + link.bias)


@dataclass
class Model:
    at: np.ndarray  # the buckets with a weight, ascending
    weights: np.ndarray  # one row for each of them, one column for each link
    before: list[np.ndarray]
    bias: list[float]
    threshold: float = 0.5

    def word(self, w: str) -> np.ndarray | None:
        """What a word adds to each link; None if nothing."""
        hit = [k for k in map(self.rows.get, _features(w)) if k is not None]
        return self.weights[hit].sum(0) if hit else None

    def __post_init__(self):
        self.rows = {int(b): k for k, b in enumerate(self.at)}

    def chain(self, sums) -> list[float]:
        out: list[float] = []
        for k in range(len(self.bias)):
            out.append(float(_sigmoid(sums[k] + np.dot(self.before[k], out) + self.bias[k])))
        return out


def train(bags: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> Model:
    """Links in order, each on telling words and stems, which a fold chooses by its own rows too. Rows go to folds by their place."""
    n = len(bags)
    own_toxic, own_clean = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for (own, _), y in zip(bags, toxic, strict=True):
        (own_toxic if y else own_clean)[own] += 1
    telling = (own_clean == 0) & (own_toxic >= max(3, 0.01 * toxic.sum()))
    opened = np.array([bool(y) and bool(telling[own].any()) for (own, _), y in zip(bags, toxic, strict=True)], int)
    once = [np.unique(f) for _, f in bags]
    every = [f for _, f in bags]
    y = np.asarray(toxic, int)
    targets = [opened, y * (1 - opened), y]
    fold = np.arange(n) % FOLDS
    parts = [(np.flatnonzero(fold != k), np.flatnonzero(fold == k)) for k in range(FOLDS)]
    kept = [_telling(once, y, tr) for tr, _ in parts]
    links, before, keep = [], np.zeros((n, 0)), _telling(once, y, np.arange(n))
    for target in targets:
        oof = np.zeros(n)
        for (tr, te), own in zip(parts, kept, strict=True):
            rows = _placed(every, own)
            oof[te] = _score([rows[i] for i in te], before[te], _fit([rows[i] for i in tr], before[tr], target[tr], len(own)))
        links.append(_fit(_placed(every, keep), before, target, len(keep)))
        before = np.column_stack([before, oof])
    oof = before[:, -1]
    best = max(np.linspace(0.05, 0.95, 91), key=lambda t: (_f1(oof >= t, y), -abs(t - 0.5))) if n else 0.5
    return Model(keep, np.stack([x.weights for x in links], 1).astype(np.float32), [x.before for x in links], [x.bias for x in links], float(best))


def _telling(once: list[np.ndarray], y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Buckets that speak for toxicity, by the rows at ``at``: in enough toxic texts, and LIFT times as often as in clean ones."""
    seen = np.zeros((2, BUCKETS))
    for i in at:
        seen[y[i], once[i]] += 1
    n = np.array([(y[at] == 0).sum(), (y[at] == 1).sum()])
    share = (seen + 0.5) / (n[:, None] + 1)
    return np.flatnonzero((seen[1] >= max(3, LEAST * n[1])) & (share[1] > LIFT * share[0]))


def _placed(rows: list[np.ndarray], keep: np.ndarray) -> list[np.ndarray]:
    place = np.full(BUCKETS, -1)
    place[keep] = np.arange(len(keep))
    return [p[p >= 0] for p in (place[f] for f in rows)]


def _f1(said: np.ndarray, y: np.ndarray) -> float:
    return 2 * (said & (y == 1)).sum() / max(1, said.sum() + y.sum())


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Model:
    """Fits on a bounded, deterministic sample: of either label the ``most`` rows whose doc_id has the least hash.
    Rows without a doc_id or label teach nothing; a doc_id with both labels counts as toxic.
    Where rows repeat a doc_id, 2 ``most`` rows at most are used."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("doc_id"), "doc_id")
    ids = known.where("toxic = 1").orderBy(*order).limit(most).union(known.where("toxic = 0").orderBy(*order).limit(most))
    got = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic").mapInArrow(base.tidied(_bags), f"doc_id {base.id_type(docs)}, toxic int, own binary, f binary")
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", "f").limit(2 * most).mapInArrow(base.tidied(_fitted), "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else train([], np.zeros(0, int))


def _fitted(batches: Iterator) -> Iterator:
    """The model of the rows to learn from, trained where they are: only the model goes to the driver."""
    import pyarrow as pa

    bags, toxic = [], []
    for batch in batches:
        toxic += batch.column(1).to_pylist()
        bags += [(np.frombuffer(a, np.int32), np.frombuffer(b, np.int32)) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(bags, np.array(toxic, int)))], pa.binary())], ["model"])


def _bags(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for part in base.slices(batch, 1):
            got = [bag(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2).cast(pa.int32()), pa.array([a.tobytes() for a, _ in got], pa.binary()), pa.array([b.tobytes() for _, b in got], pa.binary())], ["doc_id", "toxic", "own", "f"])


class _Said:
    """The chain's probabilities for one text after another, words being looked up once while they are remembered."""

    def __init__(self, model: Model):
        self.model, self.cache, self.held = model, {}, 0

    def __call__(self, text: str | None) -> list[float]:
        words, cache = set(_words((text or "").lower())), self.cache
        sums = np.zeros(len(self.model.bias))
        for w in words:
            if w not in cache:
                if self.held > CACHE:
                    cache.clear()
                    self.held = 0
                cache[w] = self.model.word(w)
                self.held += len(w) + 8
            if (x := cache[w]) is not None:
                sums += x
        return self.model.chain(sums)


class _Score:
    def __init__(self, model: Model):
        self.model = model

    def __call__(self, batches: Iterator) -> Iterator:
        import pyarrow as pa

        say = _Said(self.model)
        for batch in batches:
            for part in base.slices(batch, 1):
                out = [say(t) for t in part.column(1).to_pylist()]
                cols = [pa.array([x[k] for x in out], pa.float64()) for k in range(len(CATEGORIES))]
                said = pa.array([int(x[-1] >= self.model.threshold) for x in out], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), *cols, said], ["doc_id", *(f"p_{c}" for c in CATEGORIES), "toxic"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, p_open, p_coined, p_toxic (0 to 1) and toxic (1 from the threshold that the out-of-fold scores gave) for
    each row. A null text counts as empty; with nothing to learn from no text is toxic."""
    return docs.select("doc_id", "text").mapInArrow(base.tidied(_Score(model)), f"doc_id {base.id_type(docs)}, p_open double, p_coined double, p_toxic double, toxic int")


def not_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the chain doesn't reject, with the columns they came with."""
    import pyarrow as pa

    def kept(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        say = _Said(model)
        for batch in texts:
            yield pa.array([say(t.as_py())[-1] < model.threshold for t in batch], pa.bool_())

    return docs.where(F.arrow_udf(base.tidied(kept), "boolean", ArrowUDFType.SCALAR_ITER)(docs["text"]))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "labels")
    return score(docs, learn(docs, labels))


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLE: dict[str, str] = {}
