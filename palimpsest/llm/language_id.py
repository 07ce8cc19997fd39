"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's letters, lower-cased, and one space for each run of anything else give character n-grams
of GRAMS lengths, hashed into BUCKETS. Each bucket has an embedding; a text's is their average, and
a linear layer with softmax gives the languages. Embeddings and layer are trained by stochastic
gradient descent in numpy. A temperature is then fitted on rows that training left out, and with it
the confidence under which only REJECT of them that were right fall: below it a text is rejected.

At scale: the sample to learn from is bounded (MOST rows, as bags of at most BUCKETS counts, made on
the executors and fitted in one task there); scoring is one pass without a shuffle, in pieces of bounded size, as the layer
applied to an average of embeddings is the average of the layer's rows for each bucket.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import base

GRAMS = (2, 3, 4)
BUCKETS = 1 << 15
DIM = 16
#: Rows to learn from, at most.
MOST = 2000
#: Share of right answers that rejection may cost.
REJECT = 0.01
#: Characters handled at once.
PIECE = 1 << 18


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, with one space around each run of them."""
    text = text.lower()
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(raw) == 0:
        return raw
    letters = _letter(raw)
    flat = np.where(letters, raw, np.uint32(32))
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    flat = flat[keep]
    return np.concatenate([[np.uint32(32)], flat]) if len(flat) else flat


_TABLE = None


def _letter(raw: np.ndarray) -> np.ndarray:
    global _TABLE
    if _TABLE is None:
        _TABLE = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _TABLE[raw]


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each n-gram that starts at each place."""
    m = len(codes) - n + 1
    if m < 1:
        return np.zeros(0, np.uint32)
    h = np.full(m, 2166136261 + n, np.uint32)
    for k in range(n):
        h ^= codes[k : k + m]
        h *= np.uint32(16777619)
    h ^= h >> np.uint32(15)
    return h & np.uint32(BUCKETS - 1)


def _pieces(text: str) -> Iterator[np.ndarray]:
    """Code points in pieces that overlap by an n-gram less one; their n-grams, long ones from each piece's own start, cover the text."""
    codes = _codes(text)
    for at in range(0, max(1, len(codes)), PIECE):
        yield codes[at : at + PIECE + max(GRAMS) - 1], min(PIECE, len(codes) - at)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a whole text."""
    total = np.zeros(BUCKETS, np.int64)
    for piece, own in _pieces(text or ""):
        for n in GRAMS:
            total += np.bincount(_grams(piece, n)[:own], minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at].astype(np.float32)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # what each bucket adds to each language's logit
    bias: np.ndarray
    temperature: float
    least: float

    def logits(self, text: str | None) -> np.ndarray | None:
        """None if there is no letter."""
        total, n = np.zeros(len(self.langs)), 0
        for piece, own in _pieces(text or ""):
            for k in GRAMS:
                g = _grams(piece, k)[:own]
                total += np.bincount(g, minlength=BUCKETS) @ self.table if len(g) > BUCKETS // 4 else self.table[g].sum(0)
                n += len(g)
        return total / n + self.bias if n else None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether it is rejected; ``und``, 0 without a letter."""
        z = self.logits(text)
        if z is None:
            return "und", 0.0, True
        p = _softmax(z / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k]), bool(p[k] < self.least)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(bags: list[tuple[np.ndarray, np.ndarray]], langs: list[str], epochs: int = 6, rate: float = 20.0, seed: int = 7) -> Model:
    """Stochastic gradient descent on single rows in a shuffled order; each tenth row is left out, to calibrate on."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in langs])
    emb, w, b = rng.normal(0, 1 / DIM, (BUCKETS, DIM)), np.zeros((DIM, len(names))), np.zeros(len(names))
    w += rng.normal(0, 0.1, w.shape)
    bags = [(i, c / c.sum() if len(c) else c) for i, c in bags]
    fit = [k for k in range(len(y)) if k % 10 and len(bags[k][0])] or [k for k in range(len(y)) if len(bags[k][0])]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(fit):
            at, c = bags[k]
            x = c @ emb[at]
            d = _softmax(x @ w + b)
            d[y[k]] -= 1
            emb[at] -= step * np.outer(c, w @ d)
            w -= 0.02 * step * np.outer(x, d)
            b -= 0.001 * step * d
    table = emb @ w
    out = [k for k in range(len(y)) if k % 10 == 0 and len(bags[k][0])] or fit
    z = np.array([bags[k][1] @ table[bags[k][0]] + b for k in out]).reshape(-1, len(names))
    t = min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(out)), y[out]], 1e-12)).mean()) if len(out) else 1.0
    p = _softmax(z / t) if len(out) else z
    right = p.max(1)[p.argmax(1) == y[out]] if len(out) else np.zeros(0)
    return Model(names, table, b, float(t), float(np.quantile(right, REJECT)) if len(right) else 0.0)


def learn(docs: DataFrame, allowed: Column, most: int = MOST) -> Model:
    """Fits on a bounded, deterministic sample of the rows of ``docs`` that are allowed and have a language."""
    ids = docs.where(allowed & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.where(allowed & F.col("lang").isNotNull()).join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "text", "lang")
    bags = rows.mapInArrow(base.tidied(_bags), f"doc_id {base.id_type(docs)}, lang string, at binary, n binary")
    got = bags.orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "at").limit(most).mapInArrow(base.tidied(_fitted), "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else train([], [])


def _fitted(batches: Iterator) -> Iterator:
    """The model of the rows to learn from, trained where they are: only the model goes to the driver."""
    import pyarrow as pa

    bags, langs = [], []
    for batch in batches:
        langs += batch.column(1).to_pylist()
        bags += [(np.frombuffer(a, np.int32), np.frombuffer(b, np.float32)) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(bags, langs))], pa.binary())], ["model"])


def _bags(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for part in base.slices(batch, 1):
            got = [bag(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([i.tobytes() for i, _ in got], pa.binary()), pa.array([c.tobytes() for _, c in got], pa.binary())], ["doc_id", "lang", "at", "n"])


class _Predict:
    def __init__(self, model: Model):
        self.model = model

    def __call__(self, batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in base.slices(batch, 1):
                got = [self.model.predict(t) if self.model.langs else ("und", 0.0, True) for t in part.column(1).to_pylist()]
                cols = [pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["doc_id", "lang_pred", "score", "rejected"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row. Null texts and texts without a letter are ``und`` with score 0;
    so is every text if there was nothing to learn from."""
    return docs.select("doc_id", "text").mapInArrow(base.tidied(_Predict(model)), f"doc_id {base.id_type(docs)}, lang_pred string, score double, rejected boolean")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    out = predict(docs, learn(docs, ~held))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op3_language_id": op3_language_id}
ORACLE: dict[str, str] = {}
