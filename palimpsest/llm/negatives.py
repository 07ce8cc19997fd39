"""Hard negatives by a two-dimensional block matrix multiply.

Scores are integer inner products of anchors with all rows. Anchors and rows are packed into blocks, and each
block of rows meets each block of anchors in a join. For each pair the products of the chunks of dimensions are added up to a tile of
64-bit scores, which is reduced where it stands and never written or shuffled: once to each anchor's first
POSITIVES rows of its label, then, with the windows that these scores open, to the first NEGATIVES of each window. A task
carries its lists on from tile to tile, so it gives one list for each anchor and window; the lists of all tasks are merged by a ranked
window.

At scale: work is anchors times rows, as every score is asked for; what is shuffled is lists, POSITIVES rows and then POSITIVES
times NEGATIVES for each anchor and task. A tile has ROWS times ANCHORS scores whatever the labels, so no label, however common, is
gathered anywhere, and a task holds one tile and its lists. Anchors are taken PANEL at a time (fewer where
vectors are long), so what is broadcast and what a task's lists take is bounded; what a panel gives is written, and its shuffles are
deleted, before the next. All rows are read twice for each panel.
"""

from __future__ import annotations

import contextlib
import functools
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm import base, whitening

ROWS, ANCHORS, CHUNK = 2048, 512, 256
#: Anchors of one pass over the rows.
PANEL = 8192
#: Bytes of a panel's vectors, of a block's vectors and of an Arrow batch, about.
PANEL_BYTES, BLOCK_BYTES, BATCH_BYTES = 16 << 20, 8 << 20, 8 << 20
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
#: The entries of a row's header: has an id, id, label, row; an anchor's windows follow, two each.
HEAD = 4
#: A tile with more candidates an anchor than this is thinned out before they are sorted.
CROWD = 64
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def rows_of(vectors: DataFrame) -> DataFrame:
    """rid, vec_id, label, x of the rows that take part; label is moved on where vec_id is divisible by 7."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    live = vectors.where(F.col("label").isNotNull() & whitening.usable(F.col("embedding")))
    return live.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), moved.cast("long").alias("label"), whitening.scaled(F.col("embedding")).alias("x"))


def _header(*more: Column) -> Column:
    return F.array(F.col("vec_id").isNotNull().cast("long"), F.coalesce("vec_id", F.lit(0)), "label", "rid", *more)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a·bᵀ of integer matrices as longs, exact modulo 2**64; through floats where every partial sum is an integer that they hold."""
    room = [max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0)))) for m in (a, b)]
    bound = room[0] * room[1] * a.shape[1]
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64, copy=False)


def tile(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The scores of a block of anchors with a block of rows: the products of their chunks, added in place."""
    out = product(a[:, :CHUNK], b[:, :CHUNK])
    for k in range(CHUNK, a.shape[1], CHUNK):
        out += product(a[:, k : k + CHUNK], b[:, k : k + CHUNK])
    return out


def _packed(batches: Iterator, most: int, width: int) -> Iterator:
    """Rows (head, x) as blocks of up to ``most``: (n, head, kind, data), the entries in the narrowest type that holds them."""
    import pyarrow as pa

    def block():
        t = pa.Table.from_batches(held).combine_chunks()
        head, x = (t.column(c).combine_chunks() for c in ("head", "x"))
        x = whitening.matrix(x, width)
        kind = next(k for k in ("i2", "i4", "i8") if np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max)
        row = {"n": pa.array([len(x)], pa.int32()), "head": pa.array([whitening.matrix(head, len(head[0])).tobytes()], pa.binary()), "kind": pa.array([kind]), "data": pa.array([x.astype(kind).tobytes()], pa.binary())}
        return pa.RecordBatch.from_pydict(row)

    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            held.append(batch.slice(0, most - n))
            n += held[-1].num_rows
            batch = batch.slice(held[-1].num_rows)
            if n == most:
                yield block()
                held, n = [], 0
    if n:
        yield block()


class Firsts:
    """Of each window of each anchor of a block the first ``most`` rows, by falling score, then by vec_id (null last), then by row;
    of the anchor's own label (``same``) or of others. Tiles come one after the other."""

    def __init__(self, anchors: np.ndarray, same: bool, most: int):
        self.a, self.same, self.most = anchors, same, most
        self.lo, self.hi = (np.full((len(anchors), 1), v, np.int64) for v in (_LEAST, _MOST)) if same else (anchors[:, HEAD::2], anchors[:, HEAD + 1 :: 2])
        self.open = self.lo <= self.hi
        self.floor, self.last = self.lo.copy(), np.full(self.lo.shape, _MOST)  # the least score that still enters, and its greatest vec_id
        self.kept, self.new, self.waiting = np.empty((5, 0), np.int64), [], 0  # window, score, none, vec_id, row

    def take(self, b: np.ndarray, s: np.ndarray) -> None:
        a = self.a
        among = s >= np.where(self.open, self.floor, _MOST).min(1)[:, None]
        if not self.same:
            among &= s <= np.where(self.open, self.hi, _LEAST).max(1)[:, None]
        if np.count_nonzero(among) > CROWD * len(a) and (self.last == _MOST).any():
            among = self._thinned(b, s)
        r, c = np.divmod(np.flatnonzero(among), among.shape[1])
        right = (a[r, 2] == b[c, 2]) & (a[r, 3] != b[c, 3]) if self.same else a[r, 2] != b[c, 2]
        r, c = r[right], c[right]
        v, ids = s[r, c], b[c, 1]
        for w in range(self.lo.shape[1]):
            floor = self.floor[r, w]
            at = np.flatnonzero(self.open[r, w] & (v <= self.hi[r, w]) & ((v > floor) | (v == floor) & (ids <= self.last[r, w])))
            self.new.append(np.stack([r[at] * self.lo.shape[1] + w, v[at], 1 - b[c[at], 0], ids[at], b[c[at], 3]]))
            self.waiting += len(at)
        if self.waiting > 1024 + self.kept.shape[1] // 4:
            self._merge()

    def _thinned(self, b: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Which scores may be among the first of a window, as far as this tile alone tells."""
        own = self.a[:, 2][:, None] == b[:, 2]
        fits, out = own & (self.a[:, 3][:, None] != b[:, 3]) if self.same else ~own, np.zeros(s.shape, bool)
        for w in range(self.lo.shape[1]):
            some = fits & (s >= self.floor[:, w, None]) & (s <= self.hi[:, w, None])
            if s.shape[1] > self.most:
                place = s.shape[1] - self.most
                some &= s >= np.partition(np.where(some, s, _LEAST), place, axis=1)[:, place, None]
            out |= some
        return out

    def _merge(self) -> None:
        rows = np.concatenate([self.kept, *self.new], axis=1)
        rows = rows[:, np.lexsort((rows[4], rows[3], rows[2], ~rows[1], rows[0]))]
        place = np.arange(rows.shape[1]) - np.searchsorted(rows[0], rows[0])
        w, score, none, ids, _ = rows[:, place == self.most - 1]
        self.floor.flat[w], self.last.flat[w] = score, np.where(none == 1, _MOST, ids)
        self.kept, self.new, self.waiting = rows[:, place < self.most], [], 0

    def lists(self) -> tuple[np.ndarray, ...]:
        """anchor, place of the window, score, none, vec_id, other."""
        self._merge()
        w, score, none, ids, other = self.kept
        return self.a[w // self.lo.shape[1], 3], w % self.lo.shape[1], score, none == 1, ids, other


def _unpacked(batch, k: int, side: str) -> tuple[np.ndarray, np.ndarray]:
    """Headers and vectors of a block in row ``k`` of a batch."""
    n, head, kind, data = (batch.column(side + name)[k] for name in ("n", "head", "kind", "data"))
    return tuple(np.frombuffer(d.as_buffer(), t).reshape(n.as_py(), -1) for d, t in ((head, "i8"), (data, kind.as_py())))


def _searched(batches: Iterator, same: bool, most: int) -> Iterator:
    """Pairs of blocks to the first rows of each window of each anchor among a task's rows."""
    import pyarrow as pa

    found: dict[int, Firsts] = {}
    for batch in batches:
        for k in range(batch.num_rows):
            (a, x), (b, y) = (_unpacked(batch, k, side) for side in ("a_", ""))
            first = int(a[0, 3])
            if first not in found:
                found[first] = Firsts(a.copy(), same, most)
            found[first].take(b, tile(x, y))
    for first in found.values():
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(first.lists(), (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], ["anchor", "place", "score", "none", "vec_id", "other"])


def multiply(anchors: DataFrame, rows: DataFrame, width: int, same: bool, most: int) -> DataFrame:
    """Each task's first rows for each anchor's windows. Anchors (a panel's, as they are broadcast) and rows: head, x with ``width`` entries."""
    room = max(1, BLOCK_BYTES // (8 * width))
    pack = lambda df, n: df.select("head", "x").mapInArrow(base.tidied(functools.partial(_packed, most=min(n, room), width=width)), "n int, head binary, kind string, data binary")
    left = pack(anchors, ANCHORS)
    left = left.select(*(F.col(c).alias(f"a_{c}") for c in left.columns))
    pairs = pack(rows, ROWS).crossJoin(F.broadcast(left))
    return pairs.mapInArrow(base.tidied(functools.partial(_searched, same=same, most=most)), "anchor long, place int, score long, none boolean, vec_id long, other long")


def _ranked(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "none", "vec_id", "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def windows(positives: DataFrame) -> DataFrame:
    """anchor, bounds: the least and the largest score of a negative of each of an anchor's positives, one after the other; an
    empty window is (1, 0). ``positives``: anchor, rank, score."""
    # with s = 100 q + r, so that nothing overflows: ceil(LOW s / 100) and floor(HIGH s / 100); under 0 no score lies between
    lo, hi = F.expr(f"(score div 100) * {LOW} + ((score % 100) * {LOW} + 99) div 100"), F.expr(f"(score div 100) * {HIGH} + ((score % 100) * {HIGH}) div 100")
    empty = F.array(F.lit(1).cast("long"), F.lit(0).cast("long"))
    some = positives.select("anchor", "rank", F.when(F.col("score") >= 0, F.array(lo, hi)).otherwise(empty).alias("w"))
    each = [F.coalesce(F.max(F.when(F.col("rank") == r + 1, F.col("w")[at])), F.lit(1 - at).cast("long")) for r in range(POSITIVES) for at in (0, 1)]
    return some.groupBy("anchor").agg(F.array(*each).alias("bounds"))


@contextlib.contextmanager
def _settings(spark: SparkSession) -> Iterator:
    """While panels run: batches of pairs are small, and shuffles are deleted once what they led to is written."""
    held = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def mine(vectors: DataFrame, every: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each anchor (vec_id divisible by ``every``) and positive.

    Rows with a null label, a null vector, or a null or non-finite entry take no part; further columns are ignored. A row without
    vec_id is no anchor, but may be a negative or a positive, last among equal scores. Rows that repeat a vec_id are rows like others.
    A vector shorter than another counts as filled up with zeros; an entry beyond 64 bits after scaling is the nearest
    long, and scores are taken modulo 2**64. An anchor without positives, and a positive without negatives, has no row. An
    empty table gives an empty result. Rows, positives and results are written to the shared folder.
    """
    spark = vectors.sparkSession
    rows = base.save(rows_of(vectors), "vectors")
    longest, asked = rows.agg(F.max(F.size("x")), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    if not asked:
        base.drop(rows)
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width = max(1, longest)
    panels = math.ceil(asked / max(1, min(PANEL, PANEL_BYTES // (8 * width))))
    right = rows.select(_header().alias("head"), "x")
    left = rows.where(F.col("vec_id") % every == 0).withColumn("panel", F.pmod(F.xxhash64("rid", F.lit(13)), F.lit(panels)))
    dealt = math.ceil(asked / panels / ANCHORS)
    made = []
    with _settings(spark):
        for panel in range(panels):
            own = left.where(F.col("panel") == panel)
            near = multiply(own.select(_header().alias("head"), "x").repartition(dealt), right, width, True, POSITIVES)
            positives = base.save(_ranked(near, ["anchor"], POSITIVES).drop("place"), "positives")
            opened = own.join(windows(positives), F.col("rid") == F.col("anchor")).select(F.concat(_header(), "bounds").alias("head"), "x")
            found = multiply(opened.repartition(dealt), right, width, False, NEGATIVES)
            negatives = _ranked(found, ["anchor", "place"], NEGATIVES)
            named = positives.select("anchor", (F.col("rank") - 1).alias("place"), F.when(~F.col("none"), F.col("vec_id")).alias("positive_id"), F.col("score").alias("positive_score"))
            out = negatives.join(named, ["anchor", "place"]).join(own.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
            negative = F.when(~F.col("none"), F.col("vec_id"))
            made.append(base.save(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), negative.alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
            base.drop(positives)
    base.drop(rows)
    return functools.reduce(DataFrame.unionByName, made)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(base.table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda c: NOT isfinite(c))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label,
         coalesce(list_sum(list_transform(generate_series(1, least(len(a.x), len(b.x))), lambda k: a.x[k] * b.x[k])), 0)::BIGINT AS score
  FROM r AS a, r AS b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE label = own
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
  WHERE p.place <= 5
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLE = {"op13_hard_negatives": OP13_SQL}
