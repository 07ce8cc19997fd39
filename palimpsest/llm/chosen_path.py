"""Near-duplicate join on five-word shingles by chosen paths.

Documents of one shingle set are one class, and each class is handled once. A set is summed up by
COORDS tokens, its min-hashes. In each of a number of runs the sets walk down random paths: a node
samples coordinates, by a hash of the path to it (one always, a second with probability SECOND), and
a set goes to a child for each of them, by its token there. A pair at the threshold so meets again in
one child on average, however deep (``survival``). A bucket of SMALL sets or fewer isn't split, nor is one that
splitting wouldn't part: a larger one is split unless most of its sets seem near to each other. No set leaves
a bucket before it is compared, so runs are added until a pair at the threshold shares a bucket with
probability RECALL at the deepest level that any bucket reached.

Buckets are brute-forced, twice: first by min-hashes, which says who may have a partner (LOOSE) that it has
met in no earlier bucket; then those sets alone, by their exact Jaccard similarity. A pair that shares
several buckets is compared and counted in the one with the least path, as each set carries the paths of its buckets.

At scale: pairs are never written down; a bucket gives back a spanning forest and each set's number of
links. A walk carries two integers a row, the first comparison min-hashes, the second whole sets, but only where they
may have a partner. Rows are linear in sets times runs, but for buckets of over TILE sets, all near each other: there every set has
a link to be counted with nearly every other, so blocks meet in pairs, and a row goes to as many tiles as there are blocks.
A tile is bounded in sets and in shingles; nothing is capped. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import base

WORDS = 5
#: As a fraction too: sets that share s of their m and n elements are linked if s * (FOUR + FIVE) >= FOUR * (m + n).
FOUR, FIVE = 4, 5
THRESHOLD = FOUR / FIVE
COORDS = 48
#: Sets of a bucket that isn't split, and of a block at most, on average; two blocks make a tile.
SMALL = 2000
TILE = 2000
#: Shingles of a block, on average at most.
TILE_SHINGLES = 2_000_000
RECALL = 0.999
#: How often a node samples a second coordinate, so that a pair at the threshold meets in one child on average.
SECOND = 1 / THRESHOLD - 1
#: The depth that the first runs are made for; more are added if buckets lie deeper.
USUAL = 3
#: Estimated similarity from which sets are linked loosely: four standard errors under the threshold.
LOOSE = THRESHOLD - 4 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / COORDS)
#: Estimated similarity from which splitting hardly parts two sets: half of that margin. So many sets of a large bucket are looked at.
DENSE, LOOK = (THRESHOLD + LOOSE) / 2, 16


def survival(depth: int) -> float:
    """Probability that a pair at the threshold still shares a bucket after so many splits."""
    u = 1.0
    for _ in range(depth):
        u = 1 - (1 - THRESHOLD * u) * (1 - SECOND * THRESHOLD * u)
    return u


def runs_for(depth: int) -> int:
    """Runs that give such a pair RECALL."""
    return math.ceil(math.log(1 - RECALL) / math.log(1 - survival(depth))) if depth else 1


_rng = np.random.default_rng(20)
_MUL = _rng.integers(0, 1 << 63, COORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 1 << 63, COORDS, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C55)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = []
_ALNUM: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        m = max(n, 1 << 16)
        _POWERS[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(m, b, np.uint64))]) for b in (_BASE, _BACK)]
    return _POWERS


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's five-word shingles; of all its words if it has fewer; none without a word.
    Words are lower-cased runs of letters and digits."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not _ALNUM:
        _ALNUM.append(np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000))
    inside = _ALNUM[0][raw]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    codes = np.where(inside, raw, np.uint32(32))[keep]
    if not len(codes):
        return np.zeros(0, np.uint64)
    if codes[-1] != 32:
        codes = np.append(codes, np.uint32(32))
    ends = np.flatnonzero(codes == 32) + 1
    starts = np.append(0, ends[:-1])
    up, down = _powers(len(codes))
    sums = np.append(np.uint64(0), np.cumsum(codes.astype(np.uint64) * up[: len(codes)]))
    k = min(WORDS, len(ends))
    lo, hi = starts[: len(ends) - k + 1], ends[k - 1 :]
    h = (sums[hi] - sums[lo]) * down[lo]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def signature(h: np.ndarray) -> np.ndarray:
    out = np.empty(COORDS, np.uint64)
    for k in range(COORDS):
        out[k] = ((h ^ _XOR[k]) * _MUL[k]).min()
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _digest(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def _signed(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for part in base.slices(batch, 2):
            sets = [shingles(t) for t in part.column(2).to_pylist()]
            digest = pa.array([_digest(h) if len(h) else None for h in sets], pa.binary())
            sig = pa.array([signature(h).tobytes() if len(h) else None for h in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), digest, sig, pa.array([len(h) for h in sets], pa.int64())], ["doc_id", "mark", "digest", "sig", "size"])


def _filled(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for part in base.slices(batch, 1):
            sets = [shingles(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_digest(h) if len(h) else None for h in sets], pa.binary()), pa.array([h.tobytes() for h in sets], pa.binary())], ["k_doc_id", "k_digest", "own"])


def _forest(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span what a tile connects: each id with the least id it reaches."""
    n = len(a)
    ids = np.concatenate([a, b])
    lab = ids.copy()
    top = np.iinfo(np.int64).max
    while True:
        old = lab.copy()
        lab[:n] = np.minimum(lab[:n], np.where(near, lab[None, n:], top).min(1, initial=top))
        lab[n:] = np.minimum(lab[n:], np.where(near, lab[:n, None], top).min(0, initial=top))
        if (old == lab).all():
            break
    return [(int(x), int(y)) for x, y in {*zip(ids[ids != lab].tolist(), lab[ids != lab].tolist(), strict=True)}]


def _tile(t):
    """The two sides of a tile; the second is None where a block meets itself."""
    side = t.column("side").to_numpy()
    return (t, None) if t.column("same")[0].as_py() else (t.filter(side == 0), t.filter(side == 1))


def _ids(t) -> np.ndarray:
    return t.column("rid").to_numpy()


def met_before(t, u, path: int) -> np.ndarray:
    """Which pairs of two tables (with the column ``paths``, each row's buckets) share a bucket before this one."""
    seen = np.zeros((t.num_rows, u.num_rows), bool)
    sides = []
    for s in (t, u):
        lists = s.column("paths").combine_chunks()
        ids, rows = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        keep = ids < path
        order = np.argsort(ids[keep], kind="stable")
        ids, rows = ids[keep][order], rows[keep][order]
        sides.append((*np.unique(ids, return_index=True), rows))
    (ka, ia, ra), (kb, ib, rb) = sides
    ea, eb = np.append(ia[1:], len(ra)), np.append(ib[1:], len(rb))
    for k in np.intersect1d(ka, kb, assume_unique=True):
        i, j = np.searchsorted(ka, k), np.searchsorted(kb, k)
        seen[np.ix_(ra[ia[i] : ea[i]], rb[ib[j] : eb[j]])] = True
    return seen


def _new(near: np.ndarray, x, y, same: bool) -> np.ndarray:
    """Near pairs of a tile that are this bucket's to count."""
    near = near & ~met_before(x, y, x.column("path")[0].as_py())
    if same:
        np.fill_diagonal(near, False)
    return near


def _loose(batches: Iterator) -> Iterator:
    """(rid, path) of the sets that may have a partner in a bucket which they haven't met in an earlier one."""
    import pyarrow as pa

    for t in base.runs(batches):
        x, y = _tile(t)
        same = y is None
        y = x if same else y
        if x.num_rows and y.num_rows:
            sx, sy = (np.frombuffer(b"".join(s.column("sig").to_pylist()), np.int32).reshape(-1, COORDS) for s in (x, y))
            near = np.zeros((len(sx), len(sy)), np.uint8)
            for k in range(COORDS):
                near += sx[:, k, None] == sy[None, :, k]
            near = _new(near >= LOOSE * COORDS, x, y, same)
            ids = np.unique(np.concatenate([_ids(x)[near.any(1)], _ids(y)[near.any(0)]]))
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([x.column("path")[0].as_py()] * len(ids), pa.int64())], ["rid", "path"])


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of ``x`` shares with each of ``y``, by products of 0/1 matrices over their common elements."""
    fx, fy = np.concatenate(x), np.concatenate(y)
    common = np.intersect1d(fx, fy)
    out = np.zeros((len(x), len(y)), np.float32)
    rx, ry = np.repeat(np.arange(len(x)), [len(s) for s in x]), np.repeat(np.arange(len(y)), [len(s) for s in y])
    px, py = np.searchsorted(common, fx), np.searchsorted(common, fy)
    okx, oky = common[np.minimum(px, len(common) - 1)] == fx if len(common) else fx != fx, common[np.minimum(py, len(common) - 1)] == fy if len(common) else fy != fy
    px, rx, py, ry = px[okx], rx[okx], py[oky], ry[oky]
    for lo in range(0, len(common), 4096):
        width = min(4096, len(common) - lo)
        mx, my = np.zeros((len(x), width), np.float32), np.zeros((len(y), width), np.float32)
        i, j = (px >= lo) & (px < lo + width), (py >= lo) & (py < lo + width)
        mx[rx[i], px[i] - lo] = 1
        my[ry[j], py[j] - lo] = 1
        out += mx @ my.T
    return out


def _exact(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for t in base.runs(batches):
        x, y = _tile(t)
        same = y is None
        y = x if same else y
        rows: list[tuple[int, int | None, int]] = []
        if x.num_rows and y.num_rows:
            hx, hy = ([np.frombuffer(b, np.uint64) for b in s.column("own").to_pylist()] for s in (x, y))
            both = overlaps(hx, hy)
            nx, ny = (np.array([len(h) for h in s], np.int32) * FOUR for s in (hx, hy))
            near = _new(both.astype(np.int32) * (FOUR + FIVE) >= nx[:, None] + ny[None, :], x, y, same)
            rows += [(a, b, 0) for a, b in _forest(near, _ids(x), _ids(y))]
            rows += [(int(i), None, int(n)) for i, n in zip(_ids(x), near.sum(1), strict=True) if n]
            if not same:
                rows += [(int(i), None, int(n)) for i, n in zip(_ids(y), near.sum(0), strict=True) if n]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1, 2)], ["a", "b", "n"])


def _tiles(rows: DataFrame, payload: str, blocks: Column) -> DataFrame:
    """Rows (rid, path, paths) dealt to the tiles of their bucket: its blocks meet in pairs."""
    dealt = rows.withColumn("blocks", blocks.cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rid", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    tile = F.xxhash64("path", lo, hi)
    dealt = dealt.select(tile.alias("tile"), "rid", "path", "paths", payload, (F.col("block") == F.col("other")).alias("same"), (F.col("block") == hi).cast("int").alias("side"))
    return dealt.repartition("tile").sortWithinPartitions("tile", "rid")


def _token(path: str, seed: int) -> Column:
    """The path to the child that a set (``sig``) goes to from a node by the coordinate that the node samples under a seed."""
    k = F.pmod(F.xxhash64(path, F.lit(seed)), F.lit(COORDS)).cast("int")
    return F.xxhash64(path, k, F.substring(F.col("sig"), k * 4 + 1, F.lit(4)))


def _children(rows: DataFrame) -> DataFrame:
    """rid, path of each set (rid, sig, path) in each child that it goes to."""
    more = F.pmod(F.xxhash64("path", F.lit(5)), F.lit(1 << 20)) < int(SECOND * (1 << 20))
    made = rows.select("rid", _token("path", 7).alias("one"), F.when(more, _token("path", 8)).alias("two"))
    return made.select("rid", F.explode(F.when(F.col("two").isNull() | (F.col("one") == F.col("two")), F.array("one")).otherwise(F.array("one", "two"))).alias("path"))


def _dense(big: DataFrame, sets: DataFrame) -> DataFrame:
    """path of the large buckets in which most of LOOK sets, picked by hash, seem near to the first of them. They decide whether the bucket is split
    or compared as it is, either of which is right; no set depends on being picked."""
    at = lambda c, k: F.substring(c, k * 4 + 1, F.lit(4))
    near = lambda x: F.size(F.filter(F.sequence(F.lit(0), F.lit(COORDS - 1)), lambda k: at(x, k) == at(F.col("some")[0], k))) >= DENSE * COORDS
    some = F.array(*[F.min_by("sig", F.xxhash64("rid", F.lit(seed))) for seed in range(LOOK)])
    looked = big.join(sets.select("rid", "sig"), "rid").groupBy("path").agg(some.alias("some"))
    return base.save(looked.where(F.size(F.filter("some", near)) * 2 >= LOOK).select("path"), "dense")


def _walk(sets: DataFrame, first: int, last: int) -> tuple[list[DataFrame], int]:
    """Runs ``first`` to ``last``: buckets to compare (rid, path, n), and how deep the deepest lies."""
    starts = sets.select("rid", "sig", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("run")).select("rid", "sig", F.xxhash64("run").alias("path"))
    rows, found, depth = base.save(_children(starts), "children"), [], 0
    while True:
        depth += 1
        sizes = base.save(rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
        hot = sizes.where(F.col("n") >= base.HOT_ROWS).orderBy(F.desc("n"), "path").limit(base.HOT_KEYS).collect()  # a bounded list
        many = F.try_element_at(F.create_map(*[F.lit(v) for r in hot for v in (r.path, r.n)]), F.col("path")) if hot else F.lit(None).cast("long")
        told = rows.withColumn("many", many)
        rest = told.where("many IS NULL").drop("many").join(sizes, "path")
        met = base.save(rest.unionByName(told.where("many IS NOT NULL").withColumnRenamed("many", "n")), f"walk{depth}")
        base.drop(rows, sizes)
        found.append(met.where(F.col("n") <= SMALL))
        big = met.where(F.col("n") > SMALL)
        if not big.head(1):
            return found, depth
        dense = _dense(big, sets)
        dense = F.broadcast(dense) if dense.count() <= base.BROADCAST_ROWS else dense
        found.append(big.join(dense, "path", "left_semi").select("rid", "path", "n"))
        rows = base.save(_children(big.join(dense, "path", "left_anti").join(sets.select("rid", "sig"), "rid")), "children")


def join(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, set_id, set_size, n_links, mark, first.

    set_id is the least doc_id with the same shingle set and set_size their number; n_links is the number of other sets
    with a Jaccard similarity of THRESHOLD or more; class_id is the least doc_id that links lead to; first marks the
    row of each class with that doc_id (of several such, one). A null or wordless text is a class of its own. Rows that repeat a doc_id count like others; a null
    doc_id is never the least unless all are null. An empty table gives an empty result. A doc_id of any type that sorts will do.
    """
    docs = docs.select("doc_id", "text")
    kind = base.id_type(docs)
    signed = docs.select("doc_id", base.by_id().alias("mark"), "text").mapInArrow(base.tidied(_signed), f"doc_id {kind}, mark long, digest binary, sig binary, size long")
    signed = base.save(signed.withColumn("rid", F.monotonically_increasing_id()), "signed")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    sets = signed.where("digest is not null").groupBy("digest").agg(
        F.count(F.lit(1)).alias("set_size"), F.min(order).alias("least"), F.min(F.struct("rid", "doc_id", "sig", "size")).alias("rep")
    )
    sets = base.save(sets.select("digest", "set_size", F.col("least.doc_id").alias("set_id"), F.col("least.rid").alias("head"), F.col("rep.rid").alias("rid"), F.col("rep.doc_id").alias("rep_doc"), F.col("rep.sig").alias("sig"), F.col("rep.size").alias("size")), "sets")
    done, need, leaves = 0, runs_for(USUAL), []
    while done < need:
        found, depth = _walk(sets, done + 1, need)
        leaves += found
        done, need = need, max(need, runs_for(depth))
    met = base.save(functools.reduce(DataFrame.unionByName, leaves), "met")
    base.drop(*leaves)
    carried = sets.select("rid", "sig").join(met.groupBy("rid").agg(F.collect_list("path").alias("paths")), "rid")
    maybe = base.save(_tiles(met.join(carried, "rid"), "sig", F.ceil(F.col("n") / TILE)).mapInArrow(base.tidied(_loose), "rid long, path long").distinct(), "maybe")
    wide = maybe.join(sets.select("rid", "size"), "rid")
    sized = base.attach(maybe, wide.groupBy("path").agg(F.count(F.lit(1)).alias("sets"), F.sum("size").alias("total")), ["path"], "sets")
    blocks = F.ceil(F.greatest(F.col("sets") / TILE, F.col("total") / TILE_SHINGLES))
    need_rows = base.save(maybe.select("rid").distinct().join(sets.select("rid", "rep_doc", "digest"), "rid"), "need")
    few = need_rows.count() <= base.BROADCAST_ROWS
    ids = need_rows.select(F.col("rep_doc").alias("k")).distinct()
    wanted = docs.join(F.broadcast(ids) if few else ids, docs["doc_id"].eqNullSafe(F.col("k")), "left_semi").select("doc_id", "text")
    own = wanted.mapInArrow(base.tidied(_filled), f"k_doc_id {kind}, k_digest binary, own binary")
    full = own.join(need_rows, F.col("k_doc_id").eqNullSafe(F.col("rep_doc")) & (F.col("k_digest") == F.col("digest"))).dropDuplicates(["rid"]).select("rid", "own")
    placed = sized.select("rid", "path", blocks.alias("n")).join(carried.select("rid", "paths"), "rid").join(full, "rid")
    links = base.save(_tiles(placed, "own", F.col("n")).mapInArrow(base.tidied(_exact), "a long, b long, n long"), "links")
    exact = base.components(links.where("b is not null").select("a", "b"))
    counts = links.where("b is null").groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("n_links"))
    known = sets.join(exact.select(F.col("node").alias("rid"), "root"), "rid", "left").join(counts, "rid", "left")
    known = known.select("digest", "set_size", "set_id", "head", F.coalesce("root", "rid").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    tops = known.groupBy("root").agg(F.min(F.struct(F.col("set_id").isNull().alias("none"), "set_id", "head")).alias("top"), F.count(F.lit(1)).alias("sets"))
    known = base.save(base.attach(known, tops, ["root"], "sets").select("digest", "set_size", "set_id", "n_links", F.col("top.set_id").alias("class_id"), F.col("top.head").alias("first_row")), "known")
    some = base.attach(signed.where("digest is not null").select("digest", "doc_id", "mark", "rid"), known, ["digest"], "set_size")
    some = some.select("doc_id", "class_id", "set_id", "set_size", "n_links", "mark", (F.col("rid") == F.col("first_row")).alias("first"))
    none = signed.where("digest is null").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("set_id"), F.lit(1).cast("long").alias("set_size"), F.lit(0).cast("long").alias("n_links"), "mark", F.lit(True).alias("first"))
    base.drop(met, maybe, sets, need_rows, links)
    return some.unionByName(none)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class of ``docs``, with the columns it came with."""
    return base.without(docs, join(docs).select("doc_id", "mark", F.col("first").alias("kept")))


def op8_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(base.table(spark, sf_dir, "documents")).drop("mark", "first")


QUERIES = {"op8_chosen_path": op8_chosen_path}
ORACLE: dict[str, str] = {}
