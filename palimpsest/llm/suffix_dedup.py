"""Removal of repeated byte strings of SPAN bytes by suffix arrays of shards.

Which strings can repeat at all: of the GRAM-byte grams in a SPAN-byte string the one of least hash
(leftmost on ties) is its anchor. Equal strings have equal anchors, so only strings whose anchor's
hash occurs more than once can repeat. The strings of one anchor start side by side; their stretch of
text is a region, and a string lies in exactly one. Regions that are equal as a whole repeat as a
whole, and one of them stands for all. Regions that share an anchor but differ go to a shard, where
a suffix array decides: suffixes are classified, the leftmost-smaller substrings sorted (recursively
where their names aren't distinct), all suffixes induced from them in two linear scans, and
common prefixes computed in text order (permuted). A string repeats where a neighbour in the array
shares SPAN bytes. Found spans go back to all regions that the one stood for. That regions are equal as
a whole is told by the anchor's hash and two more polynomial hashes, 128 mixed bits, not by their bytes.

At scale: a text is cut into anchors where it is read, one for about 70 bytes, and an anchor
travels as a few integers. Only the regions that differ under one anchor travel as bytes. An anchor
with more than CROWD different regions (a passage in very many texts) takes several shards; a string
that doesn't repeat within its shard is then also counted over them, by a 128-bit digest.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import base

SPAN = 200
GRAM = 64
#: Different regions of an anchor that go to a shard at most; they take 1.4 MB, and sorting them some 200 MB of a worker.
CROWD = 4096
#: Anchors are dealt to so many shards for each region, so that a shard has about 200 regions.
SHARD_REGIONS = 200
#: Starts handled at once in a long text.
PIECE = 1 << 20

_BASE = 0x9E3779B97F4A7C55
_BASE2 = 0xC2B2AE3D27D4EB4D
_POWERS: dict[int, list[np.ndarray]] = {}


def _prefix(raw: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of byte * power before each place, and the inverse powers, modulo 2**64."""
    if b not in _POWERS or len(_POWERS[b][0]) <= len(raw):
        n = max(len(raw) + 1, 1 << 16)
        _POWERS[b] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, x, np.uint64))]) for x in (b, pow(b, -1, 1 << 64))]
    up, down = _POWERS[b]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return sums, down


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash of the anchor, hash of the region, first start, last start) of each region of a text's bytes, in order."""
    out = []
    starts = len(raw) - SPAN + 1
    for at in range(0, max(starts, 0), PIECE):
        part = raw[at : min(len(raw), at + PIECE + SPAN - 1)]
        sums, down = _prefix(part, _BASE)
        grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(part) - GRAM + 1])
        width = SPAN - GRAM + 1
        n = len(grams) - width + 1
        # the leftmost least gram of each window, by doubling
        least, place, have = grams, np.arange(len(grams), dtype=np.int32), 1
        while have < width:
            step = min(have, width - have)
            take = least[step:] < least[:-step]
            place = np.where(take, place[step:], place[:-step])
            least = np.where(take, least[step:], least[:-step])
            have += step
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        last = np.append(first[1:] - 1, n - 1)
        sums2, down2 = _prefix(part, _BASE2)
        whole = _mixed((sums[last + SPAN] - sums[first]) * down[first]) ^ _mixed((sums2[last + SPAN] - sums2[first]) * down2[first] + np.uint64(77))
        out.append((least[first].view(np.int64), whole.view(np.int64), first + at, last + at))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def suffix_array(s: np.ndarray, top: int) -> list[int]:
    """Suffixes of ``s`` (0 to top, the last symbol least of all and unique) in order, by induced sorting."""
    n = len(s)
    if n == 1:
        return [0]
    # a suffix is less than the next where the next differing symbol is greater
    turn = np.flatnonzero(s[:-1] != s[1:])
    rises = s[turn] < s[turn + 1]
    small = np.append(rises[np.searchsorted(turn, np.arange(n - 1))], True)
    edge = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    ends = np.cumsum(np.bincount(s, minlength=top + 1))
    tails, heads = ends.tolist(), [0, *ends[:-1].tolist()]
    symbols = s.tolist()
    # by place: the symbol before it, if the suffix there is of the kind that a scan induces, else -1
    fall = [-1, *np.where(small[:-1], -1, s[:-1]).tolist()]
    rise = [-1, *np.where(small[:-1], s[:-1], -1).tolist()]

    def induced(order) -> list[int]:
        sa, tail = [0] * n, tails[:]
        for i in reversed(order):
            c = symbols[i]
            tail[c] -= 1
            sa[tail[c]] = i
        head = heads[:]
        for j in sa:  # reads what it has just put there; a place still empty holds 0, before which there is nothing
            c = fall[j]
            if c >= 0:
                sa[head[c]] = j - 1
                head[c] += 1
        tail = tails[:]
        for j in reversed(sa):
            c = rise[j]
            if c >= 0:
                tail[c] -= 1
                sa[tail[c]] = j - 1
        return sa

    if not len(edge):
        return induced([])
    rough = np.array(induced(edge.tolist()))
    is_edge = np.zeros(n, bool)
    is_edge[edge] = True
    order = rough[is_edge[rough]]
    # neighbours in that order have one name if their substrings, up to the next edge with it, are equal
    width = np.append(edge[1:], n - 1) - edge + 1
    wide = np.zeros(n, np.int64)
    wide[edge] = width
    w = wide[order]
    raw, step = s.astype(np.int32).tobytes(), 4
    at, length = (order * step).tolist(), (w * step).tolist()
    names, name, before = [0] * len(at), 0, raw[at[0] : at[0] + length[0]]
    for k in range(1, len(at)):
        piece = raw[at[k] : at[k] + length[k]]
        if piece != before:
            name += 1
            before = piece
        names[k] = name
    if name + 1 < len(order):
        named = np.zeros(n, np.int64)
        named[order] = names
        order = edge[suffix_array(named[edge], name)]
    return induced(order.tolist())


def common_prefixes(s: np.ndarray, sa: list[int], parts: list[tuple[int, int]] | None = None) -> list[int]:
    """For each place of the text (in ``parts`` alone, if given), how much its suffix shares with the one before it in the array."""
    n = len(s)
    before = np.zeros(n, np.int64)
    array = np.array(sa)
    before[array[1:]] = array[:-1]
    before[array[0]] = -1
    raw = s.astype(np.uint32).tobytes().decode("utf-32-le")  # one character for each symbol, so parts compare at once
    out = [0] * n
    for lo, hi in parts or [(0, n)]:
        same = 0
        for i, j in enumerate(before[lo:hi].tolist(), lo):
            if j < 0:
                same = 0
                continue
            top = n - (i if i > j else j)
            while same < top and raw[i + same : i + same + 24] == raw[j + same : j + same + 24]:
                same += 24
            if same > top:
                same = top
            while same < top and raw[i + same] == raw[j + same]:
                same += 1
            out[i] = same
            if same:
                same -= 1
    return out


def may_repeat(regions: list[bytes]) -> list[bool]:
    """Which of an anchor's regions may share a string. A string holds its anchor and SPAN - GRAM bytes about it, so it
    holds one of four stretches about the anchor, each shorter by a quarter of that, that another region then has too."""
    outside = SPAN - GRAM
    step = outside // 4
    keys = []
    for r in regions:
        raw = np.frombuffer(r[:SPAN], np.uint8)
        sums, down = _prefix(raw, _BASE)
        at = int(_mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(raw) - GRAM + 1]).argmin())
        keys.append([(k, r[at - k * step : at + GRAM + outside - (k + 1) * step]) for k in range(4) if at >= k * step and len(r) >= at + GRAM + outside - (k + 1) * step])
    seen = Counter(x for own in keys for x in own)
    return [any(seen[x] > 1 for x in own) for own in keys]


def repeats(regions: list[bytes]) -> list[np.ndarray]:
    """Which starts of SPAN-byte strings in each region repeat among all of them, as bool arrays."""
    m = len(regions)
    ends = np.cumsum([len(r) + 1 for r in regions]) - 1
    s = np.frombuffer(b"\0".join(regions) + b"\0", np.uint8).astype(np.int64) + m
    s[ends] = np.arange(m)[::-1]  # each end differs and they fall, so no common prefix crosses one and the last is least
    sa = suffix_array(s, m + 255)
    starts = [(end - len(r), end - SPAN + 1) for r, end in zip(regions, ends.tolist(), strict=True)]
    shared = np.array(common_prefixes(s, sa, starts))
    order = np.array(sa)
    far = np.flatnonzero(shared[order] >= SPAN)
    flags = np.zeros(len(s), bool)
    flags[order[far]] = True
    flags[order[far - 1]] = True
    return [flags[end - len(r) : end - SPAN + 1] for r, end in zip(regions, ends.tolist(), strict=True)]


def _anchored(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for part in base.slices(batch, 2):
            got = [anchors(np.frombuffer((t or "").encode(), np.uint8)) for t in part.column(2).to_pylist()]
            many = pa.array(np.repeat(np.arange(len(got)), [len(g[0]) for g in got]), pa.int32())
            cols = [pa.array(np.concatenate([g[k] for g in got]), pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(many), part.column(1).take(many), *cols], ["doc_id", "mark", "h", "d", "lo", "hi"])


def _cut(batches: Iterator) -> Iterator:
    """Bytes of the regions asked for: doc text, and arrays of h, d, lo, hi."""
    import pyarrow as pa

    for batch in batches:
        for part in base.slices(batch, 0, 1 << 18):
            rows = []
            for r in part.to_pylist():
                raw = (r["text"] or "").encode()
                rows += [(x["h"], x["d"], x["crowd"], x["blocks"], raw[x["lo"] : x["hi"] + SPAN]) for x in r["asked"]]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()))], ["h", "d", "crowd", "blocks", "bytes"])


def _runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _sorted_shards(batches: Iterator) -> Iterator:
    """Runs a to b of repeated starts in each region of a shard. Of an anchor in several shards also its strings by digest:
    with weight 1 those that don't repeat within the shard, at their start a, and with weight 2 one of each that does."""
    import pyarrow as pa

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
    for t in base.runs(batches):
        h, d, own, crowd = (t.column(c).to_pylist() for c in ("h", "d", "bytes", "crowd"))
        cuts = [0, *(k for k in range(1, len(h)) if h[k] != h[k - 1]), len(h)]
        asked = [lo + k for lo, hi in zip(cuts, cuts[1:], strict=False) for k, yes in enumerate([True] * (hi - lo) if crowd[lo] else may_repeat(own[lo:hi])) if yes]
        found = repeats([own[k] for k in asked]) if asked else []
        rows: list[tuple] = []
        twice: set[bytes] = set()
        for k, flags in zip(asked, found, strict=True):
            rows += [(h[k], d[k], a, b, None, 0) for a, b in _runs_of(flags)]
            if crowd[k]:
                for a, yes in enumerate(flags.tolist()):
                    name = hashlib.blake2b(own[k][a : a + SPAN], digest_size=16).digest()
                    if not yes:
                        rows.append((h[k], d[k], a, a, name, 1))
                    elif name not in twice:
                        twice.add(name)
                        rows.append((h[k], d[k], a, a, name, 2))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds)], ["h", "d", "a", "b", "s", "weight"])


def _removed(batches: Iterator) -> Iterator:
    """Of a text and its repeated runs of starts: what the query and the operator give back."""
    import pyarrow as pa

    for batch in batches:
        for part in base.slices(batch, 2, 1 << 20):
            ids, texts, spans = part.column(0), part.column(2).to_pylist(), part.column(3).to_pylist()
            rows = []
            for text, runs in zip(texts, spans, strict=True):
                raw = (text or "").encode()
                merged: list[list[int]] = []
                for a, b in sorted((x["a"], x["b"] + SPAN) for x in runs or []):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                ends = [0, *(x for m in merged for x in m), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                rows.append((len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc_id, mark (base.by_id of the text), a, b: the starts of repeated strings, as runs a to b, of each text."""
    found = docs.select("doc_id", base.by_id().alias("mark"), "text").mapInArrow(base.tidied(_anchored), f"doc_id {base.id_type(docs)}, mark long, h long, d long, lo long, hi long")
    found = base.save(found, "anchors")
    often = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = base.save(base.attach(found, often, ["h"], "n").where("n > 1").drop("n"), "met")
    kinds = met.groupBy("h", "d").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc_id", "mark", "lo", "hi")).alias("one"))
    per = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"))
    kinds = base.save(base.attach(kinds, per, ["h"], "kinds"), "kinds")
    whole = kinds.where("times > 1").select("h", "d", F.lit(0).cast("long").alias("a"), (F.col("one.hi") - F.col("one.lo")).alias("b"), "times")
    differ = kinds.where("kinds > 1")
    n = differ.where(F.col("kinds") <= CROWD).count()
    asked = differ.groupBy(F.col("one.doc_id").alias("k_id"), F.col("one.mark").alias("k_mark")).agg(
        F.collect_list(F.struct("h", "d", F.col("one.lo").alias("lo"), F.col("one.hi").alias("hi"), (F.col("kinds") > CROWD).alias("crowd"), F.ceil(F.col("kinds") / CROWD).alias("blocks"))).alias("asked")
    )
    keys = base.save(asked, "asked")
    met_text = docs["doc_id"].eqNullSafe(F.col("k_id")) & (base.by_id() == F.col("k_mark"))
    few = keys.count() <= base.BROADCAST_ROWS
    ids = keys.select("k_id", "k_mark")
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, met_text, "left_semi").withColumn("mark", base.by_id()).dropDuplicates(["doc_id", "mark"])
    cut = texts.join(keys, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("mark") == F.col("k_mark"))).select("text", "asked").mapInArrow(base.tidied(_cut), "h long, d long, crowd boolean, blocks long, bytes binary")
    cut = base.save(cut, "regions")
    plain = F.pmod(F.xxhash64("h"), F.lit(max(1, n // SHARD_REGIONS)))
    shards = cut.withColumn("shard", F.when(F.col("crowd"), F.xxhash64("h", F.pmod(F.xxhash64("d"), F.col("blocks")))).otherwise(plain)).select("shard", "h", "d", "bytes", "crowd")
    done = shards.repartition("shard").sortWithinPartitions("shard", "h", "d").mapInArrow(base.tidied(_sorted_shards), "h long, d long, a long, b long, s binary, weight int")
    done = base.save(done, "sorted")
    by_sort = done.where("s is null").select("h", "d", "a", "b")
    times = done.where("s is not null").groupBy("s").agg(F.sum("weight").alias("n")).where("n > 1")
    by_count = base.attach(done.where("weight = 1").select("s", "h", "d", "a", "b"), times, ["s"], "n").where("n > 1").select("h", "d", "a", "b")
    once = kinds.where("times = 1").select("h", "d", "times")
    part = by_sort.unionByName(by_count).join(once, ["h", "d"])
    spans = base.save(whole.unionByName(part.select("h", "d", "a", "b", "times")), "spans")
    base.drop(found, keys, cut, done)
    # regions that stand for themselves need no join: their place is known
    single = spans.where("times = 1").join(kinds.where("times = 1").select("h", "d", "one"), ["h", "d"])
    single = single.select(F.col("one.doc_id").alias("doc_id"), F.col("one.mark").alias("mark"), (F.col("one.lo") + F.col("a")).alias("a"), (F.col("one.lo") + F.col("b")).alias("b"))
    rest = base.attach(met, spans.where("times > 1"), ["h", "d"], "times").where("times > 1").select("doc_id", "mark", (F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b")).alias("b"))
    return single.unionByName(rest)


def remove(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes).

    Strings are judged on the input, in UTF-8, never across texts; a null counts as empty, and a text under SPAN bytes
    keeps all. Rows that repeat a doc_id and text repeat each other. An empty table gives an empty result.
    """
    runs = repeated_runs(docs).distinct().groupBy(F.col("doc_id").alias("k_id"), F.col("mark").alias("k_mark")).agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    runs = base.save(runs, "runs")
    met = docs["doc_id"].eqNullSafe(F.col("k_id")) & (base.by_id() == F.col("k_mark"))
    rows = docs.select("doc_id", base.by_id().alias("mark"), "text").join(runs, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("mark") == F.col("k_mark")), "left")
    return rows.select("doc_id", "mark", "text", "runs").mapInArrow(base.tidied(_removed), f"doc_id {base.id_type(docs)}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(base.table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
ORACLE: dict[str, str] = {}
