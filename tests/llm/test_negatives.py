"""Hard negatives against a plain search and against their SQL, on small and odd tables."""

import math
import random

import duckdb
import pandas as pd
import pytest

from palimpsest.llm import negatives

KIND = "vec_id long, embedding array<float>, label int, rid int, x string, i int, j int, head int, k int"
R = random.Random(8)


def vectors(n=420, dims=40):
    middle = [[R.gauss(0, 0.2) for _ in range(dims)] for _ in range(4)]
    rows = []
    for k in range(n):
        c = R.randrange(4)
        rows.append((k if k % 3 else k * 100 % 4000 // 100 * 100, [m + R.gauss(0, 0.15) for m in middle[c]], None if k == 17 else c + 3 * (k % 11 == 0) + 5 * (k % 50 == 3)))
    rows += [(5000, None, 1), (5001, [None] + [0.5] * (dims - 1), 1), (5002, [math.nan] * dims, 2), (5003, [math.inf] * dims, 2), (5100, [0.25] * dims, None)]
    rows += [(None, rows[5][1], 1), (None, rows[5][1], 2), (9000, rows[4][1], 2), (9001, rows[4][1], 2), (9002, rows[4][1], 3), (9100, [0.5] * 3, 2), (9200, [], 1), (9300, [-0.0] * dims, 9), (-700, rows[9][1], -5)]
    return rows


def plain(rows):
    """anchor, positive, rank, negative, scores, in order; None stands last among ids."""
    live = [(i, -1 if i is None else i, (lab + 1) % 10 if i is not None and i % 7 == 0 and lab + 1 >= 0 else -(-(lab + 1) % 10) if i is not None and i % 7 == 0 else lab, [math.floor(256 * c) for c in v]) for i, v, lab in rows if lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for at, (i, _, lab, x) in enumerate(live):
        if i is None or i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), j is None, jj, j, m) for k, (j, jj, m, y) in enumerate(live) if k != at)
        for ps, _, _, p, _ in [s for s in scored if s[4] == lab][:5]:
            inside = [s for s in scored if s[4] != lab and 30 * -ps <= 100 * -s[0] <= 90 * -ps][:10]
            out += [(i, p, rank, s[3], -ps, -s[0]) for rank, s in enumerate(inside, 1)]
    return sorted(out, key=str)


def narrow(rows):
    """Entries as the table holds them."""
    import numpy as np

    return [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], lab) for i, v, lab in rows]


def made(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5) for r in rows], KIND)


def mined(df):
    return sorted((tuple(r) for r in negatives.mine(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


@pytest.mark.parametrize("sizes", [(1024, 512, 32, 65536), (100, 9, 16, 20)])
def test_against_plain_search(spark, monkeypatch, sizes):
    for name, v in zip(("ROWS", "ANCHORS", "CHUNK", "PANEL"), sizes, strict=True):
        monkeypatch.setattr(negatives, name, v)
    rows = narrow(vectors())
    want = plain(rows)
    assert len(want) > 100 and mined(made(spark, rows)) == want


def test_ties_and_copies(spark):
    """One vector under all ids: equal scores, told apart by vec_id alone."""
    rows = [(k, [0.5, 0.5], k % 2) for k in range(300)] + [(1000 + k, [0.25, 0.25], k % 2) for k in range(30)]
    assert mined(made(spark, rows)) == plain(rows)


def test_products_are_exact():
    import numpy as np

    r = np.random.default_rng(1)
    for most in (1 << 10, 1 << 28, 1 << 30):
        a, b = r.integers(-most, most, (5, 7)), r.integers(-most, most, (6, 7))
        assert negatives.product(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]


@pytest.mark.parametrize("rows", [[], [(1, [0.5], 1)], [(100, None, 1)], [(100, [0.5], 1)], [(100, [0.5], 1), (101, [0.5], 1)], [(100, [0.5], 1), (1, [0.5], 2)]])
def test_little_to_mine(spark, rows):
    assert mined(made(spark, rows)) == []


def test_large_entries(spark):
    rows = [(k, [1e30, 3e38, -1e30], k % 3) for k in range(0, 300, 20)]
    assert negatives.mine(made(spark, rows)).count() >= 0


def test_query_and_sql(spark, tmp_path):
    rows = [r for r in vectors() if r[0] is not None]
    seen = set()
    rows = [r for r in rows if not (r[0] in seen or seen.add(r[0]))]  # the SQL takes vec_id to be unique
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = negatives.op13_hard_negatives(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(negatives.ORACLE["op13_hard_negatives"]).df()[list(got.columns)]
    keys = ["anchor_id", "positive_id", "rank"]
    pd.testing.assert_frame_equal(got.sort_values(keys).reset_index(drop=True), want.sort_values(keys).reset_index(drop=True), check_dtype=False)


def test_lists_grow_with_tasks_not_with_blocks(spark, monkeypatch):
    """However many blocks of rows a task has, it gives one list for each anchor and window."""
    monkeypatch.setattr(negatives, "ROWS", 20)
    given, ranked = [], negatives._ranked
    monkeypatch.setattr(negatives, "_ranked", lambda found, keys, most: given.append((found.count(), most)) or ranked(found, keys, most))
    rows = narrow([(k, [R.gauss(0.3, 0.1) for _ in range(4)], k % 3) for k in range(2000)])
    assert mined(made(spark, rows).coalesce(2)) == plain(rows)
    (near, five), (within, ten) = given
    assert near <= 2 * 20 * five and within <= 2 * 20 * five * ten


@pytest.mark.parametrize("crowd", [0, 2, 1 << 20])
def test_firsts_over_tiles(monkeypatch, crowd):
    """Lists carried on from tile to tile against one sort, with many equal scores, rows without id and windows that stay short."""
    import numpy as np

    monkeypatch.setattr(negatives, "CROWD", crowd)
    r = np.random.default_rng(crowd)
    for levels in (3, 40, 1 << 40):
        rows = np.stack([r.random(300) < 0.9, r.integers(-50, 50, 300), r.integers(0, 3, 300), np.arange(300)], 1).astype(np.int64)
        rows[rows[:, 0] == 0, 1] = 0
        bounds = np.sort(r.integers(-levels, levels + 1, (7, 5, 2)), axis=2)
        bounds[r.random((7, 5)) < 0.2] = 1, 0
        s = r.integers(-levels, levels + 1, (7, 300))
        for same in (True, False):
            found = negatives.Firsts(np.concatenate([rows[:7], bounds.reshape(7, 10)], 1), same, 4)
            for lo, hi in ((0, 1), (1, 120), (120, 240), (240, 300)):
                found.take(rows[lo:hi], s[:, lo:hi])
            want = []
            for a in range(7):
                for place in range(1 if same else 5):
                    lo, hi = (-(1 << 62), 1 << 62) if same else bounds[a, place]
                    fit = [(-s[a, c], rows[c, 0] == 0, rows[c, 1], c) for c in range(300) if lo <= s[a, c] <= hi and (rows[c, 2] == rows[a, 2] and c != a if same else rows[c, 2] != rows[a, 2])]
                    want += [(a, place, -v, none, i, c) for v, none, i, c in sorted(fit)[:4]]
            assert list(zip(*(x.tolist() for x in found.lists()), strict=True)) == want
