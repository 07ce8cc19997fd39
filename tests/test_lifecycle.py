"""Attempts from all events and from a stream, resuming, and the order of saving: against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import saving
from palimpsest.streaming import lifecycle as Y

T0 = dt.datetime(2024, 1, 1)


def history(seed):
    r, rows, seq = random.Random(seed), [], 0
    for c in range(12):
        at = T0 + dt.timedelta(minutes=r.randrange(30))
        for _ in range(r.randint(1, 14)):
            at += dt.timedelta(minutes=r.choice([0, 1, 5, 14, 15, 16, 40]))
            seq += 1
            rows.append((c, at, r.choice(["pending", "beat", "beat", "beat", "succeeded", "partial", "failed"]), seq))
    return sorted(rows, key=lambda x: (x[1], x[3]))


def plain(rows):
    out, open_, number = [], {}, {}
    for c, at, kind, _ in rows:
        if c in open_ and at - open_[c][1] > Y.STALE:
            out.append((c, number[c], *open_.pop(c)[:2], "stale"))
        if c not in open_:
            number[c] = number.get(c, 0) + 1
            open_[c] = [at, at, True]
        open_[c][1], open_[c][2] = at, open_[c][2] and kind == "pending"
        if kind in Y.ENDS:
            out.append((c, number[c], *open_.pop(c)[:2], kind))
    return out, {c: (number[c], *v) for c, v in open_.items()}


def test_attempts(spark):
    for seed in range(3):
        rows = history(seed)
        closed, open_ = plain(rows)
        df = spark.createDataFrame(rows, "content_id int, at timestamp, kind string, seq int")
        got = {tuple(x) for x in Y.attempts(df).collect()}
        assert got == set(closed) | {(c, n, a, b, "pending" if waiting else "running") for c, (n, a, b, waiting) in open_.items()}
        late = Y.attempts(df, F.lit(T0 + dt.timedelta(days=9)))
        assert {tuple(x) for x in late.collect()} == set(closed) | {(c, n, a, b, "stale") for c, (n, a, b, _) in open_.items()}
    assert Y.attempts(df.limit(0)).count() == 0


def test_a_stream_closes_the_same_attempts(spark, tmp_path):
    rows = history(5)
    end = (99, T0 + dt.timedelta(days=2), "beat", 10**6)  # moves the watermark past all timers
    schema = "content_id int, at timestamp, kind string, seq int"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    cuts = [0, len(rows) // 3, 2 * len(rows) // 3, len(rows)]
    batches = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] + [[end], [(98, end[1] + dt.timedelta(minutes=1), "beat", 10**6 + 1)]]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run = Y.tracked(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        run.awaitTermination()
    got = {tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    df = spark.createDataFrame(rows, schema)
    assert got == {tuple(x) for x in Y.attempts(df, F.lit(T0 + dt.timedelta(days=2))).collect()}


def test_attempts_together_are_one_clean_run(spark):
    r = random.Random(2)
    pages = [(c, p) for c in range(6) for p in range(r.randint(1, 8))]
    progress = [(c, a, p, r.choice([f'{{"n":{p * 10 + a}}}', '{"n":', "", None, '{"m":1}'])) for c, p in pages for a in (1, 2) if r.random() < 0.7]
    want = {}
    for c, a, p, raw in sorted(progress, key=lambda x: x[1]):
        if raw and raw.startswith('{"n":') and raw.endswith("}"):
            want.setdefault((c, p), p * 10 + a)
    done = Y.read_so_far(spark.createDataFrame(progress, "content_id int, attempt int, page int, raw string"), "n int")
    every = spark.createDataFrame(pages, "content_id int, page int")
    assert {(x.content_id, x.page): x.payload.n for x in done.collect()} == want
    assert {tuple(x) for x in Y.open_pages(every, done).collect()} == set(pages) - set(want)
    assert {(x.content_id, x.pages, x.read) for x in Y.counted(every, done).collect()} == {(c, sum(q == c for q, _ in pages), sum(q == c for q, _ in want)) for c, _ in pages}


def test_what_is_needed_is_saved_before(spark):
    r = random.Random(3)
    for _ in range(2):
        refs = [(b, a) for a in range(25) for b in range(a + 1, 25) if r.random() < 0.08] + [(3, 99), (None, 1), (1, None)]
        level = {}
        for n in range(25):
            level[n] = max((level[a] + 1 for b, a in refs if b == n and a is not None and a < n), default=0)
        nodes = spark.createDataFrame([(n,) for n in [*range(25), 4, None]], "node int")
        got = saving.save_levels(nodes, spark.createDataFrame(refs, "node int, needs int"))
        assert {x.node: x.level for x in got.collect()} == level
    with pytest.raises(ValueError, match="circle"):
        saving.save_levels(nodes, spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node int, needs int"))
    assert saving.save_levels(nodes.limit(0), spark.createDataFrame(refs, "node int, needs int")).count() == 0
