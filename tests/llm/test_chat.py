"""Chat formatting against a plain walk in Python and against its SQL, on small and odd tables."""

import hashlib
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import chat

KIND = "conv_id long, turn long, role string, text string, segments string, state int"
BITS = [*chat.controls(chat.TEMPLATE), "\\", "\\\\", " ", "\n", "<", "[", "]", ">", "/", "word", "é", "😀", "s>", "INST]", "İ", "x" * 50]


def conversations(seed=3):
    r = random.Random(seed)
    text = lambda: "".join(r.choice(BITS) for _ in range(r.randint(0, 9)))
    rows = []
    for c in range(60):
        legal = (["system"] if r.random() < 0.3 else []) + ["user", "assistant"] * r.randint(0, 4) + ["user"] * r.randint(0, 1)
        roles = legal if c % 3 else [r.choice(["system", "user", "assistant", "tool", "start", "told", None, "", "User", "a] \\b [/NAME]x", *chat.OTHER]) for _ in range(r.randint(1, 6))]
        rows += [(c, k, role, text() if r.random() < 0.9 else None) for k, role in enumerate(roles)]
    rows += [(None, 0, "user", "no id"), (None, None, "assistant", "nor turn"), (200, 1, "user", "twice"), (200, 1, "user", "twice"), (200, 1, "assistant", "tie"), (201, 0, None, None), (202, 0, "assistant", "long " * 40_000)]
    r.shuffle(rows)
    return rows


def plain(rows):
    """What the digests must be, from the turns themselves."""
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, found in by.items():
        found.sort()
        state, fault = "start", None
        for n, (_, _, role, _) in enumerate(found, 1):
            to = chat.STEPS.get((state, role))
            if to is None:
                fault = n
                break
            state = to
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in found)
        learnt = "".join(text for _, _, role, text in found if role == "assistant")
        out[c] = (len(found), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), fault is None and state in chat.ENDS, fault)
    return out


@pytest.fixture(scope="module")
def convs(spark):
    return spark.createDataFrame([(*row, "clash", 1) for row in conversations()], KIND)


def test_digests(convs):
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.valid, r.fault) for r in chat.digests(convs).collect()}
    assert got == plain(conversations())


def test_turns_come_back_and_controls_stand_for_turns_alone(convs):
    made = chat.format(convs).select("conv_id", "segments", chat.text_of(F.col("segments")).alias("whole"))
    rows = made.select("*", chat.read(F.col("whole")).alias("back")).collect()
    want = {c: 0 for c in {r[0] for r in conversations()}}
    for c, *_ in conversations():
        want[c] += 1
    for r in rows:
        assert len(r.back) == want[r.conv_id] == len(r.segments) // 3
        for head, body, tail in zip(r.segments[::3], r.segments[1::3], r.segments[2::3], strict=True):
            assert not any(c in body.text for c in chat.controls(chat.TEMPLATE))
            assert not head.loss and not tail.loss and sum(c in head.text + tail.text for c in chat.controls(chat.TEMPLATE)) in (2, 3)
        assert r.whole == "".join(s.text for s in r.segments)


def test_another_template(spark):
    template = {"human": chat.Mark("<|h|>", "<|/h|>"), "bot": chat.Mark("<|b|>", "<|/b|>", loss=True)}
    df = spark.createDataFrame([(1, 0, "human", "<|b|>\\<|/h|>"), (1, 1, "bot", "yes<|/b|>"), (1, 2, "user", "[/TURN]")], "conv_id long, turn long, role string, text string")
    made = chat.format(df, template).select("segments", chat.text_of(F.col("segments")).alias("whole")).first()
    assert made.whole == "<|h|><\\|b|>\\\\<\\|/h|><|/h|><|b|>yes<\\|/b|><|/b|>[NAME]user[/NAME][\\/TURN][/TURN]"
    back = spark.createDataFrame([(made.whole,)], "whole string").select(chat.read(F.col("whole"), template).alias("t")).first().t
    assert [tuple(t) for t in back] == [("human", "<|b|>\\<|/h|>"), ("bot", "yes<|/b|>"), ("user", "[/TURN]")]


def test_empty(convs):
    assert chat.digests(convs.limit(0)).collect() == []


def test_query_and_sql(spark, tmp_path):
    rows = [r for r in conversations() if r[2] != "start"]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = chat.op11_chat_format(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(chat.ORACLE["op11_chat_format"]).df()[list(got.columns)]
    order = lambda df: df.astype({"fault": "Int32", "conv_id": "Int64"}).sort_values("conv_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)
    planted = got[got.conv_id == -1].iloc[0]
    assert (planted.n_turns, planted.loss_chars, planted.valid) == (2, len(chat.PLANTED), True)
