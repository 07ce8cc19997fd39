"""Datelines, pages put together, requests and tenants: against plain Python on small fixtures."""

import calendar
import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import layout
from palimpsest.operators import dating, pages, requests

LINES = ["12. Mai 1843", "Seedorf, den 3. Hornung 1843", "Seedorf, den 3. März 1843 und 4. April 1844", "30. Februar 1843", "on 1st of June 1901", "June 2, 1901", "5/6/1901", "1843-02", "1843-02-30", "1843-02-03-04", "im 1843", "1843", " 1843 x", "a line that goes on for long, until 1. Mai 1843",
         "31.31.1843 1.2.1843", "Dez. 1999 ", "Monat 1999, Mai 1999", "", "\n1. Mai 1843", "x" * 170 + " 1843", "0000-00-00", "14. Mai 18431", "MAI 1843\nmore", None]


def plain_dateline(text, heading):
    """The first date, form by form, by Python's own patterns and calendar."""
    if text is None:
        return None
    line = text.split("\n", 1)[0].strip()
    for form, (y, m, d), conf in dating.FORMS:
        for hit in re.finditer(form, line[: dating.WINDOW]):
            month = dating.MONTHS.get(hit[m].lower(), int(hit[m]) if hit[m].isdigit() else 0)
            try:
                lo = dt.date(int(hit[y]), month, int(hit[d]) if d else 1)
            except ValueError:
                continue
            if (hit.start() <= dating.LEAD or heading) and len(line) - len(hit[0]) <= dating.BESIDE:
                return lo, lo if d else lo.replace(day=calendar.monthrange(lo.year, lo.month)[1]), conf, hit[0]
    whole = re.match(r"(?i)^\s*(?:(?:im|in|anno)\s+)?(1[0-9]{3}|20[0-9]{2})\s*$", text)
    return (dt.date(int(whole[1]), 1, 1), dt.date(int(whole[1]), 12, 31), 0.7, whole[1]) if whole else None


def test_datelines(spark):
    rng, parts = random.Random(5), ["12", ".", " ", "Mai", "1843", "-", "02", "/", "of", "th", "Sept.", ", ", "am", "31", "\n"]
    texts = LINES + ["".join(rng.choice(parts) for _ in range(rng.randrange(3, 14))) for _ in range(400)]
    rows = [(i, t, h) for i, t in enumerate(texts) for h in (True, False, None)]
    made = dating.datelines(spark.createDataFrame(rows, "i int, text string, heading boolean")).collect()
    assert len(made) == len(rows)
    for r in made:
        assert (tuple(r.dateline) if r.dateline else None) == plain_dateline(r.text, r.heading), (r.text, r.heading)
    assert dating.datelines(spark.createDataFrame([], "text string, heading boolean, dateline string")).count() == 0


def test_violations(spark):
    day = lambda s: dt.date.fromisoformat(s) if s else None
    nodes = [("0001", "1900-01-01", "1900-12-31"), ("0001.0001", "1900-02-01", "1901-01-01"), ("0001.0002", None, "1900-02-01"), ("0001.0002.0001", "1950-01-01", None), ("0002", None, None), ("0003", "1800-01-01", "1800-01-01"), ("0001.0003.0001", "1850-01-01", "1850-01-01")]
    n = spark.createDataFrame([(1, p, day(a), day(b)) for p, a, b in nodes], "content_id int, path string, lo date, hi date")
    c = spark.createDataFrame([(1, day("1850-01-01"), None)], "content_id int, lo date, hi date")
    assert sorted((r.path, r.problem) for r in dating.violations(n, c).collect()) == [("0001.0001", "parent"), ("0003", "content")]


def test_fragments(spark):
    blocks = [(1, 1, 1, "p", "one hy-", None, None), (1, 2, 1, "p", "phen and", None, None), (1, 3, 1, "p", "so on-", None, None), (1, 3, 2, "p", "last", None, None), (1, 5, 1, "p", "after a failed page", None, None),
              (1, 7, 1, "p", "after an empty page", None, None), (2, 1, 1, "h1", "A", None, None), (2, 2, 1, "h1", "b", None, True), (3, 1, 1, "p", "Ends.", None, None), (3, 2, 1, "p", "But goes on", None, True), (3, 3, 1, "p", "not here", "note", None)]
    kept = spark.createDataFrame(blocks, "content_id int, page int, pos int, kind string, text string, aside string, continues boolean")
    read = spark.createDataFrame([(c, p, (c, p) == (1, 4)) for c, p in [(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (1, 7), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3)]], "content_id int, page int, failed boolean")
    parts = pages.fragments(kept, read)
    got = {(r.content_id, r["item"]): (r.text, r.n_fragments) for r in pages.items(parts).collect()}
    assert got == {(1, 1): ("one hyphen and so on-", 3), (1, 2): ("last after a failed page", 2), (1, 3): ("after an empty page", 1), (2, 1): ("A", 1), (2, 2): ("b", 1), (3, 1): ("Ends. But goes on", 2), (3, 2): ("not here", 1)}
    whole = {(r.content_id, r["item"]): r.text for r in pages.items(parts).collect()}
    for r in parts.collect():
        assert whole[r.content_id, r["item"]][r.start : r.stop] == (r.piece.rstrip(" "))
    assert pages.items(pages.fragments(kept.limit(0), read)).count() == 0


def test_read_pages(spark):
    blocks = [(1, 1, 1, "p", " 7 ", "page-number"), (1, 1, 2, "figure", None, None), (1, 1, 3, "p", " ", None), (1, 1, 4, "p", "*", None), (1, 2, 1, "p", "lost", None)]
    b = spark.createDataFrame(blocks, "content_id int, page int, pos int, kind string, text string, furniture string")
    p = spark.createDataFrame([(1, 1, None), (1, 2, True), (1, 3, False)], "content_id int, page int, failed boolean")
    seen = pages.judged(b, p)
    assert pages.report(seen, p).collect() == [(1, 3, 1, 1, 1, 1, 1, 1)] and pages.labels(seen).collect() == [(1, 1, "7")]


def test_payload_and_export(spark):
    a = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k int, nid int, t string")
    assert [r.payload for r in pages.payload(a, "k", "nid", ["t"]).collect()] == ['[{"nid":1,"t":"a"},{"nid":2,"t":"b"}]']
    t = spark.createDataFrame([(1, "x", None), (2, "y", "z")], "owner_id int, name string, note string")
    got = [json.loads(r["row"]) for r in requests.exported({"t": t}, 1, {"name": F.lit("n")}).collect()]
    assert got == [{"owner_id": 1, "name": "n", "note": None}]


def test_requests_and_tenants(spark):
    e = requests.union_events({"a": spark.createDataFrame([("r", 1)], "context_id string, x int"), "b": spark.createDataFrame([("r", "y"), (None, "z")], "context_id string, y string")})
    assert requests.writes(e, spark.createDataFrame([("r",), ("s",)], "context_id string")).collect() == [("r", 2, 2, 1)]
    names = [("a/b", True), ("a/..b", True), ("../a", False), ("a/..", False), ("/a", False), ("C:/a", False), ("a\\..\\b", False), ("", False), (None, False)]
    assert [r[0] for r in spark.createDataFrame(names, "n string, fine boolean").select(requests.unpackable(F.col("n"))).collect()] == [f for _, f in names]
    p = requests.Projections()
    p.add("a.b", lambda df: df, "x")
    for bad in ("a.b", "A.b", "ab"):
        with pytest.raises(ValueError):
            p.add(bad, lambda df: df)
    assert p.described() == {"a.b": "x"}
    tags = spark.createDataFrame([(["e\u0301 ", "É", " ", None, "x" * 120],), ([],), (None,)], "t array<string>")
    assert [r[0] for r in tags.select(requests.normalised_tags("t")).collect()] == [["é", "x" * 100], [], None]


def test_tables_go_on_where_they_are_merged(spark):
    """A continued table's rows follow on lines of their own, without a repeated header; fragments cut the item's text."""
    rows = [(1, 1, 0, "table", "a\tb\n1\t2", None, "a\tb", None), (1, 2, 0, "table", "a\tb\n3\t4\n5\t6", None, None, True), (1, 3, 0, "table", "a\tb", None, None, True), (1, 4, 0, "table", "7\t8", None, None, None), (1, 5, 0, "p", "a\tb", None, None, True)]
    kept = spark.createDataFrame(rows, "content_id int, page int, pos int, kind string, text string, aside string, header string, continues boolean")
    read = kept.select("content_id", "page").distinct().selectExpr("*", "false AS failed")
    parts = pages.fragments(kept, read)
    items = {r.item: (r.kind, r.text) for r in pages.items(parts).collect()}
    assert items == {1: ("table", "a\tb\n1\t2\n3\t4\n5\t6"), 2: ("table", "7\t8"), 3: ("p", "a\tb")}
    assert {r.page: items[r.item][1][r.start : r.stop] for r in parts.collect()} == {1: "a\tb\n1\t2", 2: "3\t4\n5\t6", 3: "", 4: "7\t8", 5: "a\tb"}
    assert pages.items(pages.fragments(kept, read, merge_tables=False)).count() == 5


def test_inherited_confidence_rounds_as_doubles_do(spark):
    rng = random.Random(4)
    values = [rng.random() for _ in range(10_000)] + [k / 1000 for k in range(1001)] + [0.951, 0.953, 0.9549]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", layout.inherited(F.col("v")).alias("x")).collect()
    assert all(r.x == round(r.v * 0.9, 2) for r in got)
