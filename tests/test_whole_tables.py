"""Queries over whole tables, against their DuckDB forms."""

import glob
import os
import random
import re
from collections import Counter

import duckdb
import pytest

from palimpsest.operators import documents as D
from palimpsest.operators import reads as R
from palimpsest.plans import registry

DATA = "/root/testdata/sf0.001"
no_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def same_rows(spark, name, data=DATA):
    con, sql = duckdb.connect(), registry.ORACLE[name]
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    df = registry.QUERIES[name](spark, data)
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    rows = want.fetchall()
    assert rows and sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == sorted(map(repr, rows))


@no_tables
@pytest.mark.parametrize("name", ["L1_pinned_edges", "L9_stale_derivations", "L7_derived_from"])
def test_every_order_is_an_edge(spark, name):
    same_rows(spark, name)


@no_tables
def test_every_part_is_a_region(spark):
    same_rows(spark, "J14_point_hit")


def test_hit_pairs_only_what_lies_near(spark):
    r = random.Random(3)
    boxes = [(k % 2, k, r.choice([(r.random(), r.random(), 10 ** r.uniform(-4, 0)), (r.uniform(-900, 900), r.uniform(-900, 900), 10 ** r.uniform(0, 3)), (0.5, 0.5, 0.0)])) for k in range(300)]
    points = [(k % 2, k, *r.choice([(r.random(), r.random()), (r.uniform(-900, 900), r.uniform(-900, 900)), (0.5, 0.5)])) for k in range(300)]
    ring = lambda x, y, s: [(x, y - s), (x + s, y), (x, y + s), (x - s, y)]
    regions = spark.createDataFrame([(p, k, ring(*b)) for p, k, b in boxes], "page long, nid long, ring array<struct<x: double, y: double>>")
    at = spark.createDataFrame(points, "page long, point long, x double, y double")
    want = {}
    for page, point, x, y in points:
        held = [(round(2 * s * s, 12), nid) for p, nid, (a, b, s) in boxes if p == page and abs(x - a) + abs(y - b) < s]
        if held:
            want[page, point] = min(held)[1]
    assert {(h.page, h.point): h.nid for h in D.hit(at, regions).collect()} == want and len(want) > 100
    small = spark.range(2000).selectExpr("0L AS page", "id AS nid", "array(named_struct('x', id + 0.1D, 'y', 0.1D), named_struct('x', id + 0.9D, 'y', 0.1D), named_struct('x', id + 0.5D, 'y', 0.9D)) AS ring")
    marks = spark.range(2000).selectExpr("0L AS page", "id AS point", "id + 0.5D AS x", "0.3D AS y")
    plan = D.hit(marks, small)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, .*cx#.*cy#", plan) and D.hit(marks, small).where("point = nid").count() == 2000


def test_equal_shapes_and_points_are_paired_once(spark):
    """3000 shapes of three kinds under 3000 points at two places; cells of shapes, which Spark takes for few, are never broadcast."""
    ring = "array(named_struct('x', 0.0D, 'y', -s), named_struct('x', s, 'y', 0.0D), named_struct('x', 0.0D, 'y', s), named_struct('x', -s, 'y', 0.0D))"
    shapes = spark.range(3000).selectExpr("id DIV 5000 AS page", "5000 - id AS nid", "1.0D + id % 3 AS s").selectExpr("page", "nid", f"{ring} AS ring")
    points = spark.range(3000).selectExpr("id DIV 5000 AS page", "id AS point", "IF(id % 2 = 0, 0.25D, 1.75D) AS x", "0.125D AS y")
    got = D.hit(points, shapes)
    assert {(r.point, r.nid) for r in got.collect()} == {(k, 2003 if k % 2 == 0 else 2002) for k in range(3000)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[page.*cx#", plan) and not re.search(r"Broadcast\w*Join.*cx#", plan)
    assert re.search(r"Aggregate \[page#\w+, ring#", got._jdf.queryExecution().optimizedPlan().toString())


def test_words_in_one_box_are_paired_once(spark):
    words = spark.range(3000).selectExpr("id DIV 5000 AS page", "id % 7 AS region", "IF(id % 3 = 0, 4.0D, 1.0D) AS area", "5000 - id AS seq", "0.0D AS x0", "0.0D AS y0", "1.0D + id % 3 AS x1", "1.0D AS y1")
    points = spark.range(3000).selectExpr("id DIV 5000 AS page", "id AS point", "0.5D + id % 4 AS x", "1.0D AS y")
    got = R.hit_word(points, words)
    held = lambda x: [((4.0 if k % 3 == 0 else 1.0), k % 7, 5000 - k) for k in range(3000) if x <= 1 + k % 3]
    want = {x: min(held(x))[1:] for x in (0.5, 1.5, 2.5)}
    assert {(r.point, r.region, r.seq) for r in got.collect()} == {(k, *want[0.5 + k % 4]) for k in range(3000) if k % 4 < 3}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[page.*cx#", plan) and not re.search(r"Broadcast\w*Join.*cx#", plan)


@no_tables
def test_every_order_is_ordered(spark):
    same_rows(spark, "O6_date_order_nulls_last")
    got = [(r.o_custkey, r.lo is None, r.lo, r.o_orderkey) for r in registry.QUERIES["O6_date_order_nulls_last"](spark, DATA).collect()]
    assert got == sorted(got, key=lambda r: (r[0], r[1], r[2] or 0, r[3]))


@no_tables
def test_offsets_go_to_the_end_of_each_content(spark):
    same_rows(spark, "J13_deepest_at_offset")


def test_long_names_are_compared_whole(spark, tmp_path):
    rows = [(1, "a long name of a part", "a brand with a long name"), (2, "same for twelve, then not", "same for twelve, so other"), (3, "ab", "b"), (4, "", "")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    want = {k: 2.0 * (Counter(a) & Counter(b)).total() / len(a + b) if a + b else 1.0 for k, a, b in rows}
    assert {r.p_partkey: r.ratio for r in registry.QUERIES["G13_quick_ratio"](spark, str(tmp_path)).collect()} == pytest.approx(want)


def test_titles_are_read_as_the_query_says(spark, tmp_path):
    titles = ["a &quot;b&quot; &amp", "&amp;lt;x&gt; &lt;y", " \t two\n lines ", "\xa0\u2003wide\u3000", "\x0bfeed\x0b", "", "end \u2028", "&nbsp;&#39;"]
    pages = [f"<html><title>{x}</title><p>text" for x in titles] + ["<TITLE>large</TITLE>", "<title>one</title><title>two</title>", "<title>a<b>c</b></title><title>d</title>", "no title", "", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    same_rows(spark, "S8_html_title", str(tmp_path))


def test_of_equal_runs_the_first_in_the_table_creates(spark, tmp_path):
    from palimpsest.plans import upkeep  # noqa: F401  adds to the registry

    r = random.Random(8)
    rows = [(r.randrange(30), r.randrange(100), r.randint(1, 7), r.choice("NAR"), r.choice("OF")) for _ in range(3000)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    same_rows(spark, "X40_extractors", str(tmp_path))
