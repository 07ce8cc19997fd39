"""Stored trees: against plain Python on small trees."""

import html
import random

from pyspark.sql import functions as F

from palimpsest.operators import snapshot as S


def plain(tree):
    """nid, [start, end) in text and HTML of a tree of (path, tag, text, children), walked from the top."""
    text, out, places = "", "", {}

    def walk(node):
        nonlocal text, out
        path, tag, own, children = node
        nid, at = len(places) + 1, len(out)
        places[nid] = None
        out += f'<{tag} data-nid="{nid}">'
        if children:
            spans = [walk(c) for c in children]
            span = (min(a for a, _ in spans), max(b for _, b in spans))
        else:
            text += "\n\n" if plain.leaves else ""
            plain.leaves += 1
            span = (len(text), len(text) + len(own or ""))
            text += own or ""
            out += ("\n" if tag == "pre" else "") + html.escape(own or "", quote=False)
        out += f"</{tag}>"
        places[nid] = (path, *span, at, len(out))
        return span

    plain.leaves = 0
    for n in tree:
        walk(n)
    return places, out


def grown(rng, prefix="", depth=0):
    out = []
    for k in range(1, rng.randrange(2, 5)):
        path = f"{prefix}{k:04d}"
        below = grown(rng, path + ".", depth + 1) if depth < 3 and rng.random() < 0.5 else []
        out.append((path, "section" if below else rng.choice(["p", "pre", "h2"]), None if below else rng.choice(["", None, "a < b & c", "\"quoted\" 'x'", "ä💡"]), below))
    return out


def flat(tree):
    return [row for p, tag, text, below in tree for row in [(p, tag, text), *flat(below)]]


def test_trees(spark):
    rng = random.Random(3)
    trees = {c: grown(rng) for c in range(8)}
    nodes = spark.createDataFrame([(c, *row) for c, tree in trees.items() for row in flat(tree)], "content_id int, path string, tag string, text string")
    plan = S.planned(nodes.repartition(3)).cache()
    pages = {r.content_id: r.html for r in S.rendered(plan).collect()}
    rows = {(r.content_id, r.nid): (r.path, r.text_start, r.text_end, r.html_start, r.html_end) for r in plan.join(S.located(plan), ["content_id", "nid"]).collect()}
    for c, tree in trees.items():
        places, out = plain(tree)
        assert pages[c] == out and {n: v for (k, n), v in rows.items() if k == c} == places
    stored = plan.join(S.located(plan), ["content_id", "nid"])
    assert S.enclosure_problems(stored, S.rendered(plan)).count() == 0 and S.plan_problems(plan).count() == 0
    assert S.rendered(S.planned(nodes.limit(0))).count() == 0


def test_attributes(spark):
    n = spark.createDataFrame([(1, "0001", "p", "x", "1,2", 'a"b', None)], "content_id int, path string, tag string, text string, pages string, aside string, date string")
    assert S.rendered(S.planned(n)).first().html == '<p data-nid="1" data-pages="1,2" data-aside="a&quot;b">x</p>'


def test_plan_problems(spark):
    n = spark.createDataFrame([(1, "0001", "div", "x"), (1, "0001.0001", "p", ""), (1, "10000", None, None), (2, ".".join(["0001"] * 52), "p", "")], "content_id int, path string, tag string, text string")
    assert sorted(map(tuple, S.plan_problems(S.planned(n)).collect())) == [(1, 1, "both"), (1, 1, "tag"), (1, 3, "siblings"), (1, 3, "tag"), (2, 1, "path")]


def plain_groups(kinds):
    out, i, n = [], 0, 0
    while i < len(kinds):
        n += 1
        k, nxt = kinds[i], kinds[i + 1] if i + 1 < len(kinds) else None
        if k == "li":
            while i < len(kinds) and kinds[i] == "li":
                out.append((n, "list"))
                i += 1
            continue
        if {k, nxt} == {"figure", "figcaption"}:
            out += [(n, "figure")] * 2
            i += 2
            continue
        out.append((n, "figure" if k == "figure" else "heading" if k == "h3" else "block"))
        i += 1
    return out


def test_groups(spark):
    rng = random.Random(4)
    runs = [[rng.choice(["li", "figure", "figcaption", "p", "h3"]) for _ in range(rng.randrange(1, 14))] for _ in range(120)] + [["figure", "figcaption"] * 4, ["figcaption", "figure"] * 3 + ["figcaption"]]
    items = spark.createDataFrame([(c, i, k) for c, r in enumerate(runs) for i, k in enumerate(r)], "content_id int, item int, kind string")
    got = {}
    for r in S.grouped(items).orderBy("content_id", "item").collect():
        got.setdefault(r.content_id, []).append((r.grp, r["shape"]))
    assert got == {c: plain_groups(r) for c, r in enumerate(runs)}


def test_tables(spark):
    rows = [([["a", "b"], ["1", "2"]], True, [["a", "b"], ["3", None]], False, "a\tb\n1\t2\n3\t"), ([["1", "2"]], False, [["1", "2"]], True, "1\t2\n1\t2"), ([["a"]], True, [], True, "a"), ([], True, [["x"]], None, "x")]
    df = spark.createDataFrame(rows, "a array<array<string>>, ha boolean, b array<array<string>>, hb boolean, want string")
    made = S.table_text(S.table_appended(S.table_of(F.col("a"), F.col("ha")), S.table_of(F.col("b"), F.col("hb"))))
    assert all(r.got == r.want for r in df.withColumn("got", made).collect())
