"""Places of empty subtrees, dates as shown, the stored index, notifications and extractors: against plain Python on random input."""

import calendar
import math
import random
import re
from datetime import date, timedelta

from pyspark.sql import functions as F

from palimpsest.functions import layout as Y
from palimpsest.operators import index as I
from palimpsest.operators import projections as P
from palimpsest.operators import snapshot as Z
from palimpsest.operators import stored as K


def grown(rng, prefix="", depth=0):
    """Trees as (path, children, place or none)."""
    out = []
    for k in range(1, rng.randrange(2, 6)):
        path = f"{prefix}{k:04d}"
        below = grown(rng, path + ".", depth + 1) if depth < 4 and rng.random() < 0.5 else []
        out.append([path, below, None])
    return out


def leaves(tree):
    for node in tree:
        yield from leaves(node[1]) if node[1] else [node]


def settled(siblings, fallback, places):
    """Spans from below, then points from above."""

    def span(node):
        got = [s for s in map(span, node[1]) if s] if node[1] else [node[2]] if node[2] else []
        return (min(a for a, _ in got), max(b for _, b in got)) if got else None

    spans = [span(n) for n in siblings]
    for i, (path, below, _) in enumerate(siblings):
        at = spans[i]
        if at is None:
            later, earlier = next(filter(None, spans[i + 1 :]), None), next(filter(None, spans[:i][::-1]), None)
            point = later[0] if later else earlier[1] if earlier else fallback
            at = (point, point)
        places[path] = at
        settled(below, at[0], places)


def test_places(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for c in range(40):
        tree, at = grown(rng), 0
        for leaf in leaves(tree):
            if rng.random() < (0.0, 0.15, 0.6)[c % 3]:
                n = rng.randrange(0, 9)
                leaf[2], at = (at, at + n), at + n + 2
        flat = lambda t: [(n[0], *(n[2] or (None, None))) for n in t] + [r for n in t for r in flat(n[1])]  # noqa: B023, E731
        rows += [(c, *r) for r in flat(tree)]
        places = {}
        settled(tree, max(at - 2, 0), places)
        want |= {(c, p): v for p, v in places.items()}
    kind = "content_id int, path string, text_start long, text_end long"
    got = Z.places(spark.createDataFrame(rows, kind).repartition(3))
    assert {(r.content_id, r.path): (r.text_start, r.text_end) for r in got.collect()} == want
    assert Z.places(spark.createDataFrame([], kind)).count() == 0


def said(lo, hi):
    short = lambda d: f"{calendar.month_abbr[d.month]} {d.day}"
    if not lo or not hi:
        return f"on or {'after' if lo else 'before'} {short(lo or hi)}, {(lo or hi).year}" if lo or hi else "undated"
    whole = (lo.month, lo.day, hi.month, hi.day) == (1, 1, 12, 31)
    if lo == hi:
        return f"{short(lo)}, {lo.year}"
    if lo.day == 1 and (lo.year, lo.month) == (hi.year, hi.month) and (hi + timedelta(1)).day == 1:
        return f"{calendar.month_abbr[lo.month]} {lo.year}"
    if whole and lo.year == hi.year:
        return str(lo.year)
    if whole and lo.year % 10 == 0 and hi.year - lo.year == 9:
        return f"{lo.year}s"
    if lo.year == hi.year:
        return f"{short(lo)}–{hi.day}, {lo.year}" if lo.month == hi.month else f"{short(lo)} – {short(hi)}, {lo.year}"
    return f"{short(lo)}, {lo.year} – {short(hi)}, {hi.year}"


def test_shown_dates(spark):
    rng = random.Random(6)
    rows = [(None, None), (date(1950, 1, 1), date(1959, 12, 31)), (date(1951, 1, 1), date(1960, 12, 31)), (date(1950, 1, 1), date(1950, 12, 31)), (date(1952, 2, 1), date(1952, 2, 29)), (date(1951, 2, 1), date(1951, 2, 27))]
    for _ in range(400):
        lo = date(rng.randrange(900, 2100), rng.randrange(1, 13), rng.choice([1, 1, 17]))
        hi = lo + timedelta(rng.choice([0, 5, 27, 29, 30, 200, 364, 365, 3651, 3652]))
        rows.append(rng.choice([(lo, hi), (lo, hi), (lo, hi), (lo, None), (None, hi)]))
    rows = [(*r, rng.choice([None, rng.random(), k / 1000, 0.125, 0.375, 0.0, 1.0])) for k, r in enumerate(rows)]
    got = spark.createDataFrame(rows, "lo date, hi date, conf double").select("*", Y.estimate(F.col("lo"), F.col("hi"), F.lit("prior"), F.col("conf")).alias("shown")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.shown == f"{said(r.lo, r.hi)} (prior{'' if r.conf is None else f', {r.conf:.2f}'})"


def test_index(spark, tmp_path):
    rng = random.Random(7)
    vocabulary = ["the", "The", "other", "x1", "ä", "rare", "a-b"]
    texts = {k: rng.choice(["", " ", "\n"]).join(rng.choice(vocabulary) + " " for _ in range(rng.randrange(0, 40))) for k in range(80)} | {90: None, 91: "", 92: "other", 93: "rare the " * 5000, None: "the rare"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    asked = {1: ["the"], 2: ["the", "rare"], 3: ["ä", "b", "x1"], 4: ["nowhere"], 5: [], 6: ["a-b"]}
    queries = spark.createDataFrame(list(asked.items()), "query int, terms array<string>")
    index = I.write(I.postings(docs), f"{tmp_path}/index", 8, 2)
    want = set()
    for q, terms in asked.items():
        hits = []
        for k, text in texts.items():
            words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
            if k is not None and terms and all(t in words for t in terms):
                hits.append((round(sum(words.count(t) for t in terms) / (1 + math.log(len(text))), 9), k, min(text.lower().find(t) for t in terms)))
        want |= {(q, n, k, rank, at) for n, (rank, k, at) in enumerate(sorted(hits, key=lambda h: h[:2], reverse=True)[:5], 1)}
    got = I.shown(I.best(index, queries, 5), docs, queries).collect()
    assert {(r.query, r.place, r.doc_id, r.rank, r["at"]) for r in got} == want and len(got) == len(want)
    some = I.of_terms(index, ["rare", "the"], 8)
    assert sorted(map(tuple, some.select("term", "doc_id").collect())) == sorted(map(tuple, index.where("term IN ('rare', 'the')").select("term", "doc_id").collect()))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan[plan.index("PartitionFilters: [") :].split("]")[0] and "In(term" in plan.replace(" ", "")
    assert I.of_terms(index, [], 8).count() == 0


def test_marked_read(spark):
    rows = spark.createDataFrame([(1, 7, None), (2, 7, date(2020, 1, 1)), (3, 8, None), (4, None, None), (None, 7, None)], "id int, owner_id int, read_at date")
    asked = spark.createDataFrame([(7, 1), (7, 1), (7, 2), (7, 3), (None, 4), (7, None), (7, 99)], "owner_id int, id int")
    now = date(2024, 5, 5)
    got = {(r.id, r.owner_id): (r.read_at, r.marked) for r in P.marked_read(rows, asked, F.lit(now)).collect()}
    assert got == {(1, 7): (now, True), (2, 7): (date(2020, 1, 1), False), (3, 8): (None, False), (4, None): (None, False), (None, 7): (None, False)}
    assert P.marked_read(rows, asked.where("false"), F.lit(now)).where("marked").count() == 0


def test_extractors(spark):
    a, b = {"k": "1", "m": "2"}, {"k": "1"}
    asked = [(1, "x", "1", b), (2, "x", "1", a), (3, "y", "1", a), (4, "y", "1", {"m": "2", "k": "1"}), (5, "y", "1", b), (6, "y", "2", b), (7, None, "1", None), (8, None, "1", {}), (9, None, "1", None)]
    known = spark.createDataFrame([("x", "1", a), ("z", "1", a)], "name string, tool_version string, config map<string,string>")
    got = K.identified(spark.createDataFrame(asked, "seq int, name string, tool_version string, config map<string,string>").repartition(4), known)
    assert [r.op for r in got.orderBy("seq").collect()] == ["refuse", "use", "create", "use", "refuse", "create", "create", "refuse", "use"]
