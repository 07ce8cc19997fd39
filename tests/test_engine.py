"""The engine's own operators against plain Python on generated inputs, and on small fixtures."""

import calendar
import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import expressions as E
from palimpsest.operators import documents as D
from palimpsest.operators import history as H
from palimpsest.operators import lineage as L
from palimpsest.operators import projections as P
from palimpsest.sources import readers as S

day = dt.date.fromisoformat


def _days(kind, y, m, d):
    """A period with its bounds by the calendar alone."""
    last = lambda y, m: calendar.monthrange(y, m)[1]
    return {
        "year": (f"{y:04d}", dt.date(y, 1, 1), dt.date(y, 12, 31)),
        "decade": (f"{y // 10:03d}X", dt.date(y // 10 * 10, 1, 1), dt.date(y // 10 * 10 + 9, 12, 31)),
        "month": (f"{y:04d}-{m:02d}", dt.date(y, m, 1), dt.date(y, m, last(y, m))),
        "day": (f"{y:04d}-{m:02d}-{min(d, last(y, m)):02d}", *[dt.date(y, m, min(d, last(y, m)))] * 2),
    }[kind]


def test_edtf_bounds(spark):
    r, cases = random.Random(7), {}
    for _ in range(400):
        kind = r.choice(["year", "decade", "month", "day"])
        y, m, d = r.randint(1000, 2099), r.randint(1, 12), r.randint(1, 31)
        said, lo, hi = _days(kind, y, m, d)
        other, lo2, hi2 = _days(r.choice(["year", "month", "day"]), y + r.randint(-2, 2), r.randint(1, 12), r.randint(1, 31))
        cases[said + (r.choice(["", "?", "~"]) if kind == "year" else "")] = (lo, hi)
        cases |= {f"../{said}": (None, hi), f"{said}/..": (lo, None), f"{said}/{other}": (lo, hi2) if lo <= hi2 else (None, None)}
        wrong = [f"{y}-{r.randint(13, 99)}", f"{y}-{m:02d}-{calendar.monthrange(y, m)[1] + 1}", f"{said} {said}", said[:-1] + "?" * 2, f"{said}/{said}/{said}", f"{y}-{m:02d}-{d:02d}T12:00", "".join(r.choice("xyz/") for _ in range(5))]
        cases |= dict.fromkeys(wrong, (None, None))
    low, high = E.edtf_bounds(F.col("e"))
    got = {x.e: (x.lo, x.hi) for x in spark.createDataFrame([(k,) for k in cases], "e string").select("e", low.alias("lo"), high.alias("hi")).collect()}
    assert {k: (v, cases[k]) for k, v in got.items() if v != cases[k]} == {}


def test_edtf_of(spark):
    """The shortest form of whole days, months, years and decades, of other periods both ends; it reads back as the period."""
    r, rows = random.Random(8), [(None, None, None)]
    for _ in range(200):
        said, lo, hi = _days(r.choice(["year", "decade", "month", "day"]), r.randint(1000, 2090), r.randint(1, 12), r.randint(1, 31))
        rows += [(lo, hi, said), (lo, None, f"{lo}/.."), (None, hi, f"../{hi}"), (lo + dt.timedelta(1), hi + dt.timedelta(400), f"{lo + dt.timedelta(1)}/{hi + dt.timedelta(400)}")]
    df = spark.createDataFrame(rows, "lo date, hi date, e string").withColumn("got", E.edtf_of(F.col("lo"), F.col("hi")))
    back = E.edtf_bounds(F.col("got"))
    found = df.select("*", back[0].alias("b_lo"), back[1].alias("b_hi")).collect()
    assert [(x.e, x.got) for x in found if x.got != x.e] == [] and all((x.b_lo, x.b_hi) == (x.lo, x.hi) for x in found)


def test_sketch_laws(spark):
    vals = [0.1, 0.55, 1.0, 0.0, 0.89, 0.9, 0.95, None]
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(vals)], "g int, c double")
    whole = df.agg(E.conf_stats(F.col("c")).alias("s")).first().s
    parts = df.groupBy("g").agg(E.conf_stats(F.col("c")).alias("s")).agg(E.conf_merge(F.col("s")).alias("s")).first().s
    assert (whole.n, whole.min, whole.max, whole.hist) == (parts.n, parts.min, parts.max, parts.hist) and abs(whole.sum - parts.sum) < 1e-9
    assert whole.hist == [1, 1, 0, 0, 0, 1, 0, 0, 1, 3]
    assert df.where("c IS NULL").agg(E.conf_stats(F.col("c")).alias("s")).first().s is None


def test_ring(spark):
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.5, 0.5), (0.7, 0.7), (0.5, 0.9), (0.3, 0.7))))
    r = spark.range(1).select(E.ring_area(ring).alias("a"), E.point_in_ring(ring, F.lit(0.5), F.lit(0.7)).alias("i"), E.point_in_ring(ring, F.lit(0.33), F.lit(0.53)).alias("o"), E.ring_box(ring).alias("b")).first()
    assert abs(r.a - 0.08) < 1e-12 and r.i and not r.o and tuple(r.b) == (0.3, 0.5, 0.7, 0.9)


def test_text(spark):
    r = random.Random(12)
    spaces = lambda: "".join(r.choice(" \t") for _ in range(r.randint(0, 2)))
    rows = []
    for k in range(150):
        blocks = [[f"w{r.randrange(99)}" for _ in range(r.randint(1, 3))] for _ in range(r.randint(0, 4))]
        end = r.choice(["\n", "\r\n", "\r"])
        text = (end * 2).join(end.join(spaces() + x + spaces() for x in b) for b in blocks) + end * r.randint(0, 4)
        cells = [",".join(str(r.randrange(9)) for _ in range(2)) for _ in range(r.randint(0, 5))]
        table = "\n".join(cells) + "\n" * (bool(cells) and r.random() < 0.5)
        lo, hi, one, total = (r.randint(1, 12) for _ in range(4))
        tags = [r.choice(["Kiln", "kiln", "Ash", "ash ", " oak", "", "ELM"]) for _ in range(r.randint(0, 5))]
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 5))) for _ in range(2))
        rows.append((k, text, ["\n".join(b) for b in blocks], table, r.random() < 0.5, cells, f"{lo}-{hi},{one}", total, sorted({n for n in [*range(lo, hi + 1), one] if n <= total}), ",".join(tags), tags, r.randrange(1 << r.randint(1, 45)), a, b))
    names = "k int, text string, blocks array<string>, table string, header boolean, cells array<string>, pages string, total int, wanted array<int>, tags string, listed array<string>, size long, a string, b string"
    df = spark.createDataFrame(rows, names).select("*", E.paragraphs(F.col("text")).alias("x_blocks"), E.row_count(F.col("table"), F.col("header")).alias("x_rows"), E.page_range(F.col("pages"), F.col("total")).alias("x_pages"), E.csv_tags(F.col("tags")).alias("x_tags"), E.human_size(F.col("size")).alias("x_size"), E.ratio(F.col("a"), F.col("b")).alias("x_ratio"))
    for x in df.collect():
        first = {}
        for tag in (t.strip() for t in x.listed):
            first.setdefault(tag.lower(), tag) if tag else None
        step = next(n for n in range(4, -1, -1) if x.size >= 1024**n or n == 0)
        assert x.x_blocks == x.blocks and x.x_pages == x.wanted and x.x_rows == max(0, len(x.cells) - x.header)
        assert x.x_tags == ", ".join(first[t] for t in sorted(first)) and x.x_size == (f"{x.size} B" if step == 0 else f"{x.size / 1024**step:.1f} {['KB', 'MB', 'GB', 'TB'][step - 1]}")
        assert x.x_ratio == pytest.approx(2 * (Counter(x.a) & Counter(x.b)).total() / len(x.a + x.b) if x.a + x.b else 1.0)
    paths = [".".join(str(r.randrange(12)) for _ in range(r.randint(1, 4))) for _ in range(40)]
    pairs = spark.createDataFrame([(p, q) for p in paths for q in paths], "p string, q string").select("*", E.in_subtree(F.col("p"), F.col("q")).alias("inside"), E.ancestors(F.col("p")).alias("up"))
    for x in pairs.collect():
        parts, top = x.p.split("."), x.q.split(".")
        assert x.inside == (parts[: len(top)] == top) and x.up == [".".join(parts[: i + 1]) for i in range(len(parts))]


def test_diff_and_runs(spark):
    rows = [("a", 1, "first", "", 0, None, 1), ("a", 2, "second", "rows of the spring count", 0, "api", 2)]
    log = spark.createDataFrame(rows, "obj_id string, version int, name string, description string, row_count int, context_id string, event_id int")
    got = {r.version: [tuple(c) for c in r.changes] for r in H.diff(log, ["name", "description", "row_count"]).collect()}
    assert got == {1: [("name", None, "first")], 2: [("description", "", "rows of the spring count"), ("name", "first", "second")]}
    runs = H.runs(log.withColumn("at", F.col("version")).unionByName(log.limit(1).withColumns({"event_id": F.lit(9), "at": F.lit(1)})))
    assert {r.run for r in runs.collect()} == {"orphan:1", "orphan:9", "api"}


def test_first_version_by_type(spark):
    rows = [("a", 1, "0", 0, False, {"b": 1, "a": 2}), ("a", 2, "false", 1, True, {"a": 2, "b": 1})]
    log = spark.createDataFrame(rows, "obj_id string, version int, s string, n int, f boolean, m map<string,int>")
    got = {r.version: [tuple(c) for c in r.changes] for r in H.diff(log, ["s", "n", "f", "m"]).collect()}
    assert got == {1: [("m", None, '{"a":2,"b":1}'), ("s", None, "0")], 2: [("f", "false", "true"), ("n", "0", "1"), ("s", "0", "false")]}


def test_delete_restore_chain(spark):
    log = spark.createDataFrame([("x", 1, "one", False, 1), ("x", 2, "two", False, 2)], "obj_id string, seq int, name string, deleted boolean, version int")
    log = H.soft_delete(log, F.lit(True))
    assert H.soft_delete(log, F.lit(True)).count() == 3
    log = H.restore(log, 1)
    assert [(r.version, r.deleted, r.name) for r in log.orderBy("version").collect()] == [(1, False, "one"), (2, False, "two"), (3, True, "two"), (4, False, "one")]


def test_scope_fails_closed(spark):
    df = spark.createDataFrame([("t", False)], "owner_id string, deleted boolean")
    with pytest.raises(PermissionError):
        H.Scope(None)
    assert H.Scope("").all(df).count() == 0 and H.Scope("t").alive(df).count() == 1 and H.Scope(None, admin=True).all(df).count() == 1


def test_graph(spark):
    """Random graphs: nodes within some steps of a root, each with the generation by which a breadth-first walk first meets it, sources' edges first."""
    r = random.Random(21)
    for depth in (1, 3):
        pairs = sorted({(f"n{r.randrange(14)}", f"n{r.randrange(14)}") for _ in range(16)})
        e = spark.createDataFrame([(a, b, i, i, 1) for i, (a, b) in enumerate(pairs)], "source_id string, target_id string, created int, edge_id int, source_version int")
        want, frontier = {"n0": 0}, {"n0": 0}
        for _ in range(depth):
            found = {}
            for i, (a, b) in enumerate(pairs):
                for side, here, there, way in ((0, a, b, 1), (1, b, a, -1)):
                    if here in frontier and there not in want:
                        found.setdefault(there, []).append((side, -i, frontier[here] + way))
            frontier = {n: min(v)[2] for n, v in found.items()}
            want |= frontier
        assert {x.node: x.generation for x in L.graph(e, "n0", depth).collect()} == want
    assert [x.node for x in L.graph(e, "alone", 3).collect()] == ["alone"]


def test_graph_is_whole(spark):
    """A walk goes on past many nodes, unless it is asked to stop there."""
    rows = [("n0", f"a{k}", 0, k, 1) for k in range(L.MAX_NODES + 50)] + [("a0", "far", 0, 0, 1), ("up", "a1", 0, 0, 1)]
    e = spark.createDataFrame(rows, "source_id string, target_id string, created int, edge_id int, source_version int")
    first = {"n0": 0} | {f"a{k}": 1 for k in range(L.MAX_NODES + 50)}
    assert {x.node: x.generation for x in L.graph(e, "n0", 2).collect()} == first | {"far": 2, "up": 0}
    assert {x.node: x.generation for x in L.graph(e, "n0", 2, L.MAX_NODES).collect()} == first


def test_interpolation(spark):
    dated = {3: "1943-05-12", 8: "1943-05-20"}
    pages = spark.createDataFrame([(1, n, dated.get(n) and day(dated[n]), dated.get(n) and day(dated[n])) for n in range(1, 10)], "content_id int, number int, lo date, hi date")
    got = {r.number: (r.est_lo and str(r.est_lo), r.est_hi and str(r.est_hi), r.conf) for r in D.interpolate(pages).collect()}
    a, b = dated[3], dated[8]
    assert got == {1: (None, a, 0.4), 2: (None, a, 0.5), 3: (a, a, None), 4: (a, b, 0.7), 5: (a, b, 0.6), 6: (a, b, 0.6), 7: (a, b, 0.7), 8: (b, b, None), 9: (b, None, 0.5)}
    wrong = pages.withColumns({"lo": F.when(F.col("number") == 3, F.lit("1950-01-01").cast("date")).otherwise(F.col("lo")), "hi": F.when(F.col("number") == 3, F.lit("1950-01-01").cast("date")).otherwise(F.col("hi"))})
    assert D.interpolate(wrong).where("conf IS NOT NULL").count() == 0


def test_prior_narrows_open_estimates_alone(spark):
    rows = [(c, n, d, d) for c in (1, 2, 3) for n, d in ((1, None), (2, "1944-05-01"), (3, None), (4, "1944-07-01"), (5, None))]
    pages = spark.createDataFrame(rows, "content_id int, number int, lo string, hi string").selectExpr("content_id", "number", "date(lo) lo", "date(hi) hi")
    priors = spark.createDataFrame([(1, "1944-01-01", "1944-12-31"), (2, "1944-06-01", None)], "content_id int, prior_lo string, prior_hi string")
    got = {(r.content_id, r.number): (r.est_lo and str(r.est_lo), r.est_hi and str(r.est_hi)) for r in D.interpolate(pages, priors.selectExpr("content_id", "date(prior_lo) prior_lo", "date(prior_hi) prior_hi")).collect()}
    assert got[1, 1] == ("1944-01-01", "1944-05-01") and got[1, 5] == ("1944-07-01", "1944-12-31") and got[1, 3] == ("1944-05-01", "1944-07-01")
    assert got[2, 1] == (None, "1944-05-01") and got[2, 5] == ("1944-07-01", None)  # the prior starts after the first anchor
    assert got[3, 1] == (None, "1944-05-01") and got[3, 5] == ("1944-07-01", None)


def test_rebuild_is_idempotent(spark):
    have = spark.createDataFrame([(1, "a", False), (2, "b", False), (3, "c", True)], "id int, p string, retired boolean")
    want = spark.createDataFrame([(1, "a"), (3, "c"), (4, "d")], "id int, p string")
    assert {(r.id, r.op) for r in P.rebuild(have, want, ["id"], "p").collect()} == {(1, "keep"), (2, "retire"), (3, "revive"), (4, "insert")}


def test_scrub_refuses_unknown(spark):
    with pytest.raises(ValueError, match="secret"):
        P.scrub(spark.createDataFrame([(1, "x")], "id int, secret string"), {}, {"id"})


def test_sources(spark):
    r = random.Random(30)
    for _ in range(50):
        text = "".join(r.choice("aé€ß ") for _ in range(r.randint(0, 8)))
        assert S.decode(text.encode()) == text == S.decode(text.encode("utf-8-sig"))
    odd = bytes([0x41, 0xE9, 0xFF])
    assert S.decode(odd) == "".join(map(chr, odd))
    lines, want = [], {}
    for page in (1, 2):
        for par in (1, 2, 3):
            said = []
            for word in range(1, r.randint(2, 6)):
                box = (r.randrange(50), r.randrange(50), r.randint(1, 40), r.randint(1, 40))
                said.append((f"w{r.randrange(99)}", box, r.randint(0, 100)))
                lines.append("\t".join(map(str, (5, page, 1, par, 1, word, *box, said[-1][2], said[-1][0]))))
            want[page, par] = (" ".join(w for w, *_ in said), min(b[0] for _, b, _ in said) / 200, min(b[1] for _, b, _ in said) / 100, max(b[0] + b[2] for _, b, _ in said) / 200, max(b[1] + b[3] for _, b, _ in said) / 100, sum(c for *_, c in said) / 100 / len(said))
            lines += ["\t".join(map(str, (4, page, 1, par, 1, 0, 0, 0, 9, 9, -1, "line"))), "\t".join(map(str, (5, page, 1, par, 1, 9, 0, 0, 9, 9, 50, " "))), f"5\t{page}", "\t".join(map(str, (5, page, 1, par, 1, 9, "x", 0, 9, 9, 50, "word")))]
    r.shuffle(lines)
    got = {(x.page, x.par): (x.text, x.x0, x.y0, x.x1, x.y1, x.conf) for x in S.ocr_paragraphs(S.ocr_words(spark.createDataFrame([(x,) for x in lines], "value string")), 200, 100).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == v[0] and got[k][1:] == pytest.approx(v[1:]) for k, v in want.items())


def test_fuzzy_scores(spark):
    """Each character at its first place after the one before, scored place by place."""
    r = random.Random(31)
    texts = ["".join(r.choice("abAB_-. (") for _ in range(r.randint(0, 12))) for _ in range(120)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for term in ("a", "ab", "ba", "aab", "b_a", ""):
        for x in df.select("t", S.fuzzy_score(term, F.col("t")).alias("s")).collect():
            low, places = (x.t or "").lower(), []
            for c in term:
                ahead = [i for i, y in enumerate(low) if y == c and i > (places[-1] if places else -1)]
                places.append(ahead[0] if ahead else len(low))
            if len(low) in places:
                assert x.s is None
                continue
            gaps = [b - a - 1 for a, b in zip([-1, *places], places, strict=False)]
            score = sum(8 for g in gaps[1:] if g == 0) + sum(4 for p in places if p == 0 or low[p - 1] in "_-. ") - sum(gaps)
            assert x.s == score + ((40 if low.startswith(term) else 20 if term in low else 0) if term else 0)


def test_streamed_capture_counts_versions(spark, tmp_path):
    from palimpsest.streaming.capture import capture

    schema = "obj_id string, seq int, name string"
    for rows in ([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], [("a", 1, "w")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        capture(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.obj_id, r.version, r.name) for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert got == {("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("a", 3, "w")}


def test_capture_counts_on_over_compacted_tops_and_replays(spark, tmp_path, monkeypatch):
    from palimpsest.streaming import capture as c

    monkeypatch.setattr(c, "COMPACT", 2)
    log, schema = str(tmp_path / "log"), "obj_id string, seq int, name string"
    batches = [[("a", 4, "a1"), ("b", 9, "b1")], [("a", 1, "a2")], [("c", 1, "c1")], [], [("b", 2, "b3"), ("b", 1, "b2"), ("a", 1, "a3")], [("c", 7, "c2"), (None, 1, "n")]]
    for epoch, rows in enumerate(batches):
        for _ in range(1 + (epoch in (0, 2, 4))):  # replays of batches with all objects
            c.write_batch(spark.createDataFrame(rows, schema), epoch, log)
    got = {(r.name, r.version) for r in spark.read.parquet(log).collect()}
    assert got == {("a1", 1), ("a2", 2), ("a3", 3), ("b1", 1), ("b2", 2), ("b3", 3), ("c1", 1), ("c2", 2), ("n", 1)}
    tops = spark.read.parquet(log + "-tops")
    assert {(r.obj_id, r.top) for r in tops.where("batch = 4").collect()} == {("a", 3), ("b", 3), ("c", 1)} and tops.where("batch = 5").count() == 2


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
