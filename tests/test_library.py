"""Cards, failed pages, imports and removals on cases a table of orders doesn't have."""

from palimpsest.operators import library as Y


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_failed_pages(spark):
    stats = [(1, None), (2, ""), (3, "{"), (4, "[1]"), (5, '{"failed_pages": 3}'), (6, '{"failed_pages": [3, "4", 3, null, "x", 99999999999]}'), (None, '{"failed_pages": [1]}'), (7, '{"failed_pages": []}')]
    contents = spark.createDataFrame(stats, "content_id int, stats string")
    assert rows(Y.failed_pages(contents)) == sorted([(6, 3), (6, 4), (None, 1)], key=repr)
    pages = spark.createDataFrame([(6, 3, "a"), (6, 3, "b"), (6, 5, "c"), (None, 1, "d")], "content_id int, number int, failed string").drop("failed")
    assert rows(Y.page_rows(pages, contents)) == sorted([(6, 3, True), (6, 3, True), (6, 5, False), (None, 1, False)], key=repr)
    assert rows(Y.page_rows(pages.limit(0), contents)) == []


def test_cards(spark):
    docs = spark.createDataFrame([(1, "A", "application/pdf", 5, None), (2, None, None, None, None), (3, "", "x/y/png", 0, None), (4, "D", "text/html", 1, None)], "doc_id int, title string, mime string, size long, created timestamp")
    pages = spark.createDataFrame([(3,), (4,), (4,), (None,), (9,)], "doc_id int")
    got = {x.doc_id: (x.title, x.description, x.page_count, x.shown) for x in Y.cards(docs, pages).collect()}
    assert got == {1: ("A", "PDF", None, True), 2: ("2", "", None, False), 3: ("3", "PNG, 1 page", 1, True), 4: ("D", "HTML, 2 pages", 2, True)}


def test_imports_pin_versions_and_refuse_whole(spark):
    docs = [
        (1, "sales.2020.csv", None, "h\n1\n2\n", None), (2, "notes", "text/csv", None, ""), (3, ".csv", "x", "", "mine"), (4, "a.csv\n", None, "h", None),
        (5, "b.pdf", "application/pdf", "h\n1", None), (6, "c.tsv", None, "h\n1", None), (7, "t" * 300 + ".csv", None, "h\n\n\n", None), (8, None, None, "x", None),
    ]
    versions = spark.createDataFrame([(i, i * 10) for i in (1, 2, 3, 4, 5, 7, 8)], "doc_id int, version int")
    made, edges, refused = Y.imported(spark.createDataFrame(docs, "doc_id int, title string, mime string, text string, name string"), versions)
    got = {x.doc_id: (x.name, x.row_count) for x in made.collect()}
    assert {k: v for k, v in got.items() if k != 4} == {1: ("sales.2020", 2), 2: ("notes", 0), 3: ("mine", 0), 7: ("t" * 200, 2)}
    assert {x.source_id: x.source_version for x in edges.collect()} == {k: 10 * k for k in got}
    assert {x.doc_id: x.problem for x in refused.collect() if x.doc_id != 4} == {5: "not delimited text", 6: "no version", 8: "not delimited text"}
    assert made.select("name").distinct().count() == len(got) and {x.description for x in made.where("doc_id = 2").collect()} == {"Imported from notes"}
    stem = spark.createDataFrame([("",), (".csv",), (None,), ("a.b.c",), ("plain",), ("x.\ny",)], "t string")
    assert [x[0] for x in stem.select(Y.data_set_name(stem["t"])).collect()] == [Y.UNNAMED, Y.UNNAMED, Y.UNNAMED, "a.b", "plain", "x"]


def test_removed_and_events_of(spark):
    import datetime as dt

    at = dt.datetime(2020, 1, 1)
    events = spark.createDataFrame([(1, 1, "a", at, False), (2, 1, "b", at, False), (3, 2, "a", at, True), (4, 3, "a", at, False), (5, None, "a", at, False), (6, 1, None, at, False)], "id int, source_id int, event_type string, created timestamp, retired boolean")
    asked = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, "a"), (None, None), (77, None)], "source_id int, event_type string")
    assert {x.id: (x.retired, x.changed) for x in Y.removed(events, asked).collect()} == {1: (True, True), 2: (False, False), 3: (True, False), 4: (False, False), 5: (False, False), 6: (False, False)}
    got = Y.events_of(events, spark.createDataFrame([(1,), (1,), (2,)], "source_id int"))
    assert [(x.id, x.place) for x in got.orderBy("place").collect()] == [(6, 1), (2, 2), (1, 3)]


def test_writes_belong_to_what_is_open(spark):
    """Against a stack in plain Python, on random well-nested runs, some of which name someone."""
    import random
    import uuid

    from palimpsest.operators import requests as Q

    r, marks, want, bad = random.Random(31), [], set(), set()
    for worker in range(12):
        stack, open_, n = [], [], 0
        for seq in range(80):
            kind = r.choice(["open", "close", "write", "write"])
            if kind == "close" and not open_:
                kind = "write"
            if kind == "open":
                run = f"r{n}"
                n += 1
                someone = r.random() < 0.3
                value = r.choice([str(uuid.UUID(int=r.getrandbits(128))), f"urn:uuid:{uuid.UUID(int=r.getrandbits(128))}", uuid.UUID(int=r.getrandbits(128)).hex.upper()]) if someone else r.choice(["nightly", "a" * 31, None, "g" * 32])
                marks.append((worker, seq, kind, run, {"step": "import", "note": value}))
                open_.append(run)
                if someone:
                    bad.add((worker, run))
                else:
                    stack.append(run)
            elif kind == "close":
                run = open_.pop()
                marks.append((worker, seq, kind, run, None))
                if (worker, run) not in bad:
                    stack.remove(run)
            else:
                marks.append((worker, seq, kind, None, None))
                want.add((worker, seq, stack[-1] if stack else None, len(stack)))
    df = spark.createDataFrame(marks, "worker int, seq int, kind string, run string, metadata map<string,string>")
    writes, refused = Q.attributed(df.repartition(7))
    assert rows(writes) == sorted(want, key=repr) and set(map(tuple, refused.collect())) == bad and bad
    assert rows(Q.attributed(df.limit(0))[0]) == []
