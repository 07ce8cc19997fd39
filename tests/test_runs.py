"""Runs, lines and blocks against the same rules in plain Python, page by page."""

import json
import random

import pytest

from palimpsest.operators import runs as X


def plain_lines(runs):
    lines = []
    for text, x, y, size, bold in runs:
        piece = text.strip()
        if not piece:
            continue
        if lines and abs(lines[-1]["y"] - y) <= 0.4 * max(size, 1.0):
            line = lines[-1]
            line["text"] += (" " if text.startswith(" ") or x > line["runs"][-1][1] + 0.5 else "") + piece
            line["x0"], line["size"], line["bold"] = min(line["x0"], x), max(line["size"], size), line["bold"] or bold
        else:
            line = {"text": piece, "x0": x, "y": y, "size": size, "bold": bold, "runs": []}
            lines.append(line)
        line["runs"].append((piece, x, y, size))
    return lines


def drawn(r):
    out, y = [], 780.0
    for _ in range(r.randint(1, 9)):
        y -= r.choice([12, 12, 12, 30, -40])
        size = r.choice([10.0, 10.0, 10.0, 13.0, 18.0, 0.5])
        for k in range(r.randint(1, 4)):
            out.append((r.choice(["word", " led", "up ", "- item", "3) three", "a-", "•", "x", "  ", "é 😀"]), 50.0 + r.choice([0, 0, 20 * k]), y + r.choice([0, 0, 2, 5]), size, r.random() < 0.2))
    return out


@pytest.fixture(scope="module")
def made(spark):
    r = random.Random(17)
    pages = {p: drawn(r) for p in range(60)}
    rows = [(p, k, *run) for p, v in pages.items() for k, run in enumerate(v)]
    r.shuffle(rows)
    return pages, X.lines(spark.createDataFrame(rows, "page int, seq int, text string, x double, y double, size double, bold boolean"))


def test_lines(made):
    pages, lines = made
    got = {}
    for x in lines.orderBy("page", "pos").collect():
        got.setdefault(x.page, []).append(x)
    for p, v in pages.items():
        want = plain_lines(v)
        assert [(x.text, x.x0, x.y, x.size, x.bold, [tuple(q) for q in x.runs]) for x in got.get(p, [])] == [(w["text"], w["x0"], w["y"], w["size"], w["bold"], w["runs"]) for w in want]
        assert all(x.x1 == pytest.approx(x.x0 + 0.5 * x.size * len(x.text)) for x in got.get(p, []))


def test_blocks_hold_their_lines_and_words_their_places(spark, made):
    pages, lines = made
    sizes = spark.createDataFrame([(p, 600.0 if p % 5 else 0.0, 800.0, 10.0) for p in pages], "page int, width double, height double, body double")
    found = X.blocks(lines, sizes).orderBy("page", "block").collect()
    by_page = {}
    for x in lines.orderBy("page", "pos").collect():
        by_page.setdefault(x.page, []).append(x)
    assert len(found) > 100 and {x.kind for x in found} == {"p", "li", "h2", "h3"}
    for x in found:
        cursor = 0
        for w in x.words:
            assert x.text[w.start : w.stop] == w.piece and w.start >= cursor
            cursor = w.stop
            assert (w.box is None) == (x.page % 5 == 0)
        if x.page % 5:
            assert 0 <= x.box.x0 <= x.box.x1 <= 1 and 0 <= x.box.y0 <= x.box.y1 <= 1
            assert all(x.box.y0 - 1e-9 <= w.box.y0 + 0.02 and w.box.x0 >= x.box.x0 - 1e-9 for w in x.words)
        else:
            assert x.box is None
    for p, mine in by_page.items():
        kept = [x.text for x in found if x.page == p]
        letters = lambda s: [c for c in s if c.isalpha()]
        assert letters("".join(kept)) == [c for c in letters("".join(m.text for m in mine))] or len(kept) < len(mine)


def test_stored_runs(spark):
    raw = json.dumps({"pages": [{"number": 1, "width": 10, "height": 20, "runs": [["a", 1, 2.5, 10], ["b", 2, 2, 9, "Serif-Bold"], ["c", 1, 2], ["d", "x", 1, 1]]}, {"number": 2, "failed": True, "runs": [["e", 1, 2, 3]]}, {"number": 3, "runs": None}]})
    got = X.stored_runs(spark.createDataFrame([(1, raw), (2, "not json"), (3, None), (4, "{}")], "content_id int, raw string")).collect()
    assert [(x.content_id, x.number, x.seq, x.text, x.x, x.y, x.size, x.bold) for x in got] == [(1, 1, 0, "a", 1.0, 2.5, 10.0, False), (1, 1, 1, "b", 2.0, 2.0, 9.0, True)]


def test_empty(spark):
    none = spark.createDataFrame([], "page int, seq int, text string, x double, y double, size double, bold boolean")
    assert X.lines(none).count() == 0 and X.blocks(X.lines(none), spark.createDataFrame([], "page int, width double, height double, body double")).count() == 0
