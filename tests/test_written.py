"""Documents as HTML and back, against trees whose form is known beforehand and plain Python."""

import html as H
import random
import re

from pyspark.sql import functions as F

from palimpsest.operators import snapshot, written
from palimpsest.sources import markup

WORDS = ["kiln", "a < b", "Öfen & co", "\"quoted\"", "tall", "ash", "rim's", "&amp;"]


def said(r):
    return " ".join(r.choice(WORDS) for _ in range(r.randint(1, 4)))


def page(r, depth=0):
    """(html, rows) of a page of own HTML; rows: (tag, text, rows, children)."""
    out, rows = [], []
    for _ in range(r.randint(1, 4)):
        kind = r.choice(["p", "h2", "pre", "li", "table", "figure", "section", "ul"] if depth < 3 else ["p", "pre"])
        text = said(r)
        if kind in ("section", "ul"):
            inner, low = page(r, depth + 1)
            out.append(f"<{kind}>{inner}</{kind}>")
            rows.append((kind, "", None, low))
        elif kind == "figure":
            out.append(f"<figure><figcaption>{H.escape(text)}</figcaption></figure>")
            rows.append(("figure", "", None, [("figcaption", text, None, [])]))
        elif kind == "table":
            cells = [[said(r) for _ in range(2)] for _ in range(r.randint(1, 3))]
            out.append("<table><tbody>" + "".join("<tr>" + "".join(f"<td>{H.escape(c)}</td>" for c in line) + "</tr>" for line in cells) + "</tbody></table>")
            rows.append(("table", "\n".join("\t".join(c) for c in cells), cells, []))
        elif kind == "pre":
            text = f"  {text}\n {said(r)}"
            out.append(f"<pre>{H.escape(text)}</pre>")
            rows.append(("pre", text, None, []))
        else:
            out.append(f"<{kind}>{H.escape(text[:3])}<b>{H.escape(text[3:])}</b></{kind}>")
            rows.append((kind, text.strip(), None, []))
    return "".join(out), rows


def flattened(rows, up=""):
    for k, (tag, text, cells, low) in enumerate(rows, 1):
        path = f"{up}{k:04d}"
        yield path, tag, text, cells
        yield from flattened(low, f"{path}.")


def test_own_html_reads_as_it_was_made(spark):
    r = random.Random(1)
    made = {i: page(r) for i in range(60)}
    read = markup.own_rows(spark.createDataFrame([(i, h) for i, (h, _) in made.items()] + [(100, None), (101, "")], "content_id int, html string"))
    for x in read.collect():
        rows = made[x.content_id][1] if x.content_id in made else []
        assert [(y.path, y.tag, y.text, y.rows) for y in x.rows] == list(flattened(rows)) and x.problems == []
    blocks = {}
    for b in written.blocks_of(read).orderBy("content_id", "pos").collect():
        blocks.setdefault(b.content_id, []).append(b.kind)
    assert blocks == {i: [tag for _, tag, *_ in flattened(rows) if tag not in ("section", "ul")] for i, (_, rows) in made.items() if any(tag not in ("section", "ul") for _, tag, *_ in flattened(rows))}


def test_faults_are_named(spark):
    cases = {
        "<p>a<div>b</div></p>": (["<div> is not part of the vocabulary"], [("p", "ab")]),
        "x<p>a</p>": (["text outside any tag: 'x'"], [("p", "a")]),
        "<section><p>a</section>": (["<p> was left open inside <section>"], [("section", ""), ("p", "a")]),
        "<ul><li>a": (["<li> was never closed", "<ul> was never closed"], [("ul", ""), ("li", "a")]),
        "<p>a<p>b</p></p>": ([], [("p", "a"), ("p", "b")]),
    }
    read = markup.own_rows(spark.createDataFrame(list(enumerate(cases)), "content_id int, html string"))
    got = {x.content_id: (x.problems, [(y.tag, y.text) for y in x.rows]) for x in read.collect()}
    assert got == dict(enumerate(cases.values()))
    bad = spark.createDataFrame([(1, '<p data-pages="1" data-box="1;0.5,0,0.4,1;0,1|x;;|2;;0,1">a</p><p>b</p>'), (2, ""), (3, '<p data-pages="3">c</p>')], "content_id int, html string")
    found = sorted((x.content_id, x.problem) for x in written.reviewed(markup.own_rows(bad)).collect())
    assert found == [(1, "<p> does not say which page it is on"), (1, "<p> has a box outside the page"), (2, "the document has no content")]


def test_web_pages_are_flattened_to_blocks(spark):
    cases = {
        "<ul><li><p>A</p><p>B</p></li><li>C<ul><li>D</ul></ul>": [("ul", ""), ("li", "A\nB"), ("li", "C\nD")],
        "<table><tr><th>x</th><th>y</th></tr><tr><td>1<br>2</td><td></td></tr></table>after": [("table", "x\ty\n1 2\t"), ("p", "after")],
        "<div>loose <i>text</i><div>more</div></div><section><p> </p></section>": [("p", "loose text"), ("p", "more")],
        "<h1>a<p>b<pre>\n c\n<b>d</b>\n</pre><blockquote>e</blockquote>": [("h1", "a"), ("p", "b"), ("pre", " c\nd"), ("blockquote", ""), ("p", "e")],
        "<script>1</script><svg><p>no</p></svg><main>yes": [("section", ""), ("p", "yes")],
    }
    got = markup.html_nodes(spark.createDataFrame(list(enumerate(cases)), "content_id int, html string")).collect()
    assert {x.content_id: [(n.tag, n.text) for n in x.nodes] for x in got} == dict(enumerate(cases.values()))
    table = next(n for x in got for n in x.nodes if n.tag == "table")
    assert table.rows == [["x", "y"], ["1 2", ""]] and table.header


def plain_html(items):
    """Items of one content in order: (kind, text, page) written out by hand, element by element."""
    groups, k = [], 0
    while k < len(items):
        pair = {items[k][0], items[k + 1][0]} if k + 1 < len(items) else set()
        if items[k][0] == "li":
            n = k
            while n < len(items) and items[n][0] == "li":
                n += 1
            groups.append(("list", items[k:n]))
            k = n
        elif pair == {"figure", "figcaption"}:
            groups.append(("figure", sorted(items[k : k + 2], key=lambda x: x[0] != "figure")))
            k += 2
        else:
            groups.append(("one", items[k : k + 1]))
            k += 1
    out, open_levels, n = [], [], 0
    tag = lambda kind, text, pg, nid, close=True: f'<{kind} data-nid="{nid}" data-pages="{pg}" data-box="{pg};;0,{len(text)}">{H.escape(text, quote=False)}' + (f"</{kind}>" if close else "")
    for shape, members in groups:
        kind = members[0][0]
        if re.fullmatch("h[1-6]", kind):
            while open_levels and open_levels[-1] >= int(kind[1]):
                out.append("</section>")
                open_levels.pop()
            n += 1
            out.append(f'<section data-nid="{n}">')
            open_levels.append(int(kind[1]))
        if shape == "list":
            n += 1
            out.append(f'<ul data-nid="{n}" data-pages="{",".join(map(str, sorted({p for *_, p in members})))}">')
        for i, (kind, text, pg) in enumerate(members):
            n += 1
            out.append(tag(kind, text, pg, n, not (shape == "figure" and i == 0)))
        out.append({"list": "</ul>", "figure": "</figure>"}.get(shape, ""))
    return "".join(out) + "</section>" * len(open_levels)


def documents(r, n=40):
    for c in range(n):
        yield c, [(k := r.choice(["p", "p", "h1", "h2", "h3", "h4", "li", "li", "figure", "figcaption", "pre"]), "" if k == "figure" else said(r), r.randint(1, 3)) for _ in range(r.randint(1, 14))]


def test_documents_are_written_as_by_hand_and_read_back(spark):
    docs = dict(documents(random.Random(5)))
    rows = [(c, i, kind, text, None, False, None, [(p, None, 0, len(text))]) for c, items in docs.items() for i, (kind, text, p) in enumerate(items)]
    items = spark.createDataFrame(rows, f"content_id int, item int, kind string, text string, rows array<array<string>>, header boolean, aside string, parts array<struct<page:int,box:{written.BOX},start:int,stop:int>>")
    html = written.serialised(items)
    assert {x.content_id: x.html for x in html.collect()} == {c: plain_html(v) for c, v in docs.items()}
    read = markup.own_rows(html)
    assert read.where("size(problems) > 0").count() == 0 and written.reviewed(read).count() == 0
    back = {}
    for x in written.extracted(read).orderBy("content_id", "pos").collect():
        if x.tag not in ("section", "ul"):
            back.setdefault(x.content_id, []).append((x.tag, x.text or "", x.regions[0].page))
    ordered = {}
    for c, v in docs.items():
        tags = re.findall(r'<(p|h\d|li|figure|figcaption|pre) data-nid="\d+" data-pages="(\d+)"[^>]*>([^<]*)', plain_html(v))
        ordered[c] = [(k, (lambda t: t if k == "pre" else markup.by_lines(t))(H.unescape(t)), int(p)) for k, p, t in tags]
    assert back == ordered


def test_assembled_pages(spark):
    rows = [(1, 1, 0, "h2", "Head", None, None, None), (1, 1, 1, "p", "It goes", None, None, None), (1, 2, 0, "p", "on here.", None, None, None), (1, 2, 1, "p", "7", "page-number", None, None), (1, 3, 0, "table", "a\tb", None, None, None), (1, 4, 0, "table", "c\td", None, None, True)]
    box = (0.1, 0.2, 0.3, 0.4)
    blocks = spark.createDataFrame([(*r, box) for r in rows], f"content_id int, page int, pos int, kind string, text string, furniture string, aside string, continues boolean, box {written.BOX}")
    pages = blocks.select("content_id", "page").distinct().selectExpr("*", "false AS failed")
    html = written.assembled(blocks, pages).first().html
    at = "0.1000,0.2000,0.3000,0.4000"
    assert html == (
        f'<section data-nid="1"><h2 data-nid="2" data-pages="1" data-box="1;{at};0,4">Head</h2><p data-nid="3" data-pages="1,2" data-box="1;{at};0,7|2;{at};8,16">It goes on here.</p>'
        f'<table data-nid="4" data-pages="3,4" data-box="3;{at};0,3|4;{at};4,7"><tbody><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></tbody></table></section>'
    )
    back = {x.pos: x for x in written.read_back(spark.createDataFrame([(1, html)], "content_id int, html string")).collect()}
    assert back[1].level == 2 and [(g.page, tuple(g.box), g.start, g.stop) for g in back[3].regions] == [(1, box, 0, 7), (2, box, 8, 16)] and back[4].rows == [["a", "b"], ["c", "d"]]
    assert written.assembled(blocks.limit(0), pages.limit(0)).count() == 0


def test_regions_are_moved_and_checked(spark):
    nodes = spark.createDataFrame([(1, 1, 10, 20)], "content_id int, nid int, text_start int, text_end int")
    pages = spark.createDataFrame([(1, 1)], "content_id int, page int")
    good, word = (0.0, 0.0, 1.0, 1.0), (0.1, 0.1, 0.2, 0.2, 2, 4, 0.5)
    rows = [
        (1, (-0.005, 0.0, 1.005, 1.0), None, 0, 10, [word], []), (2, good, None, None, None, None, ["page"]), (1, None, [(0.0, 0.0), (1.0, 1.0)], None, None, None, ["ring"]), (1, (-0.02, 0.0, 1.0, 1.0), None, 3, 2, None, ["coordinate", "span"]),
        (1, (0.9, 0.0, 0.1, 1.0), None, 0, 11, None, ["inverted", "span"]), (1, None, [(0.5, 0.5), (1.005, 0.5), (0.5, 0.9)], None, None, [(*word[:4], 5, 11, None)], ["word"]), (1, None, None, None, None, None, []),
    ]
    got = written.regions_placed(spark.createDataFrame([(1, 1, *r[:-1]) for r in rows], f"content_id int, nid int, page int, box {written.BOX}, ring array<struct<x:double,y:double>>, start int, stop int, words array<struct<x0:double,y0:double,x1:double,y1:double,start:int,stop:int,conf:double>>"), nodes, pages).collect()
    assert sorted(x.problems for x in got) == sorted(r[-1] for r in rows)
    fine = next(x for x in got if x.words and not x.problems)
    assert tuple(fine.box) == (0.0, 0.0, 1.0, 1.0) and (fine.start, fine.stop) == (10, 20) and tuple(fine.words[0])[4:] == (12, 14, 0.5)
    assert tuple(next(x for x in got if x.ring and len(x.ring) == 3).box) == (0.5, 0.5, 1.0, 0.9)


def test_nothing_else_survives_sanitising(spark):
    r = random.Random(9)
    bits = ["<p>", "</p>", "<P data-nid=\"1\" onclick=\"x\">", "<script>alert(1)</script>", "<style>p{}", "<td colspan=\"2\" style=\"a>b\">", "</td>", "<img src=x onerror='y'>", "a < b", "<", ">", "<!-- <p> -->", "text", "&lt;", "<section data-pages=\"1,2\" data-x=\"<p>\">", "<svg/onload=x>", "<a href=\"javascript:1\">", "</a>", "<p", "data-nid=\"2\"", "\"", "'"]
    cases = ["".join(r.choice(bits) for _ in range(r.randint(1, 9))) for _ in range(400)]
    got = spark.createDataFrame([(c,) for c in cases], "h string").select(written.sanitised(F.col("h")).alias("s")).collect()
    fits = rf"</(?:{'|'.join(snapshot.TAGS)})>|<(?:{'|'.join(snapshot.TAGS)})(?: (?:data-nid|data-pages|data-date|data-aside|colspan|rowspan)=\"[^\"]*\")*>"
    for x in got:
        assert not set("<>") & set(re.sub(r'"[^"]*"', '""', re.sub(fits, "", x.s))), x.s
        assert re.sub(r'<td[^>]*>', "", x.s).count("colspan") == 0
    one = lambda h: spark.createDataFrame([(h,)], "h string").select(written.sanitised(F.col("h")).alias("s")).first().s
    assert one('<p data-nid="3" class="x">a <b>c</b> &amp; 1 < 2</p><script>bad</script>') == '<p data-nid="3">a c &amp; 1 &lt; 2</p>'
