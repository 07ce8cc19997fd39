"""HTML as flat rows. A page's tags and texts come one after another; a small fold over them with a stack of what is open gives rows in
document order, each with its parent, so all that follows (blocks, reviews, trees) is joins and windows over rows.

``html_nodes`` reads pages as they are found on the web, ``own_rows`` the HTML that this library writes, and says what is wrong with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame

#: What each tag is to a tree.
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LEAF = HEADINGS | {"p", "pre", "figcaption", "li"}
CONTAINER = {"section": "section", "article": "section", "main": "section", "ul": "ul", "ol": "ol", "blockquote": "blockquote", "figure": "figure"}
SKIP = {"head", "script", "style", "template", "noscript", "svg", "title"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "wbr"}
#: Tags that part text but aren't nodes.
PARTS = {"table", "div", "tr", "dl", "dt", "dd", "address"}
BLOCK = LEAF | CONTAINER.keys() | PARTS
#: Leaves that the next block ends.
SHORT = HEADINGS | {"p"}

#: The library's own HTML.
OWN_BLOCK = {"section", *HEADINGS, "p", "li", "blockquote", "pre", "figure", "figcaption", "table"}
OWN_CONTAINER = {"section", "ul", "ol", "figure"}
INLINE = {"b", "strong", "i", "em", "u", "span", "a", "sup", "sub", "small", "br"}
ATTRIBUTES = {"nid": "data-nid", "pages": "data-pages", "box": "data-box", "continues": "data-continues", "furniture": "data-furniture", "aside": "data-aside"}
#: Characters of a text that is reported.
SHOWN = 40

NODE = "array<struct<nid:int,parent:int,path:string,tag:string,text:string,rows:array<array<string>>,header:boolean>>"
OWN = "array<struct<pos:int,parent:int,path:string,tag:string,text:string,rows:array<array<string>>,header:boolean,attrs:map<string,string>>>"


class _Tokens(HTMLParser):
    """What a page holds, in order: (open, tag, attributes), (close, tag, None) and (text, text, None)."""

    def __init__(self, html: str | None):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple] = []
        self.feed(html or "")
        self.close()

    def handle_starttag(self, tag, attrs):
        self.found.append(("open", tag, attrs))

    def handle_startendtag(self, tag, attrs):
        self.found.append(("open", tag, attrs))
        if tag not in VOID:
            self.found.append(("close", tag, None))

    def handle_endtag(self, tag):
        self.found.append(("close", tag, None))

    def handle_data(self, data):
        self.found.append(("text", data, None))


def flat(text: str) -> str:
    return " ".join(text.split())


def by_lines(text: str) -> str:
    return "\n".join(line for line in map(flat, text.split("\n")) if line)


class _Rows:
    """Rows under way, and the open ones: a stack of (tag, kind, row), kind being node, leaf, table or nothing."""

    def __init__(self):
        self.rows: list[dict] = []
        self.open: list[tuple[str, str | None, dict]] = []
        self.top = {"nid": 0, "kids": 0, "loose": []}

    def add(self, tag: str, kind: str, name: str | None = None, **more) -> dict:
        up = self.holder()
        up["kids"] += 1
        row = {"nid": len(self.rows) + 1, "parent": up["nid"], "tag": name or tag, "said": [], "loose": [], "kids": 0, "rows": None, "header": None, "at": up["kids"], "up": up, **more}
        self.rows.append(row)
        self.open.append((tag, kind, row))
        return row

    def holder(self) -> dict:
        return next((row for _, kind, row in reversed(self.open) if kind == "node"), self.top)

    def filled(self) -> tuple[str, str | None, dict] | None:
        """The leaf or table that text goes to, if there is one."""
        return next((o for o in reversed(self.open) if o[1]), None) if any(o[1] in ("leaf", "table") for o in self.open) else None


def _cells(row: dict, kind: str, tag: str) -> None:
    """Opens and closes rows and cells of a table: ``cell`` is the text of the open one, ``line`` the open row."""
    if kind == "open" and tag == "tr":
        row["line"] = []
    elif kind == "open" and tag in ("td", "th"):
        row["cell"] = []
        row["header"] = row["header"] or (tag == "th" and not row["rows"])
    elif kind == "close" and tag in ("td", "th") and row.get("cell") is not None:
        row["line"] = [*(row.get("line") or []), flat("".join(row["cell"]))]
        row["cell"] = None
    elif kind == "close" and tag == "tr" and row.get("line") is not None:
        row["rows"] += [row["line"]] if row["line"] else []
        row["line"] = None


def tree(html: str | None) -> tuple[str, list[dict]]:
    """Title and rows of a page. Blocks within a list item or preformatted text become its lines, a table's cells its rows; other tags are passed
    over, and text that is in no leaf becomes a paragraph."""
    made, skip, title, in_title = _Rows(), 0, [], False

    def settle(holder: dict) -> None:
        text, holder["loose"] = flat("".join(holder["loose"])), []
        if text:
            made.add("p", "leaf")["said"].append(text)
            made.open.pop()

    def end(tag: str, kind: str | None, row: dict) -> None:
        target = made.filled()
        if kind == "node":
            made.open.append((tag, kind, row))
            settle(row)
            made.open.pop()
        elif kind is None and target and target[1] == "table":
            _cells(target[2], "close", tag)
        elif kind is None and tag in BLOCK:
            target[2]["said"].append("\n") if target else settle(made.holder())

    def close(tag: str) -> None:
        if any(o[0] == tag for o in made.open):
            while True:
                last = made.open.pop()
                end(*last)
                if last[0] == tag:
                    return

    for kind, tag, _ in _Tokens(html).found:
        if kind == "text":
            if in_title:
                title.append(tag)
            if not skip:
                target = made.filled()
                if target is None:
                    made.holder()["loose"].append(tag)
                elif target[1] == "leaf":
                    target[2]["said"].append(tag)
                elif target[2].get("cell") is not None:
                    target[2]["cell"].append(tag)
        elif tag == "title" or skip or tag in SKIP:
            in_title = kind == "open" if tag == "title" else in_title
            skip = max(0, skip + (0 if tag in VOID else 1 if kind == "open" else -1))
        elif tag in VOID:
            if tag == "br" and kind == "open":
                target = made.filled()
                (made.holder()["loose"] if target is None else target[2]["said"] if target[1] == "leaf" else target[2].get("cell") or []).append("\n")
        elif kind == "close":
            close(tag)
        else:
            target = made.filled()
            if target and target[0] in SHORT and tag in BLOCK:
                close(target[0])
                target = made.filled()
            if target:
                if target[1] == "table":
                    _cells(target[2], "open", tag)
                elif tag in BLOCK:
                    target[2]["said"].append("\n")
                made.open.append((tag, None, target[2]))
            elif tag in LEAF or tag in CONTAINER or tag == "table":
                settle(made.holder())
                made.add(tag, "leaf" if tag in LEAF else "table" if tag == "table" else "node", CONTAINER.get(tag), **({"rows": [], "header": False} if tag == "table" else {}))
            else:
                if tag in BLOCK:
                    settle(made.holder())
                made.open.append((tag, None, made.holder()))
    while made.open:
        end(*made.open.pop())
    settle(made.top)
    return flat("".join(title)), _pruned(made.rows)


def _texts(rows: list[dict]) -> None:
    for r in rows:
        said = "".join(r["said"])
        r["text"] = "\n".join("\t".join(line) for line in r["rows"]) if r["rows"] is not None else said.strip("\n") if r["tag"] == "pre" else by_lines(said)


def _paths(rows: list[dict]) -> None:
    """Places among the siblings that are left, as paths."""
    path, kids = {0: ""}, {}
    for r in rows:
        kids[r["parent"]] = kids.get(r["parent"], 0) + 1
        path[r["nid"]] = r["path"] = f"{path[r['parent']]}{'.' if r['parent'] else ''}{kids[r['parent']]:04d}"


def _pruned(rows: list[dict]) -> list[dict]:
    """Without rows that hold no text below, in document order."""
    _texts(rows)
    full = set()
    for r in sorted(rows, key=lambda r: -r["nid"]):
        if r["nid"] in full or (r["rows"] if r["rows"] is not None else r["text"].strip()):
            full |= {r["nid"], r["parent"]}
    left = [r for r in rows if r["nid"] in full]
    _paths(left)
    return left


def own(html: str | None) -> tuple[list[dict], list[str]]:
    """Rows of the library's own HTML, and problems: tags that it doesn't have (their text stays), tags left open, text outside all tags.
    Inline tags are passed over; a leaf ends where the next block begins."""
    made, problems, table = _Rows(), [], 0

    def close(tag: str) -> None:
        if not any(o[0] == tag for o in made.open):
            return
        while (last := made.open.pop())[0] != tag:
            problems.append(f"<{last[0]}> was left open inside <{tag}>")

    for kind, tag, attrs in _Tokens(html).found:
        row = made.open[-1][2] if made.open else None
        if kind == "text":
            if table:
                if row.get("cell") is not None:
                    row["cell"].append(tag)
            elif row is not None:
                row["said"].append(tag)
            elif tag.strip():
                problems.append(f"text outside any tag: {tag.strip()[:SHOWN]!r}")
        elif table:
            table += (kind == "open") - (kind == "close") if tag == "table" else 0
            if table and tag == "thead":
                row["header"] = row["header"] or kind == "open"
            elif table and tag == "br" and row.get("cell") is not None:
                row["cell"].append(" ")
            elif table:
                _cells(row, kind, tag)
            else:
                for part in ("td", "tr"):
                    _cells(row, "close", part)
                close("table")
        elif tag in INLINE:
            if tag == "br" and kind == "open" and row is not None:
                row["said"].append("\n")
        elif tag not in OWN_BLOCK | OWN_CONTAINER:
            if kind == "open":
                problems.append(f"<{tag}> is not part of the vocabulary")
        elif kind == "close":
            close(tag)
        else:
            while made.open and made.open[-1][0] in LEAF:
                made.open.pop()
            table = int(tag == "table")
            made.add(tag, "node", attrs={k: v or "" for k, v in attrs}, **({"rows": [], "header": False} if table else {}))
    problems += [f"<{tag}> was never closed" for tag, *_ in reversed(made.open)]
    for r in made.rows:
        r["text"] = "\n".join("\t".join(line) for line in r["rows"]) if r["rows"] is not None else "".join(r["said"]) if r["tag"] == "pre" else by_lines("".join(r["said"]))
        r["pos"] = r["nid"]
    _paths(made.rows)
    return made.rows, problems


def _read(pages: DataFrame, html: str, parse: Callable[[str | None], tuple], names: tuple[str, str], kinds: tuple[str, str], fields: tuple[str, ...], swap: bool) -> DataFrame:
    """content_id and what ``parse`` makes of each page, over Arrow batches."""
    import pyarrow as pa

    spark, kind = pages.sparkSession, pages.schema["content_id"].dataType.simpleString()
    schema = f"content_id {kind}, {names[0]} {kinds[0]}, {names[1]} {kinds[1]}"
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            got = [parse(h) for h in batch.column(1).to_pylist()]
            trim = lambda rows: [{f: (list(r[f].items()) if f == "attrs" else r[f]) for f in fields} for r in rows]
            first, second = ([g[k] if (k == 1) == swap else trim(g[k]) for g in got] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first, shape.field(1).type), pa.array(second, shape.field(2).type)], list(shape.names))

    return pages.select("content_id", html).mapInArrow(run, schema)


def html_nodes(pages: DataFrame) -> DataFrame:
    """content_id, title and nodes of each page of content_id, html; a null page has none."""
    return _read(pages, "html", tree, ("title", "nodes"), ("string", NODE), ("nid", "parent", "path", "tag", "text", "rows", "header"), False)


def own_rows(pages: DataFrame) -> DataFrame:
    """content_id, rows and problems of each text of content_id, html in the library's own HTML."""
    return _read(pages, "html", own, ("rows", "problems"), (OWN, "array<string>"), ("pos", "parent", "path", "tag", "text", "rows", "header", "attrs"), True)
