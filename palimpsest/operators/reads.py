"""Reads of documents and listings: outlines, titles, current contents, pages, hits by word, highlights, child rows, upserts and pruning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import expressions as E


def child_counts(parents: DataFrame, key: str, children: DataFrame, where: Column | None = None) -> DataFrame:
    """Parents with the number ``n`` of their children (that match), 0 included."""
    some = children if where is None else children.where(where)
    return parents.join(some.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def newest(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s")).select(key, "s.*")


def listing(documents: DataFrame, contents: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents (document_id) with the status of their newest content (document_id, content_id, status, created, is_current), null
    if none, and the pages of the current one, 0 if none."""
    last = newest(contents.select("document_id", "created", "content_id", "status"), "document_id", ["created", "content_id"]).select("document_id", "status")
    now = contents.where("is_current").select("document_id", "content_id")
    counted = child_counts(now, "content_id", pages).groupBy("document_id").agg(F.sum("n").alias("pages"))
    return documents.join(last, "document_id", "left").join(counted, "document_id", "left").withColumn("pages", F.coalesce("pages", F.lit(0)))


def flip(contents: DataFrame, fresh: DataFrame) -> DataFrame:
    """Contents after each document's fresh content (document_id, content_id) became the current one."""
    new = fresh.select("document_id", F.col("content_id").alias("fresh_id"))
    return contents.join(new, "document_id", "left").withColumn("is_current", F.when(F.col("fresh_id").isNull(), F.col("is_current")).otherwise(F.col("content_id") == F.col("fresh_id"))).drop("fresh_id")


def flipped_title(title: Column, file_name: Column, extracted: Column) -> Column:
    """A document's title is replaced only where it is blank or the file's name."""
    return F.when(((title == "") | (title == file_name)) & extracted.isNotNull() & (extracted != ""), extracted).otherwise(title)


def outline(nodes: DataFrame) -> DataFrame:
    """Headings in order of nid."""
    return nodes.where(F.col("tag").rlike("^h[1-6]$")).orderBy("content_id", "nid")


def heading_title(nodes: DataFrame) -> DataFrame:
    """Of each content the text of its highest heading, of several the first."""
    heads = nodes.where(F.col("tag").rlike("^h[1-6]$"))
    return heads.groupBy("content_id").agg(F.min_by("text", F.struct("tag", "nid")).alias("title"))


def first_heading(nodes: DataFrame, most: int = 200) -> DataFrame:
    """Of each content the text of its first heading of any level, cut."""
    return nodes.where(F.col("tag").rlike("^h[1-6]$")).groupBy("content_id").agg(F.substring(F.min_by("text", "nid"), 1, most).alias("title"))


def page_text(nodes: DataFrame, drawn: DataFrame) -> DataFrame:
    """The text of each page (content_id, page): the topmost nodes drawn on it (content_id, page, nid), in order of nid."""
    from palimpsest.operators.documents import topmost

    on = nodes.join(drawn.select("content_id", "page", "nid").distinct(), ["content_id", "nid"])
    top = topmost(on, "page")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("nid", "text"))), lambda x: x["text"])
    return top.groupBy("content_id", "page").agg(F.array_join(parts, "").alias("text"))


def hit_word(points: DataFrame, words: DataFrame) -> DataFrame:
    """Each point (page, point, x, y) with the first word, of the region of least area, whose box holds it, edges included.
    ``words``: page, region, area, seq, x0, y0, x1, y1, in any unit. Of words in one box only the first can be it."""
    from palimpsest.operators.documents import least_on

    box, x, y = F.struct("x0", "y0", "x1", "y1").alias("box"), F.col("x"), F.col("y")
    boxed = words.groupBy("page", box).agg(F.min(F.struct("area", "region", "seq")).alias("best"))
    held = x.between(F.col("box.x0"), F.col("box.x1")) & y.between(F.col("box.y0"), F.col("box.y1"))
    return least_on(points, boxed, held).select("page", "point", "best.region", "best.seq")


def scaled(ring: Column, width: Column, height: Column) -> Column:
    """A ring in pixels; null without a ring."""
    return F.when(F.size(ring) > 0, F.transform(ring, lambda p: F.struct((p["x"] * width).alias("x"), (p["y"] * height).alias("y"))))


def box_or_ring(box: Column, ring: Column) -> Column:
    """A region's box, else the bounds of its ring."""
    return F.coalesce(box, F.when(F.size(ring) > 0, E.ring_box(ring)))


def highlight(text: Column, query: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """A text with the query's words of more than one character marked, in any case; longer words first."""
    import re

    words = sorted({re.escape(w) for w in query.split() if len(w) > 1}, key=lambda w: (-len(w), w))
    return F.regexp_replace(text, f"(?i)({'|'.join(words)})", f"{before}$1{after}") if words else text


def described_children(children: DataFrame, parents: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Child rows with ``label``: the labels of what their other keys point to, deleted ones included, joined by a comma.
    ``parents``: column -> (table, its key, its label)."""
    out, names = children, []
    for k, (column, (table, key, label)) in enumerate(parents.items()):
        out = out.join(table.select(F.col(key).alias(column), F.col(label).alias(f"label_{k}")), column, "left")
        names.append(f"label_{k}")
    return out.withColumn("label", F.concat_ws(", ", *names)).drop(*names)


def looked_up(rows: DataFrame, key: str, names: DataFrame, name: str) -> DataFrame:
    """Rows with a name from a small table, ``unknown`` where it has none."""
    return rows.join(F.broadcast(names.select(key, name)), key, "left").withColumn(name, F.coalesce(name, F.lit("unknown")))


def existing(events: DataFrame, key: Sequence[str]) -> DataFrame:
    """What an upsert meets under each key: the live row, else the newest retired one."""
    order = Window.partitionBy(*key).orderBy("retired", F.desc("created"), F.desc("id"))
    return events.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def upserted(events: DataFrame, want: DataFrame, key: Sequence[str], payload: str, keep: Sequence[str] = ()) -> DataFrame:
    """Read-model rows after ``want`` (key, payload) was recorded: new payload, live again; ``keep`` columns stay as they were; other rows as
    they are. A wanted key whose rows are all retired revives the newest."""
    have = existing(events, key)
    rest = events.join(have.select("id"), "id", "left_anti")
    both = have.join(want.select(*key, F.col(payload).alias("new_payload"), F.lit(True).alias("asked")), list(key), "full")
    asked = F.coalesce("asked", F.lit(False))
    both = both.withColumns({payload: F.when(asked, F.col("new_payload")).otherwise(F.col(payload)), "retired": F.when(asked, F.lit(False)).otherwise(F.col("retired"))})
    return rest.unionByName(both.select(*events.columns))


def prune_snapshots(contents: DataFrame, cutoff: Column) -> DataFrame:
    """Contents to prune: not current, finished (succeeded, partial, failed), created before the cutoff, and not the newest success of
    their document and extractor."""
    spared = contents.where("status = 'succeeded'").groupBy("document_id", "extractor").agg(F.max_by("content_id", F.struct("created", "content_id")).alias("content_id"))
    old = contents.where(~F.col("is_current") & F.col("status").isin("succeeded", "partial", "failed") & (F.col("created") < cutoff))
    return old.join(spared.select("content_id"), "content_id", "left_anti")


def upload_faults(files: DataFrame, most: int, sizes: dict[str, int]) -> DataFrame:
    """What is wrong with a batch of uploads (batch, name, kind, size), by batch: an empty list lets it in as a whole."""
    limit = F.coalesce(*(F.when(F.col("kind") == k, F.lit(n)) for k, n in sizes.items()))
    fault = F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "name").when(F.coalesce("size", F.lit(0)) == 0, "empty").when(limit.isNull(), "type").when(F.col("size") > limit, "size")
    got = files.groupBy("batch").agg(F.array_sort(F.collect_set(fault)).alias("faults"), F.count(F.lit(1)).alias("files"))
    return got.withColumn("faults", F.when(F.col("files") > most, F.array_union("faults", F.array(F.lit("count")))).otherwise(F.col("faults")))


def importable(name: Column, mime: Column, suffixes: Sequence[str], mimes: Sequence[str]) -> Column:
    return F.coalesce(F.lower(name).rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"), F.lit(False)) | F.coalesce(mime.isin(list(mimes)), F.lit(False))


def mime_type(declared: Column, name: Column, by_suffix: dict[str, str], useless: Sequence[str] = ("", "application/octet-stream")) -> Column:
    """The declared type unless it says nothing, else that of the name's extension."""
    table = F.create_map(*(F.lit(x) for kv in by_suffix.items() for x in kv))
    found = F.try_element_at(table, F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)))
    return F.when(declared.isNull() | declared.isin(list(useless)), F.coalesce(found, F.lit("application/octet-stream"))).otherwise(declared)


def first_paragraph(text: Column, most: int = 220) -> Column:
    """The first paragraph on one line, cut at a word."""
    flat = E.collapse(F.get(F.split(F.trim(text), r"\n\s*\n"), F.lit(0)))
    cut = F.regexp_replace(F.substring(flat, 1, most), r"\s+\S*$", "")
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(cut, F.lit("…")))


def preset_start(name: str, now: Column) -> Column:
    """Where a preset window starts: 24h rolls, today is midnight, week is Monday's midnight."""
    return {"24h": now - F.expr("INTERVAL 24 HOURS"), "today": F.date_trunc("day", now), "week": F.date_trunc("week", now)}[name]


def time_column(df: DataFrame, wanted: Sequence[str] = ("at", "created", "modified")) -> str | None:
    """The first of these columns that a table has."""
    return next((c for c in wanted if c in df.columns), None)


def parsed_bound(value: Column) -> tuple[Column, Column]:
    """(day, whether it was malformed) of a bound of a filter; a malformed one is dropped."""
    day = F.try_to_date(F.trim(value), "yyyy-MM-dd")
    return day, F.coalesce((F.trim(value) != "") & day.isNull(), F.lit(False))


def clamped_page(count: int, number: int, size: int = 20) -> int:
    return min(max(1, number), max(1, -(-count // size)))


def patched(row: DataFrame, patch: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows with what a patch gives: only fields that are in its ``present`` set, nulls included."""
    new = patch.select(key, "present", *(F.col(f).alias(f"new_{f}") for f in fields))
    given = lambda f: F.coalesce(F.array_contains("present", f), F.lit(False))
    out = row.join(new, key, "left")
    return out.withColumns({f: F.when(given(f), F.col(f"new_{f}")).otherwise(F.col(f)) for f in fields}).select(*row.columns)


def erased(tables: dict[str, DataFrame], owner) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables without an owner's rows, history and edges alike, and how many each lost (tab, n)."""
    mine = F.col("owner_id").eqNullSafe(F.lit(owner))
    counts = None
    for name, df in tables.items():
        part = df.where(mine).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tab"), "n")
        counts = part if counts is None else counts.unionByName(part)
    return {name: df.where(~mine) for name, df in tables.items()}, counts


def isolated(tables: dict[str, DataFrame]) -> list[str]:
    """Tables whose rows belong to an owner."""
    return sorted(name for name, df in tables.items() if "owner_id" in df.columns)


def unscrubbed(tables: dict[str, DataFrame], rules: set[str], known: set[str]) -> dict[str, list[str]]:
    """Columns of each table that no scrubbing rule knows."""
    return {name: sorted(set(df.columns) - rules - known) for name, df in tables.items() if set(df.columns) - rules - known}
