"""Read pages put together: what stays of them, blocks that go on over a page break, and the payloads that are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import assembly as A

#: Fixed value: characters of a printed page number at most.
LABEL = 20


def judged(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks (content_id, page, pos, kind, text, furniture) of pages (content_id, page, failed) that were read, with ``verdict``: furniture,
    dropped (empty, but for a figure), noise or kept."""
    read = pages.where(~F.coalesce("failed", F.lit(False))).select("content_id", "page")
    empty = (F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s", "") == "") & (F.col("kind") != "figure")
    verdict = F.when(F.col("furniture").isNotNull(), "furniture").when(empty, "dropped").when(A.noise(F.col("kind"), F.col("text")), "noise").otherwise("kept")
    return blocks.join(read, ["content_id", "page"]).withColumn("verdict", verdict)


def report(seen: DataFrame, pages: DataFrame) -> DataFrame:
    """Counters of each content over ``judged`` blocks: pages, failed, empty (read, but nothing kept), and its blocks by verdict."""
    kinds = ("furniture", "dropped", "noise", "kept")
    by_page = seen.groupBy("content_id", "page").agg(*(F.count_if(F.col("verdict") == k).alias(k) for k in kinds))
    failed = F.coalesce("failed", F.lit(False))
    met = pages.join(by_page, ["content_id", "page"], "left")
    return met.groupBy("content_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(failed).alias("failed"), F.count_if(~failed & (F.coalesce("kept", F.lit(0)) == 0)).alias("empty"), *(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in kinds))


def labels(seen: DataFrame) -> DataFrame:
    """(content_id, page, label): the first printed number of a page among its furniture."""
    text = F.trim("text")
    shown = seen.where((F.col("verdict") == "furniture") & F.col("furniture").contains("number") & F.length(text).between(1, LABEL))
    return shown.groupBy("content_id", "page").agg(F.min_by(text, "pos").alias("label"))


def fragments(kept: DataFrame, pages: DataFrame, merge_tables: bool = True) -> DataFrame:
    """Kept blocks (content_id, page, pos, kind, text, aside, continues) with the item that each is part of, its [start, stop) in the item's
    text, and ``piece``, what it adds to it.

    A page's first block goes on from the block before if that ends the page read just before, both have the same ``aside``, and
    ``continues`` says so for kinds alike, or, where that is null, the texts look like it. A hyphen at the break goes, else a space comes.
    Tables go on only where ``continues`` says so and ``merge_tables`` holds: their rows follow on lines of their own, without a first row that repeats
    the first table's header (column ``header``, the text of a table's header row; null or no such column: it has none).
    """
    if "header" not in kept.columns:
        kept = kept.withColumn("header", F.lit(None).cast("string"))
    w = Window.partitionBy("content_id").orderBy("page", "pos")
    read = pages.where(~F.coalesce("failed", F.lit(False))).select("content_id", "page", F.row_number().over(Window.partitionBy("content_id").orderBy("page")).alias("nth"))
    rows = kept.join(read, ["content_id", "page"]).withColumn("before", F.lag(F.struct("nth", "kind", "text", "aside")).over(w))
    p: Column = F.col("before")
    alike = A.compatible(p["kind"], F.col("kind"), merge_tables)
    said = F.when(F.col("continues").isNull(), A.continued(p["kind"], p["text"], F.col("kind"), F.col("text"))).otherwise(F.col("continues") & alike)
    goes_on = F.coalesce((p["nth"] == F.col("nth") - 1) & p["aside"].eqNullSafe(F.col("aside")) & said, F.lit(False))
    rows = rows.withColumn("goes_on", goes_on).withColumn("ahead", F.coalesce(F.lead("goes_on").over(w), F.lit(False)))
    rows = rows.withColumn("item", F.sum((~F.col("goes_on")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("content_id", "item").orderBy("page", "pos")
    table, top = F.col("kind") == "table", F.first("header").over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    again = F.col("goes_on") & table & F.coalesce(F.substring_index("text", "\n", 1) == top, F.lit(False))
    rest = F.when(F.instr("text", "\n") > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise("")
    body = F.when(again, rest).otherwise(F.col("text"))
    rows = rows.withColumn("body", F.when(table & F.col("goes_on") & (F.length(body) > 0), F.concat(F.lit("\n"), body)).otherwise(body))
    hyphen = F.col("ahead") & ~table & F.col("text").endswith("-")
    own = F.when(hyphen, F.length("body") - 1).otherwise(F.length("body"))
    piece = F.when(hyphen, F.substring("body", F.lit(1), F.length("body") - 1)).when(F.col("ahead") & ~table, F.concat("body", F.lit(" "))).otherwise(F.col("body"))
    rows = rows.withColumns({"piece": piece, "own": own})
    before = F.coalesce(F.sum(F.length("piece")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"before": before, "skip": (table & F.col("goes_on") & (F.length("piece") > 0)).cast("int")})  # a row's line end belongs to neither
    return rows.withColumn("start", F.col("before") + F.col("skip")).withColumn("stop", F.col("before") + F.col("own")).drop("before", "goes_on", "ahead", "own", "nth", "body", "skip", "header")


def items(parts: DataFrame) -> DataFrame:
    """Items (content_id, item, kind, text, first_page, n_fragments) of ``fragments``; an item has one fragment a page."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "pos", "piece"))), lambda s: s["piece"]), "")
    return parts.groupBy("content_id", "item").agg(F.first("kind").alias("kind"), text.alias("text"), F.min("page").alias("first_page"), F.count(F.lit(1)).alias("n_fragments"))


def payload(rows: DataFrame, by: str, order: str, fields: list[str]) -> DataFrame:
    """(by, payload): the rows of each ``by`` (one document's) as a JSON array in order, ``order`` first and the other fields by name, so equal rows give equal bytes."""
    one = F.struct(order, *sorted(f for f in fields if f != order))
    return rows.groupBy(by).agg(F.to_json(F.array_sort(F.collect_list(one))).alias("payload"))
