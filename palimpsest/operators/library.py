"""A library's cards, failed pages, data sets imported from documents, and the events of a source. All set-based: joins by key, no loop over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import expressions as E
from palimpsest.operators import reads as R

#: What may be imported, and what a data set without a name is called.
SUFFIXES = (".csv", ".tsv", ".txt")
MIMES = ("text/csv", "text/tab-separated-values")
UNNAMED = "Imported dataset"


def failed_pages(contents: DataFrame) -> DataFrame:
    """(content_id, number) of pages that an extractor gave up on, as contents (content_id, stats: JSON) record them in ``failed_pages``; once each.
    Stats that are null, no JSON, or hold anything but a list there name none; nor does an entry that is no number."""
    listed = F.from_json("stats", "failed_pages array<string>")["failed_pages"]
    return contents.select("content_id", F.explode(listed).alias("n")).select("content_id", F.col("n").try_cast("int").alias("number")).where("number IS NOT NULL").distinct()


def page_rows(pages: DataFrame, contents: DataFrame) -> DataFrame:
    """``pages`` (content_id, number, others) with ``failed``."""
    bad = failed_pages(contents).withColumn("hit", F.lit(True))
    return pages.join(bad, ["content_id", "number"], "left").withColumn("failed", F.coalesce("hit", F.lit(False))).drop("hit")


def cards(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """What a feed shows of documents (doc_id, title, mime, size, created) with pages (doc_id): occurred_at, title (its id if it has none), description such as
    "PDF, 3 pages", page_count (null while nothing was read), and whether page one can be shown."""
    read = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"))
    kind = F.upper(F.element_at(F.split(F.coalesce("mime", F.lit("")), "/"), -1))
    n = F.col("page_count")
    said = F.when(n.isNull(), kind).otherwise(F.concat(kind, F.lit(", "), n.cast("string"), F.when(n == 1, " page").otherwise(" pages")))
    title = F.when(F.coalesce("title", F.lit("")) == "", F.col("doc_id").cast("string")).otherwise(F.col("title"))
    shown = F.coalesce(F.col("mime") == "application/pdf", F.lit(False)) | n.isNotNull()
    return documents.join(read, "doc_id", "left").select("doc_id", F.col("created").alias("occurred_at"), title.alias("title"), said.alias("description"), "mime", "size", "page_count", shown.alias("shown"))


def data_set_name(title: Column) -> Column:
    """A title without its last extension, of 200 characters at most."""
    stem = F.left(F.regexp_replace(title, r"\.[^.]*\z", ""), F.lit(200))
    return F.when(F.coalesce(stem, F.lit("")) == "", UNNAMED).otherwise(stem)


def imported(documents: DataFrame, versions: DataFrame, header: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Data sets, their edges and what was refused, of documents (doc_id, title, mime, text, name) and their current versions (doc_id, version).

    A data set has the name asked for, else the title's; the count of its rows; what it was imported from. Its edge is pinned to the version that the document has
    now, so a later change makes it stale and doesn't rewrite what it came from. A document that isn't delimited text, or that has no version, is refused
    whole: it leaves neither a data set nor an edge. A doc_id given twice is imported once for each row.
    """
    title = F.coalesce("title", F.lit(""))
    all_ = documents.join(versions.select("doc_id", "version"), "doc_id", "left")
    why = F.when(~R.importable(title, F.col("mime"), SUFFIXES, MIMES), "not delimited text").when(F.col("version").isNull(), "no version")
    judged = all_.withColumn("problem", why)
    fine = judged.where("problem IS NULL")
    asked = F.when(F.coalesce("name", F.lit("")) != "", F.left("name", F.lit(200))).otherwise(data_set_name(title))
    rows = E.row_count(F.coalesce("text", F.lit("")), F.lit(True) if header is None else header).cast("long")
    made = fine.select("doc_id", asked.alias("name"), F.concat(F.lit("Imported from "), title).alias("description"), rows.alias("row_count"))
    edges = fine.select(F.col("doc_id").alias("source_id"), F.col("version").alias("source_version"), F.lit("import dataset from document").alias("operation"))
    return made, edges, judged.where("problem IS NOT NULL").select("doc_id", "problem")


def removed(events: DataFrame, asked: DataFrame) -> DataFrame:
    """Read-model events (source_id, event_type, retired) after those of the sources asked for (source_id, event_type, null for all of its types) were retired, with ``changed``.
    Rows stay, for a later record to revive; what was retired before doesn't change."""
    whole = asked.where("event_type IS NULL").select("source_id").distinct().withColumn("every", F.lit(True))
    typed = asked.where("event_type IS NOT NULL").select("source_id", "event_type").distinct().withColumn("one", F.lit(True))
    got = events.join(whole, "source_id", "left").join(typed, ["source_id", "event_type"], "left")
    changed = ~F.col("retired") & (F.col("every").isNotNull() | F.col("one").isNotNull())
    return got.withColumn("changed", changed).withColumn("retired", F.col("retired") | F.col("changed")).drop("every", "one")


def events_of(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Every live event of the sources (source_id) with its ``place``, newest first; of equal times the larger id."""
    order = Window.partitionBy("source_id").orderBy(F.desc("created"), F.desc("id"))
    live = events.where(~F.col("retired")).join(sources.select("source_id").distinct(), "source_id", "left_semi")
    return live.withColumn("place", F.row_number().over(order))
