"""What is stored of a document, built and checked as a whole and published as one batch; and logs that are dumped and loaded as they were."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import documents as D
from palimpsest.operators import snapshot as Z
from palimpsest.operators import written as V
from palimpsest.sources import markup as M
from palimpsest.sources import snapshots as S
from palimpsest.sources.staging import settled

REGION = f"nid int, page int, box {V.BOX}, start int, stop int"
NODE = "nid int, path string, tag string, pages array<int>, text_start bigint, text_end bigint, html_start bigint, html_end bigint"


def built(documents: DataFrame, pages: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """What is stored of documents (content_id, html, as ``written.assembled`` writes them) with pages (content_id, page): contents (content_id, html, text), pages, nodes
    and regions, all of contents without a problem; and the problems (content_id, nid, problem) of the others. A tree is numbered and placed, its
    regions moved into the document's places, it is written as HTML, cut down to what may stay, and every node's place in that is checked."""
    nodes = settled(V.extracted(M.own_rows(documents)), "extracted")
    key = ["content_id", "path"]
    plan = settled(Z.planned(nodes.select(*key, "tag", "text")), "plan")
    spots = nodes.select(*key, F.explode("regions").alias("g")).select(*key, "g.*")
    none = lambda kind: F.lit(None).cast(kind)
    asked = spots.join(plan.select(*key, "nid"), key).select("content_id", "nid", "page", "box", none("array<struct<x:double,y:double>>").alias("ring"), "start", "stop", none("array<struct<x0:double,y0:double,x1:double,y1:double,start:int,stop:int,conf:double>>").alias("words"))
    regions = settled(V.regions_placed(asked, plan, pages), "regions")
    on = D.roll_up(spots.select(*key, "page"), F.array_sort(F.collect_set("page")).alias("on"))
    shown = plan.join(on, key, "left").withColumn("pages", F.array_join("on", ","))
    html = settled(Z.rendered(shown).withColumn("html", V.sanitised(F.col("html"))), "html")
    places = settled(shown.join(Z.located(shown), ["content_id", "nid"]), "places")
    wrong = Z.plan_problems(plan).unionByName(regions.select("content_id", "nid", F.explode("problems").alias("problem"))).unionByName(Z.enclosure_problems(places, html))
    wrong = settled(wrong, "problems")
    fine = lambda df: df.join(wrong.select("content_id"), "content_id", "left_anti")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nid", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n\n")
    text = plan.where("leaf").groupBy("content_id").agg(said.alias("text"))
    tables = {
        "contents": fine(html.join(text, "content_id")),
        "pages": fine(pages.select("content_id", "page").distinct()),
        "nodes": fine(places.select("content_id", "nid", "path", "tag", F.col("on").alias("pages"), "text_start", "text_end", "html_start", "html_end")),
        "regions": fine(regions.select("content_id", F.col("nid"), F.col("page").cast("int").alias("page"), "box", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))),
    }
    return tables, wrong


def store(root: str, batch: str, documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Builds and publishes a batch; the problems of what wasn't stored."""
    tables, wrong = built(documents, pages)
    S.publish(root, batch, tables)
    return wrong


def dump(root: str, name: str, log: DataFrame) -> bool:
    """A log as it is, under a name; see ``snapshots``."""
    return S.publish(root, name, {"log": log})


def load(root: str, name: str, into: DataFrame) -> DataFrame:
    """A log with the rows of a dump, versions and all as they were dumped; rows that the log has already (by obj_id and version) aren't taken again."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in into.schema)
    rows = S.published(into.sparkSession, root, "log", schema).where(F.col("batch") == name).drop("batch")
    have = into.select(F.col("obj_id").alias("h_obj"), F.col("version").alias("h_version"))
    return into.unionByName(rows.join(have, F.col("obj_id").eqNullSafe(F.col("h_obj")) & F.col("version").eqNullSafe(F.col("h_version")), "left_anti"))


def identified(asked: DataFrame, known: DataFrame, place: Sequence[str] = ()) -> DataFrame:
    """Extractors as runs asked for them (seq, name, tool_version, config: map) with ``op``: ``use`` what is known or was created before, ``create`` it, or
    ``refuse`` it, as its name and version stand for another config. ``known``: name, tool_version, config, one row each.

    The order of a config's keys means nothing; a null config is one of its own. The first by seq creates, of equal ones the first by the columns of ``place``, which aren't returned;
    it is found by an aggregate, so runs of one extractor, however many, are never together."""
    text = F.coalesce(F.to_json(F.array_sort(F.map_entries("config"))), F.lit("null"))
    key = ["name", "tool_version"]
    rows = asked.withColumn("said", text)
    first = rows.groupBy(*key).agg(F.min(F.struct("seq", *place, "said")).alias("first"))
    held = known.select(*key, text.alias("held"))
    kept = first.join(held, key, "left").select(*(F.col(c).alias(f"k_{c}") for c in key), F.coalesce("held", "first.said").alias("kept"), F.when(F.col("held").isNull(), F.col("first.seq")).alias("made"))
    met = rows.join(kept, rows["name"].eqNullSafe(kept["k_name"]) & rows["tool_version"].eqNullSafe(kept["k_tool_version"]))
    op = F.when(F.col("said") != F.col("kept"), "refuse").when(F.col("seq") == F.col("made"), "create").otherwise("use")
    return met.withColumn("op", op).select(*(c for c in asked.columns if c not in place), "op")
