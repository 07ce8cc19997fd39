"""Writes by the request they came from, over all tables; projections by name; tenant exports and files."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def union_events(tables: dict[str, DataFrame]) -> DataFrame:
    """The rows of all event tables with ``tab``; columns that a table lacks are null."""
    parts = [df.withColumn("tab", F.lit(name)) for name, df in tables.items()]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def writes(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Each request (context_id) with its versions, the tables it wrote to and its edges; rows without a request count for none."""
    wrote = events.where("context_id IS NOT NULL").groupBy("context_id").agg(F.count(F.lit(1)).alias("versions"), F.count_distinct("tab").alias("tabs"))
    linked = edges.where("context_id IS NOT NULL").groupBy("context_id").agg(F.count(F.lit(1)).alias("edges"))
    return wrote.join(linked, "context_id", "left").fillna(0, ["edges"])


def with_context(rows: DataFrame, contexts: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows (context_id) with fields of their context; null for a context that is unknown or none."""
    return rows.join(contexts.select("context_id", *fields), "context_id", "left")


def edges_by_context(edges: DataFrame) -> DataFrame:
    """Edges (edge_id, context_id, created) as one row for each context, dated by its first member; an edge without a context is a group of its own."""
    key = F.when(F.col("context_id").isNull(), F.col("edge_id"))
    return edges.groupBy("context_id", key.alias("alone")).agg(F.min(F.struct("created", "edge_id")).alias("first"), F.count(F.lit(1)).alias("n")).select("context_id", F.col("first.created").alias("at"), F.col("first.edge_id").alias("edge_id"), "n")


class Projections:
    """Projections by key: functions from one frame to the events that it stands for."""

    KEY = re.compile(r"[a-z][a-z0-9_]*(\.[a-z][a-z0-9_]*)+")

    def __init__(self) -> None:
        self._made: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {}

    def add(self, key: str, make: Callable[[DataFrame], DataFrame], about: str = "") -> None:
        if not self.KEY.fullmatch(key):
            raise ValueError(f"not a key: {key!r}")
        if key in self._made:
            raise ValueError(f"{key!r} is there already")
        self._made[key] = (make, about)

    def described(self) -> dict[str, str]:
        return {k: about for k, (_, about) in sorted(self._made.items())}

    def backfill(self, sources: dict[str, DataFrame]) -> DataFrame:
        """The events of all keys whose source is given, with ``event_type``."""
        parts = [self._made[k][0](df).withColumn("event_type", F.lit(k)) for k, df in sources.items()]
        return functools.reduce(DataFrame.unionByName, parts)


def exported(tables: dict[str, DataFrame], owner, rules: dict[str, Column]) -> DataFrame:
    """An owner's rows of every table as (tab, row), row a JSON object of its columns by name; columns with a rule are replaced by it."""
    parts = []
    for name, df in tables.items():
        own = df.where(F.col("owner_id") == owner)
        own = own.withColumns({c: v for c, v in rules.items() if c in own.columns})
        parts.append(own.select(F.lit(name).alias("tab"), F.to_json(F.struct(*sorted(own.columns)), {"ignoreNullFields": "false"}).alias("row")))
    return functools.reduce(DataFrame.unionByName, parts)


def unpackable(name: Column) -> Column:
    """Whether an archive's member stays within the folder that it is unpacked to: relative, and no step up. Null or blank isn't."""
    flat = F.replace(name, F.lit("\\"), F.lit("/"))
    return F.coalesce((F.trim(flat) != "") & ~flat.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)"), F.lit(False))


def files_of(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(owner_id, key) of every file that any version of any table names (``tables``: log and its column of keys)."""
    parts = [df.select("owner_id", F.col(c).cast("string").alias("key")).where("key <> ''").distinct() for df, c in tables.values()]
    return functools.reduce(DataFrame.unionByName, parts).distinct()


def drift(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Tables whose policy (tab, policy) isn't what it should be: ``missing``, ``changed`` or ``extra``."""
    met = wanted.select("tab", F.col("policy").alias("w")).join(found.select("tab", F.col("policy").alias("f")), "tab", "full")
    what = F.when(F.col("f").isNull(), "missing").when(F.col("w").isNull(), "extra").when(F.col("w") != F.col("f"), "changed")
    return met.select("tab", what.alias("problem")).where("problem IS NOT NULL")


def tidy_tags(tags: Sequence[str] | None, most: int = 100) -> list[str] | None:
    """Tags under NFC, trimmed, one of each spelling that differs in case alone (the first), then cut; null stays null."""
    if tags is None:
        return None
    named = (unicodedata.normalize("NFC", t).strip() for t in tags if t is not None)
    first: dict[str, str] = {}
    for t in named:
        if t:
            first.setdefault(t.casefold(), t)
    return [t[:most] for t in first.values()]


@F.pandas_udf(ArrayType(StringType()))
def normalised_tags(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``tidy_tags`` of a column of lists; Spark has neither NFC nor case folding."""
    for s in column:
        yield s.map(tidy_tags)


def names_someone(value: Column) -> Column:
    """Whether a value reads as an identifier: 32 hexadecimal digits, with or without hyphens, braces or a prefix."""
    return F.regexp_replace(F.regexp_replace(value, "urn:|uuid:", ""), r"^[{}]+|[{}]+\z|-", "").rlike(r"^[0-9a-fA-F]{32}\z")


def attributed(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Writes (worker, seq, run, depth) under the context that was open at each, and the runs refused (worker, run).

    ``marks`` (worker, seq, kind, run, metadata) are what a worker did, by seq: ``open`` and ``close`` of a run, well nested, and ``write``. A run opened within another is one of its own,
    and at its end the outer one is in force again; ``run`` is null and ``depth`` 0 where none is open. A run whose metadata (map of strings) has a value that reads as an identifier
    is refused, as all tenants can read contexts: its writes belong to what is open around it. A run that isn't closed stays open; a close too many opens nothing.

    Two windows, by worker and by worker and depth: what is open at a depth is what was opened last there. No stack is kept, no pair of marks is joined.
    """
    bad = (F.col("kind") == "open") & F.coalesce(F.exists(F.map_values("metadata"), lambda v: F.coalesce(names_someone(v), F.lit(False))), F.lit(False))
    refused = marks.where(bad).select("worker", "run").distinct()
    left = marks.join(refused, ["worker", "run"], "left_anti")
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    deep = left.withColumn("depth", F.greatest(F.lit(0), F.sum(step).over(Window.partitionBy("worker").orderBy("seq"))).cast("int"))
    opened = F.last(F.when(F.col("kind") == "open", F.col("run")), ignorenulls=True).over(Window.partitionBy("worker", "depth").orderBy("seq"))
    return deep.withColumn("run", F.when(F.col("depth") > 0, opened)).where("kind = 'write'").select("worker", "seq", "run", "depth"), refused
