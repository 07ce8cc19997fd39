"""Versioned tables: an append-only log in which an object's state is its last version.

A log has owner_id, obj_id, seq (write order within an object), deleted and the mirrored fields.
Versions are numbered by seq; reading any past state, diffing neighbours and grouping changes into
runs are windows by object, so the log is dealt by object once for all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOISE = ("id", "created", "modified", "version", "owner_id")


class Scope:
    """The only reader of tenants' rows: every read is filtered by owner; without one it fails, a null owner sees nothing."""

    def __init__(self, owner, *, admin: bool = False):
        if owner is None and not admin:
            raise PermissionError("no tenant: name one, or ask for the admin scope")
        self.owner, self.admin = owner, admin

    def all(self, df: DataFrame) -> DataFrame:
        return df if self.admin else df.where(F.col("owner_id") == F.lit(None if self.owner == "" else self.owner))

    def alive(self, df: DataFrame) -> DataFrame:
        return self.all(df).where(~F.col("deleted"))


def numbered(log: DataFrame) -> DataFrame:
    return log.withColumn("version", F.row_number().over(Window.partitionBy("obj_id").orderBy("seq")))


def latest(log: DataFrame) -> DataFrame:
    """One row for each object: its last version (by version, never by time)."""
    cols = [c for c in log.columns if c != "obj_id"]
    return log.groupBy("obj_id").agg(F.max_by(F.struct(*cols), "version").alias("s")).select("obj_id", "s.*")


def as_of(log: DataFrame, version: int) -> DataFrame:
    """Version ``version`` and the one before it."""
    return log.where(F.col("version").isin(version, version - 1))


def with_current(log: DataFrame) -> DataFrame:
    return log.withColumn("is_current", F.col("version") == F.max("version").over(Window.partitionBy("obj_id")))


def counted_on(tops: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with version and seq that count on from their object's last (obj_id, top, top_seq)."""
    n = F.row_number().over(Window.partitionBy("obj_id").orderBy("seq"))
    new = rows.join(tops, "obj_id", "left").withColumns({"version": F.coalesce("top", F.lit(0)) + n, "seq": F.coalesce("top_seq", F.lit(0)) + n})
    return new.drop("top", "top_seq")


def append(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with further versions of its objects: each counts on from the object's last."""
    tops = log.groupBy("obj_id").agg(F.max("version").alias("top"), F.max("seq").alias("top_seq"))
    return log.unionByName(counted_on(tops, rows).select(*log.columns))


def restore(log: DataFrame, version: int) -> DataFrame:
    """Appends each object's state at ``version`` as its next, live version."""
    return append(log, log.where(F.col("version") == version).withColumn("deleted", F.lit(False)).drop("version"))


def soft_delete(log: DataFrame, which: Column) -> DataFrame:
    """Appends a deleted version to live objects that match; those already deleted are skipped."""
    return append(log, latest(log).where(which & ~F.col("deleted")).withColumn("deleted", F.lit(True)).drop("version"))


def hard_delete(log: DataFrame, ids: DataFrame) -> DataFrame:
    return log.join(ids, "obj_id", "left_anti")


def diff(log: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Each version with ``changes``: array<struct<field, old, new>> against the one before, sorted by field. A first version
    lists what isn't null, an empty string, a zero or false, each by the column's type. Nested values show as JSON with keys in order."""
    fields = sorted(f for f in fields if f not in NOISE)
    kinds = {f.name: f.dataType for f in log.schema}
    w = Window.partitionBy("obj_id").orderBy("version")
    before = log.withColumn("prev", F.lag(F.struct("version", *fields)).over(w))
    first = F.col("prev").isNull()
    rows = []
    for f in fields:
        old, new = F.col(f"prev.{f}"), F.col(f)
        text = lambda c, k=kinds[f]: rendered(c, k)
        blank = new == "" if isinstance(kinds[f], T.StringType) else ~new if isinstance(kinds[f], T.BooleanType) else new == 0 if isinstance(kinds[f], T.NumericType) else F.lit(False)
        changed = F.when(first, new.isNotNull() & ~blank).otherwise(differs(old, new, kinds[f]))
        rows.append(F.when(changed, F.struct(F.lit(f).alias("field"), text(old).alias("old"), text(new).alias("new"))))
    return before.withColumn("changes", F.filter(F.array(*rows), lambda x: x.isNotNull())).drop("prev")


def rendered(value: Column, kind: T.DataType) -> Column:
    """A value as a revision shows it: null stays null, structs, maps and arrays as JSON (maps with keys in order), else as text."""
    if isinstance(kind, T.MapType):
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(value))))
    return F.to_json(value) if isinstance(kind, (T.StructType, T.ArrayType)) else value.cast("string")


def differs(old: Column, new: Column, kind: T.DataType) -> Column:
    """Null-safe; maps, which don't compare, by what they show."""
    return ~rendered(old, kind).eqNullSafe(rendered(new, kind)) if isinstance(kind, T.MapType) else ~old.eqNullSafe(new)


def untracked(log: DataFrame, schemas: DataFrame, now: Sequence[str]) -> DataFrame:
    """Fields of today that a version's schema tag didn't track; all of them under an unknown tag. ``schemas``: schema_tag, fields."""
    return log.join(F.broadcast(schemas), "schema_tag", "left").withColumn("untracked", F.array_except(F.array(*map(F.lit, now)), F.coalesce("fields", F.array().cast("array<string>"))))


def runs(revisions: DataFrame) -> DataFrame:
    """Revisions by context; one without a context is a run of its own. Members come in order of their events."""
    key = F.coalesce(F.col("context_id").cast("string"), F.concat(F.lit("orphan:"), F.col("event_id").cast("string")))
    members = F.array_sort(F.collect_list(F.struct("event_id", "obj_id", "version")))
    return revisions.groupBy(key.alias("run")).agg(F.max("at").alias("at"), F.count(F.lit(1)).alias("n"), members.alias("members"))


def schema_at(schemas: DataFrame, tag: str) -> DataFrame:
    """The fields of each label under a schema tag; no row where it is unknown. ``schemas``: tag, label, fields."""
    return schemas.where(F.col("tag") == tag).select("label", "fields")


def schema_fold(known: DataFrame, new: DataFrame) -> DataFrame:
    """The schema log with ``new`` rows for tags and labels that it doesn't have; old ones are never rewritten."""
    return known.unionByName(new.join(known.select("tag", "label"), ["tag", "label"], "left_anti"))


def field_changes(then: Column, now: Column) -> Column:
    """Fields of one of two schemas alone, in order."""
    return F.array_sort(F.array_union(F.array_except(then, now), F.array_except(now, then)))


def tagged_diff(log: DataFrame, fields: Sequence[str], schemas: DataFrame) -> DataFrame:
    """diff() under schema tags (``schemas``: schema_tag, fields): changes of fields that both versions track, and ``unknown``, those
    of one alone. Under an unknown tag all is unknown (``*``); after a version under one, all fields of today's."""
    known = log.join(F.broadcast(schemas.select("schema_tag", F.col("fields").alias("now_fields"))), "schema_tag", "left")
    w = Window.partitionBy("obj_id").orderBy("version")
    known = known.withColumns({"then_fields": F.lag("now_fields").over(w), "is_first": F.lag("version").over(w).isNull()})
    out = diff(known, fields)
    none = F.array().cast("array<string>")
    names = F.array(*map(F.lit, sorted(f for f in fields if f not in NOISE)))
    mine = lambda c: F.array_sort(F.array_intersect(F.col(c), names))
    allowed = F.when(F.col("is_first"), mine("now_fields")).otherwise(F.array_intersect(mine("now_fields"), mine("then_fields")))
    kept = F.filter("changes", lambda c: F.coalesce(F.array_contains(allowed, c["field"]), F.lit(False)))
    unknown = F.when(F.col("now_fields").isNull(), F.array(F.lit("*"))).when(F.col("is_first"), none).when(F.col("then_fields").isNull(), mine("now_fields")).otherwise(field_changes(mine("then_fields"), mine("now_fields")))
    return out.withColumns({"changes": kept, "unknown": unknown}).drop("now_fields", "then_fields", "is_first")


def with_children(own: DataFrame, children: DataFrame) -> DataFrame:
    """An object's own revisions and those of its child rows (obj_id, event_id, at, label), newest first by (at, event_id)."""
    both = own.select("obj_id", "event_id", "at", F.lit(None).cast("string").alias("label"), F.lit(False).alias("is_related"))
    both = both.unionByName(children.select("obj_id", "event_id", "at", "label", F.lit(True).alias("is_related")))
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("obj_id").orderBy(F.desc("at"), F.desc("event_id"), "is_related", "label")))


def bulk_update(log: DataFrame, which: Column, values: dict[str, Column]) -> DataFrame:
    """Appends a version with new values to each live object that matches; no edges come of it."""
    return append(log, latest(log).where(which & ~F.col("deleted")).withColumns(values).drop("version"))


def saved(log: DataFrame, edges: DataFrame, rows: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A write with its sources: (log, edges) with the next version of each of ``rows`` and an edge from it to the current version
    of each of its ``sources`` (obj_id, source_obj); a row isn't its own source, and repeats count once."""
    after = append(log, rows)
    new = after.join(log.select("obj_id", "version"), ["obj_id", "version"], "left_anti").select("obj_id", F.col("version").alias("target_version"))
    top = log.groupBy(F.col("obj_id").alias("source_obj")).agg(F.max("version").alias("source_version"))
    made = sources.where("obj_id <> source_obj").select("obj_id", "source_obj").distinct().join(new, "obj_id").join(top, "source_obj")
    return after, edges.unionByName(made.select(*edges.columns))
