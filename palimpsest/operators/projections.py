"""Read models and maintenance: upserts against sources, tag sets, orphans, retention, paging, scrubbing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import history as H


def rebuild(have: DataFrame, want: DataFrame, key: list[str], payload: str) -> DataFrame:
    """What a projection needs to match its sources: for each key insert, update, revive, retire or keep. ``have`` also has retired."""
    a = have.select(*key, F.col(payload).alias("old"), "retired", F.lit(True).alias("in_have"))
    b = want.select(*key, F.col(payload).alias("new"), F.lit(True).alias("in_want"))
    op = (
        F.when(F.col("in_have").isNull(), "insert").when(F.col("in_want").isNull(), F.when(F.col("retired"), "keep").otherwise("retire"))
        .when(F.col("retired"), "revive").when(~F.col("old").eqNullSafe(F.col("new")), "update").otherwise("keep")
    )
    return a.join(b, key, "full").select(*key, op.alias("op"))


def orphans(blobs: DataFrame, blob: str, references: list[tuple[DataFrame, str]]) -> DataFrame:
    """Blobs that no column refers to: a null-safe anti-join with the union of the columns."""
    used = None
    for df, c in references:
        part = df.where(F.col(c).isNotNull()).select(F.col(c).alias("used"))
        used = part if used is None else used.union(part)
    return blobs.join(used, blobs[blob] == used["used"], "left_anti")


def collected(log: DataFrame, references: list[tuple[DataFrame, str]]) -> DataFrame:
    """The log of blobs (obj_id) after every live one that no column refers to was deleted: one further version each; their history stays."""
    gone = orphans(H.latest(log).where(~F.col("deleted")), "obj_id", references)
    return H.append(log, gone.withColumn("deleted", F.lit(True)).drop("version"))


def marked_read(rows: DataFrame, asked: DataFrame, at) -> DataFrame:
    """Notifications (id, owner_id, read_at) after their owners asked (owner_id, id) to have them read at a time, with ``marked``, true where that changed one.

    What is read keeps its time; ids that aren't the owner's, aren't there, or come twice change nothing; a null id or owner matches none."""
    named = asked.select("owner_id", "id").distinct().withColumn("asked", F.lit(True))
    got = rows.join(named, ["owner_id", "id"], "left")
    marked = F.col("asked").isNotNull() & F.col("read_at").isNull()
    return got.withColumn("marked", marked).withColumn("read_at", F.when(F.col("marked"), at).otherwise(F.col("read_at"))).drop("asked")


def retain(df: DataFrame, by: list[str], order: list, keep: int) -> DataFrame:
    """All but the newest ``keep`` of each group: what goes."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") > keep).drop("rn")


def page(df: DataFrame, order: list, number: int, size: int = 50, most: int = 500) -> DataFrame:
    size = min(size, most)
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def after(df: DataFrame, at: str, key: str, cursor: tuple, size: int) -> DataFrame:
    """Keyset paging, newest first: what lies behind a cursor, and one row more to tell if there is a next page."""
    t, k = cursor
    behind = (F.col(at) < t) | ((F.col(at) == t) & (F.col(key) < k))
    return df.where(behind).orderBy(F.desc(at), F.desc(key)).limit(size + 1)


def reconcile(have: DataFrame, want: DataFrame, key: list[str]) -> DataFrame:
    """(key, op): add what is wanted and missing, retire what is there and unwanted."""
    return want.join(have, key, "left_anti").select(*key, F.lit("add").alias("op")).unionByName(have.join(want, key, "left_anti").select(*key, F.lit("retire").alias("op")))


def scrub(df: DataFrame, rules: dict, known: set[str]) -> DataFrame:
    """Placeholders for personal fields by name; a column that no rule knows is refused."""
    if unknown := set(df.columns) - set(rules) - known:
        raise ValueError(f"no scrubbing rule for {sorted(unknown)}")
    return df.withColumns({c: f(F.col(c)) for c, f in rules.items() if c in df.columns})


def islands(df: DataFrame, by: list[str], order: list, starts) -> DataFrame:
    """Rows with the number of their run, a run beginning where ``starts`` holds."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("run", F.sum(F.coalesce(starts(w).cast("int"), F.lit(1))).over(w))
