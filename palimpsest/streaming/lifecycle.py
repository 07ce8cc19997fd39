"""Readings of contents as attempts: begun, kept alive by heartbeats, ended, given up after a silence and taken over by the next.

``attempts`` tells them from all events at once, ``tracked`` from a stream, content by content with a timer; both give the same closed attempts.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How an attempt ends by itself, and after how long a silence it counts as given up.
ENDS = ("succeeded", "partial", "failed")
STALE = dt.timedelta(minutes=15)
CLOSED = "attempt int, started timestamp, last_seen timestamp, status string"


def _status(last: Column, waiting: Column) -> Column:
    return F.when(last.isin(*ENDS), last).when(waiting, "pending").otherwise("running")


def attempts(events: DataFrame, now: Column | None = None, stale: dt.timedelta = STALE) -> DataFrame:
    """(content_id, attempt, started, last_seen, status) of events (content_id, at, kind, seq; kind is pending, beat or one of ENDS).

    An event opens an attempt if none is open: at first, after an end, or after a silence of more than ``stale``, which leaves the one before ``stale``. An
    open attempt is pending as long as nothing but that was said, then running; where ``now`` is more than ``stale`` after its last event it is stale too.
    One sort by content; equal times go by seq.
    """
    w = Window.partitionBy("content_id").orderBy("at", "seq")
    before = F.lag(F.struct("at", "kind")).over(w)
    rows = events.withColumn("before", before)
    opens = F.col("before").isNull() | F.col("before.kind").isin(*ENDS) | (F.col("at") > F.col("before.at") + F.lit(stale))
    rows = rows.withColumn("attempt", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = rows.groupBy("content_id", "attempt").agg(F.min("at").alias("started"), F.max("at").alias("last_seen"), F.max_by("kind", F.struct("at", "seq")).alias("last"), F.bool_and(F.col("kind") == "pending").alias("waiting"))
    over = F.lead("attempt").over(Window.partitionBy("content_id").orderBy("attempt")).isNotNull()
    if now is not None:
        over = over | (now > F.col("last_seen") + F.lit(stale))
    status = F.when(~F.col("last").isin(*ENDS) & over, "stale").otherwise(_status(F.col("last"), F.col("waiting")))
    return found.select("content_id", F.col("attempt").cast("int").alias("attempt"), "started", "last_seen", status.alias("status"))


def tracked(stream: DataFrame, late: str = "0 seconds", stale: dt.timedelta = STALE) -> DataFrame:
    """The attempts of a stream of such events as they close. A content's state is its open attempt alone: number, begin, last event. Events of a
    micro-batch are taken in order; what is older than the watermark (``late`` behind the newest) is dropped. A timer closes what fell silent."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = stream.schema["content_id"].dataType.simpleString()
    span = int(stale.total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempt, started, last, open_ = state.get if state.exists else (0, 0, 0, False)
        closed = []

        def close(status: str) -> None:
            closed.append((key[0], attempt, started, last, status))

        if state.hasTimedOut:
            if open_:
                close("stale")
            open_ = False
        else:
            events = pd.concat(list(batches)).sort_values(["at", "seq"])
            for at, what in zip(events["at"].astype("datetime64[us]").astype("int64"), events["kind"], strict=True):
                if open_ and at > last + span * 1000:
                    close("stale")
                    open_ = False
                if not open_:
                    attempt, started, open_ = attempt + 1, at, True
                last = at
                if what in ENDS:
                    close(what)
                    open_ = False
        state.update((attempt, started, last, open_))
        if open_:  # a timer must lie ahead of the watermark
            state.setTimeoutTimestamp(max(last // 1000 + span + 1, state.getCurrentWatermarkMs() + 1))
        if closed:
            out = pd.DataFrame(closed, columns=["content_id", "attempt", "started", "last_seen", "status"])
            yield out.assign(**{c: pd.to_datetime(out[c], unit="us") for c in ("started", "last_seen")})

    timed = stream.withWatermark("at", late).groupBy("content_id")
    return timed.applyInPandasWithState(step, f"content_id {kind}, {CLOSED}", "attempt int, started bigint, last_seen bigint, open boolean", "append", GroupStateTimeout.EventTimeTimeout)


# --- pages of an attempt that was broken off


def read_so_far(progress: DataFrame, schema: str) -> DataFrame:
    """(content_id, page, payload) of what attempts (content_id, attempt, page, raw) have read, each page once, as its first attempt read it; what can't be read
    as ``schema`` isn't there."""
    rows = progress.withColumn("payload", F.from_json("raw", schema)).where(F.coalesce(F.to_json("payload") != "{}", F.lit(False)))
    return rows.groupBy("content_id", "page").agg(F.min_by("payload", "attempt").alias("payload"))


def open_pages(pages: DataFrame, done: DataFrame) -> DataFrame:
    """Pages (content_id, page) that no attempt has read."""
    return pages.join(done.select("content_id", "page"), ["content_id", "page"], "left_anti")


def counted(pages: DataFrame, done: DataFrame) -> DataFrame:
    """(content_id, pages, read): how many pages the next attempt needn't read."""
    met = pages.select("content_id", "page").distinct().join(done.select("content_id", "page").withColumn("there", F.lit(1)), ["content_id", "page"], "left")
    return met.groupBy("content_id").agg(F.count(F.lit(1)).alias("pages"), F.count("there").alias("read"))
