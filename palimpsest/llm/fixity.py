"""Merkle fixity audit of WARC replicas.

Records lie in files in a fixed order. A record's leaf is the SHA-256 of its length and bytes. Leaves
are cut into ordered ranges where a record's id says so (one in FAN, by a hash; one in FAN squared
starts a range of the next level, and so on up to one root for a file), and a range's node is the hash
of its length and of its children in order. As no cut depends on places or on what was before, a
lost, added or resized record changes the nodes above it and leaves all others as they are. Two
replicas are compared from the roots: only files whose roots differ are opened, and only ranges below
nodes that differ are compared, down to the records. There, records of one id and content are the
same; of what is left those of one id have changed, and others are missing or were added.

At scale: record bytes are hashed where they are read and never travel; a tree takes one small row for
each node. Files are bounded (FILE_RECORDS records on average, dealt by a hash of all that a record holds, and equal records
by their number among equals too, so no host, hot key or group of copies makes a large one). What was written on the way is deleted. A descent reads one level's mismatching nodes, a few rows where replicas agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm import base

FAN = 16
#: Records of a file, on average.
FILE_RECORDS = 4096
#: Levels of ranges that ids can start; FAN to this power is the number of hashes.
LEVELS = 8


def warc_record(url: Column, payload: Column, record_id: Column) -> Column:
    """A WARC/1.1 resource record as a string; a null url or payload counts as empty."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def leaves(records: DataFrame) -> DataFrame:
    """file, pos, record_id, key, at (offset), size, hash, level of each row of file, record_id, record (string). Records of a
    file are ordered by id, null first, then by content; rows alike in all of that are interchangeable. A null record counts
    as empty. ``key`` is the id with the number of earlier rows that have it; a record starts a range on ``level`` levels."""
    rows = records.select("file", "record_id", F.coalesce("record", F.lit("")).alias("record"))
    rows = rows.select("file", "record_id", F.octet_length("record").cast("long").alias("size"), F.sha2("record", 256).alias("body"))
    order = Window.partitionBy("file").orderBy(F.col("record_id").asc_nulls_first(), "body")
    at = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"pos": F.row_number().over(order) - 1, "at": at})
    before = F.row_number().over(Window.partitionBy("file", "record_id").orderBy("body")) - 1
    key = F.concat(F.coalesce(F.concat(F.lit("="), F.col("record_id").cast("string")), F.lit("-")), F.lit("#"), before.cast("string"))
    rows = rows.withColumn("key", key)
    level = sum(((F.crc32(F.col("key").cast("binary")) % FAN**k) == 0).cast("int") for k in range(1, LEVELS + 1))
    return rows.select("file", "pos", "record_id", "key", "at", "size", F.sha2(F.concat_ws(":", "size", "body"), 256).alias("hash"), level.alias("level"))


def grow(leaf: DataFrame, top: int) -> list[DataFrame]:
    """The levels of the trees, leaves first, up to one node for each file at ``top``: file, key (of the record that starts
    the range), up (key of the node above), pos, size, hash."""
    order = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    start = lambda k: F.coalesce(F.last(F.when(F.col("level") >= k, F.col("key")), True).over(order), F.lit("")) if k < top else F.lit("")
    levels = [base.save(leaf.withColumns({f"k{k}": start(k) for k in range(1, top + 1)}), "leaves")]
    for k in range(1, top + 1):
        more = [F.max(f"k{j}").alias(f"k{j}") for j in range(k + 1, top + 1)]
        kids = F.array_sort(F.collect_list(F.struct("pos", "hash")))
        node = levels[-1].groupBy("file", f"k{k}").agg(F.min("pos").alias("pos"), F.sum("size").alias("size"), kids.alias("kids"), *more)
        shown = F.sha2(F.concat_ws(",", F.col("size").cast("string"), F.transform("kids", lambda x: x["hash"])), 256)
        levels.append(base.save(node.withColumn("hash", shown).drop("kids"), "level"))
    return levels


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Compares two replicas (rows of file, record_id, record): file, state, and of either replica record_id, pos, at, size, hash.

    state is ``changed``, ``missing`` (from the second) or ``added`` (to it). Replicas that agree, or are both empty, give no
    rows. A file that one replica lacks is all missing or all added. Where ids are null or repeat, records of one id and
    content match first, and what is left is paired in order of its hashes. Further columns are ignored.
    """
    leaf = [base.save(leaves(x), "read") for x in (first, second)]
    found = compare(*leaf)
    base.drop(*leaf)
    return found


def compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """``audit`` of the leaves of two replicas, which are read several times; its result is written."""
    leaf, written = (first, second), []
    top = max((x.agg(F.max("level")).first()[0] or 0) for x in leaf) + 1
    trees = [grow(x, top) for x in leaf]
    bad = None
    for k in range(top, 0, -1):
        up = F.col(f"k{k + 1}") if k < top else F.lit("")
        sides = [t[k].select("file", F.col(f"k{k}").alias("key"), up.alias("up"), F.col("hash").alias(n)) for t, n in zip(trees, "ab", strict=True)]
        if bad is not None:
            sides = [x.join(bad, [x["file"] == bad["f"], x["up"] == bad["p"]], "left_semi") for x in sides]
        a, b = (x.drop("up") for x in sides)
        differ = a.join(b, ["file", "key"], "full").where(~F.col("a").eqNullSafe(F.col("b")))
        bad = base.save(differ.select(F.col("file").alias("f"), F.col("key").alias("p")), "differ")
        written.append(bad)
    parts = []
    for t in trees:
        x = t[0].join(bad, [t[0]["file"] == bad["f"], t[0]["k1"] == bad["p"]], "left_semi")
        x = x.withColumns({"id": F.regexp_replace("key", "#[0-9]+$", ""), "nth": F.row_number().over(Window.partitionBy("file", "record_id", "hash").orderBy("pos"))})
        parts.append(base.save(x, "opened"))
    same = ["file", "id", "hash", "nth"]
    left = [x.join(y.select(*same), same, "left_anti") for x, y in (parts, parts[::-1])]
    place = F.row_number().over(Window.partitionBy("file", "id").orderBy("hash", "pos"))
    named = [x.select("file", "id", place.alias("place"), *(F.col(c).alias(f"{n}_{c}") for c in ("record_id", "pos", "at", "size", "hash"))) for x, n in zip(left, "ab", strict=True)]
    met = named[0].join(named[1], ["file", "id", "place"], "full").drop("id", "place")
    found = base.save(met.withColumn("state", F.when(F.col("b_hash").isNull(), "missing").when(F.col("a_hash").isNull(), "added").otherwise("changed")), "found")
    base.drop(*written, *parts, *(level for tree in trees for level in tree))
    return found


def files(pages: DataFrame) -> DataFrame:
    """page rows with the WARC file that each goes to, by a hash of all that the record holds. Of records with many equals, which fill files of
    their own, one row stands with their number and they are numbered from it, in parts: equal rows are the same whichever they are, and the
    numbers don't depend on how the table is read."""
    count = pages.count()
    many = F.lit(max(1, count // FILE_RECORDS))
    same = F.xxhash64("page_id", "url", F.sha2("html", 256))
    hot = base.hot_hashes(pages, same)
    rows = pages.withColumn("h", same)
    if not hot:
        return rows.withColumn("file", F.pmod("h", many).cast("int")).drop("h")
    cold = rows.where(~F.col("h").isin(hot)).withColumn("file", F.pmod("h", many).cast("int"))
    counted = rows.where(F.col("h").isin(hot)).groupBy("h", "page_id", "url", "html").agg(F.count(F.lit(1)).alias("n"))
    parts = counted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {FILE_RECORDS}")))).repartition("h", "part")
    left = F.least(F.lit(FILE_RECORDS).cast("long"), F.col("n") - F.col("part") * FILE_RECORDS)
    each = parts.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), left)))
    return cold.unionByName(each.select(*pages.columns, "h", F.pmod(F.xxhash64("h", "part"), many).cast("int").alias("file"))).drop("h")


def replica(pages: DataFrame) -> DataFrame:
    """file, record_id, record of a damaged copy of ``pages`` (with file), by r = crc32(page_id as text) mod 97: the payload's
    first character is another (r = 3), its second half is lost (7), the record is lost (5), or a second one of that id with
    another address follows (11). An empty payload can't be damaged in the first two ways."""
    r = F.coalesce(F.crc32(F.col("page_id").cast("string").cast("binary")) % 97, F.lit(0))
    first = F.when(F.substring("html", 1, 1) == "#", "+").otherwise("#")
    body = F.when((r == 3) & (F.length("html") > 0), F.concat(first, F.expr("substring(html, 2)"))).when(r == 7, F.expr("substring(html, 1, length(html) div 2)")).otherwise(F.col("html"))
    urls = F.when(r == 11, F.array(F.col("url"), F.concat(F.coalesce("url", F.lit("")), F.lit("#again")))).otherwise(F.array("url"))
    rows = pages.where(r != 5).select("file", F.col("page_id").alias("record_id"), body.alias("body"), F.explode(urls).alias("url"))
    return rows.select("file", "record_id", warc_record(F.col("url"), F.col("body"), F.col("record_id")).alias("record"))


def op7_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the WARC of ``pages`` against its replica(): page_id, state (intact, changed, missing), n_bytes for each of its
    records, and a row with the state added for each record that only the replica has."""
    pages = files(base.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    records = pages.select("file", F.col("page_id").alias("record_id"), warc_record(F.col("url"), F.col("html"), F.col("page_id")).alias("record"))
    leaf = base.save(leaves(records), "read")
    other = base.save(leaves(replica(pages)), "read")
    found = compare(leaf, other)
    base.drop(other)
    known = found.where("state <> 'added'").select("file", F.col("a_pos").alias("pos"), "state")
    rows = leaf.join(known, ["file", "pos"], "left")
    rows = rows.select(F.col("record_id").alias("page_id"), F.coalesce("state", F.lit("intact")).alias("state"), F.col("size").alias("n_bytes"))
    return rows.unionByName(found.where("state = 'added'").select(F.col("b_record_id").alias("page_id"), "state", F.col("b_size").alias("n_bytes")))


# crc32 isn't in DuckDB, so SQL has no form of this query; a test holds it against brute force.
QUERIES = {"op7_fixity": op7_fixity}
ORACLE: dict[str, str] = {}
