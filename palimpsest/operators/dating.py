"""Datelines, the dates of a document's nodes and pages, and what must hold of them. All stays in the JVM."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import expressions as E
from palimpsest.functions import layout as Y
from palimpsest.operators import documents as D
from palimpsest.sources.staging import settled

#: German and English names of the months.
MONTHS = {
    "januar": 1, "january": 1, "jan": 1, "februar": 2, "february": 2, "feb": 2, "märz": 3, "maerz": 3, "march": 3, "mär": 3, "mar": 3,
    "april": 4, "apr": 4, "mai": 5, "may": 5, "juni": 6, "june": 6, "jun": 6, "juli": 7, "july": 7, "jul": 7, "august": 8, "aug": 8,
    "september": 9, "sept": 9, "sep": 9, "oktober": 10, "october": 10, "okt": 10, "oct": 10, "november": 11, "nov": 11,
    "dezember": 12, "december": 12, "dez": 12, "dec": 12,
}
#: How a year, a month's name and a day are written.
YEAR, MONTH, DAY, ORDINAL = "(1[0-9]{3}|20[0-9]{2})", r"([A-Za-zÄÖÜäöü]{3,9})\.?", "([0-3]?[0-9])", "(?:st|nd|rd|th)?"
#: Forms of a date in order of preference, which groups are its year, month and day, and how sure it is.
FORMS = (
    (r"\b(\d{4})-(\d{2})-(\d{2})\b", (1, 2, 3), 0.95),
    (rf"\b{DAY}\.\s*{MONTH}\s+{YEAR}\b", (3, 2, 1), 0.9),
    (rf"\b{DAY}{ORDINAL}\s+(?:of\s+)?{MONTH}\s+{YEAR}\b", (3, 2, 1), 0.9),
    (rf"\b{MONTH}\s+{DAY}{ORDINAL},?\s+{YEAR}\b", (3, 1, 2), 0.9),
    (rf"\b{DAY}[./]([01]?[0-9])[./]{YEAR}\b", (3, 2, 1), 0.85),
    (r"\b(\d{4})-(\d{2})\b(?!-\d)", (1, 2, None), 0.9),
    (rf"\b{MONTH}\s+{YEAR}\b", (2, 1, None), 0.8),
)
BARE_YEAR = rf"(?iU)^\s*(?:(?:im|in|anno)\s+)?{YEAR}\s*$"
#: Fixed values, in characters: how far in a dateline may start, how much may stand beside it, how much of the line is read.
LEAD, BESIDE, WINDOW = 20, 30, 160


def month_number(name: Column) -> Column:
    """The number of a month by its digits or by its German or English name, in any case and with or without a point; else null."""
    table = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))
    number = F.coalesce(name.try_cast("int"), F.try_element_at(table, F.lower(F.rtrim(name, F.lit(".")))))
    return F.when(number.between(1, 12), number)


def day_of(year: Column, month: Column, day: Column) -> Column:
    """A day of the calendar, null for what isn't one."""
    padded = lambda c, n: F.lpad(c.try_cast("int").cast("string"), n, "0")
    return F.when(year.try_cast("int") >= 1, F.try_to_date(F.concat(padded(year, 4), F.lit("-"), padded(month, 2), F.lit("-"), padded(day, 2)), "yyyy-MM-dd"))


def _found(line: Column, heading: Column, form: str, groups: tuple) -> Column:
    """struct<lo, hi, said> of the first date of a form that stands where a dateline does; null, or with null members, without one.

    Dates come one after another with the text before each (``\\G`` keeps them in line), so lengths add up to places."""
    read = F.substring(line, 1, WINDOW)
    part = lambda k: F.regexp_extract_all(read, F.lit(rf"(?sU)\G(.*?)({form})"), F.lit(k))
    alone = form.replace(r"(?!-\d)", "")  # a date by itself has nothing after it
    group = lambda hit, k: F.regexp_extract(hit, f"(?U){alone}", k)
    y, m, d = groups
    first = lambda hit: day_of(group(hit, y), month_number(group(hit, m)), F.lit("1") if d is None else group(hit, d))
    dates = F.zip_with(part(1), part(2), lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit"), first(hit).alias("lo")))
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("date").alias("lo"), F.lit(None).cast("string").alias("said"))

    def step(s: Column, p: Column) -> Column:
        at, size = s["at"] + p["gap"], F.length(p["hit"])
        stands = ((at <= LEAD) | heading) & (F.length(line) - size <= BESIDE) & s["lo"].isNull() & p["lo"].isNotNull()
        return F.struct((at + size).alias("at"), F.when(stands, p["lo"]).otherwise(s["lo"]).alias("lo"), F.when(stands, p["hit"]).otherwise(s["said"]).alias("said"))

    last = lambda s: F.struct(s["lo"].alias("lo"), (F.last_day(s["lo"]) if d is None else s["lo"]).alias("hi"), s["said"].alias("said"))
    return F.when(read.rlike(f"(?U){form}"), F.aggregate(dates, start, step, last))


def datelines(blocks: DataFrame, text: str = "text", heading: str = "heading") -> DataFrame:
    """Blocks with ``dateline``: struct<lo, hi, conf, said> of the date that heads each, null if none does.

    Only the first line counts, and there a date near its start (in a heading anywhere) with little beside it; days go before months.
    A day that no calendar has leaves its month. A year alone must be the whole text. A null text has none; a null heading is none.
    """
    names = [f"_form_{i}" for i in range(len(FORMS))]
    line = F.regexp_replace(F.regexp_extract(F.col(text), r"^[^\n]*", 0), r"(?U)^\s+|\s+$", "")
    rows = blocks.withColumn("_line", line)
    head = F.coalesce(F.col(heading), F.lit(False))
    rows = rows.withColumns({n: _found(F.col("_line"), head, form, groups) for n, (form, groups, _) in zip(names, FORMS, strict=True)})
    made = lambda lo, hi, conf, said: F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(conf).alias("conf"), said.alias("said"))
    said = [F.when(F.col(f"{n}.lo").isNotNull(), made(F.col(f"{n}.lo"), F.col(f"{n}.hi"), conf, F.col(f"{n}.said"))) for n, (*_, conf) in zip(names, FORMS, strict=True)]
    year = F.nullif(F.regexp_extract(F.col(text), BARE_YEAR, 1), F.lit(""))
    whole = F.when(year.isNotNull(), made(day_of(year, F.lit("1"), F.lit("1")), day_of(year, F.lit("12"), F.lit("31")), 0.7, year))
    return rows.withColumn("dateline", F.coalesce(*said, whole)).drop("_line", *names)


def violations(nodes: DataFrame, contents: DataFrame) -> DataFrame:
    """(content_id, path, problem) of dated nodes (content_id, path, lo, hi) that leave their parent's dates (``parent``) or their content's
    (``content``; content_id, lo, hi), or whose dates don't come back from their EDTF (``round trip``). Unknown bounds bind nothing."""
    nodes = nodes.select("content_id", "path", "lo", "hi").where("lo IS NOT NULL OR hi IS NOT NULL")
    over = nodes.select("content_id", F.col("path").alias("above"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    low = nodes.withColumn("above", F.regexp_extract("path", r"^(.*)\.[^.]*$", 1)).join(over, ["content_id", "above"])
    all_of = nodes.join(contents.select("content_id", F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi")), "content_id")
    leaves = ~E.contains(F.col("a_lo"), F.col("a_hi"), F.col("lo"), F.col("hi"))
    named = lambda df, what: df.select("content_id", "path", F.lit(what).alias("problem"))
    pair = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    back = F.get(F.transform(F.array(E.edtf_of(F.col("lo"), F.col("hi"))), lambda said: pair(*E.edtf_bounds(said))), F.lit(0))  # bound once by the lambda: inlined it would grow past what can be compiled
    turned = nodes.where(~back.eqNullSafe(pair(F.col("lo"), F.col("hi"))))
    return named(low.where(leaves), "parent").unionByName(named(all_of.where(leaves), "content")).unionByName(named(turned, "round trip"))


def _spanned(rows: DataFrame, keys: list[str], date: str, source: str, alias: str) -> DataFrame:
    """The envelope of dates by keys as struct<lo, hi, conf, source>, as sure as the least sure; null if their bounds contradict."""
    lo, hi = F.min(f"{date}.lo"), F.max(f"{date}.hi")
    made = F.struct(lo.alias("lo"), hi.alias("hi"), F.min(f"{date}.conf").alias("conf"), F.lit(source).alias("source"))
    return rows.groupBy(*keys).agg(F.when(F.coalesce(lo <= hi, F.lit(True)), made).alias(alias))


def _spans(live: DataFrame) -> DataFrame:
    """(content_id, path, span) of every container above the dated nodes ``live`` (content_id, path, own): the envelope of its dated children; null where
    they contradict. A container spans what its lowest dated descendants do, but for those below one that contradicts itself; the
    lowest such containers are settled first and taken out with all below them, so there is a round for each level of them, mostly one."""
    above = lambda df, own: df.withColumn("top", F.explode(E.ancestors(F.col("path"), own=own)))
    tops = lambda df: above(df, False).select("content_id", F.col("top").alias("path")).distinct()
    done = []
    while True:
        lowest = live.join(tops(live), ["content_id", "path"], "left_anti")
        spans = settled(_spanned(above(lowest, False), ["content_id", "top"], "own", "AGGREGATED", "span").withColumnRenamed("top", "path"), "spans")
        wrong = spans.where("span IS NULL")
        if not wrong.head(1):
            return functools.reduce(DataFrame.unionByName, [*done, spans])
        low = wrong.join(tops(wrong), ["content_id", "path"], "left_anti").select("content_id", F.col("path").alias("top"))
        under = lambda df, low=low: above(df, True).join(low, ["content_id", "top"], "left_semi").select("content_id", "path").distinct()
        done.append(spans.join(under(spans), ["content_id", "path"], "left_semi"))
        live = settled(live.join(under(live), ["content_id", "path"], "left_anti"), "live")


def dated(plan: DataFrame, on_pages: DataFrame, pages: DataFrame, priors: DataFrame, inferred: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (content_id, nid, path), pages (content_id, number) and contents (content_id), each with ``date``: struct<lo, hi, conf, source>.

    ``plan`` is of ``snapshot.planned``; on_pages (content_id, nid, page) says which pages a leaf is on, priors (content_id, hint, metadata)
    what is known of a content before, inferred (content_id, nid, lo, hi, conf) what a model made of a node. Datelines come first (EXPLICIT),
    then what was inferred; a page spans its datelines (AGGREGATED), pages between are INTERPOLATED; a container spans what is dated below
    it, a content its pages and topmost nodes, else it has its prior. The rest inherits, from its pages within the nearest dated
    ancestor, from that, or from a content with a prior. A container whose children contradict each other is undated as long as it doesn't inherit,
    and so adds nothing to what is above it. Nodes and their spans are written to the shared folder.

    A node's ancestors, at most as many as a path has segments, meet in one array; no other group is gathered.
    """
    key = ["content_id", "path"]
    heads = datelines(plan.where("leaf").withColumn("heading", F.col("tag").rlike("^h[1-6]$"))).select(*key, "dateline")
    said = F.when(F.col("dateline").isNotNull(), F.struct("dateline.lo", "dateline.hi", "dateline.conf", F.lit("EXPLICIT").alias("source")))
    guess = F.when(F.col("g.lo").isNotNull() | F.col("g.hi").isNotNull(), F.struct("g.lo", "g.hi", F.col("g.conf").cast("double").alias("conf"), F.lit("INFERRED").alias("source")))
    given = inferred.select("content_id", "nid", F.struct("lo", "hi", "conf").alias("g"))
    nodes = plan.select("content_id", "nid", "path", "depth", "leaf").join(heads, key, "left").join(given, ["content_id", "nid"], "left").withColumn("own", F.coalesce(said, guess))
    nodes = settled(nodes.drop("dateline", "g"), "dating")

    met = nodes.where("own.source = 'EXPLICIT'").join(on_pages, ["content_id", "nid"])
    anchors = _spanned(met, ["content_id", "page"], "own", "AGGREGATED", "seen").withColumnRenamed("page", "number")
    bounds = lambda c: F.get(F.transform(F.array(c), lambda said: F.struct(*(b.alias(n) for b, n in zip(E.edtf_bounds(said), ("lo", "hi"), strict=True)))), F.lit(0))  # noqa: E731  bound once, as above
    said_so = lambda c, conf, source: F.when(F.col(f"{c}.lo").isNotNull() | F.col(f"{c}.hi").isNotNull(), F.struct(f"{c}.lo", f"{c}.hi", F.lit(conf).alias("conf"), F.lit(source).alias("source")))
    known = priors.select("content_id", bounds(F.col("hint")).alias("h"), bounds(F.col("metadata")).alias("m")).select("content_id", F.coalesce(said_so("h", 0.5, "INFERRED"), said_so("m", 0.3, "METADATA")).alias("prior"))
    numbered = pages.select("content_id", "number").join(anchors, ["content_id", "number"], "left")
    between = D.interpolate(numbered.select("content_id", "number", "seen.lo", "seen.hi"), known.select("content_id", F.col("prior.lo").alias("prior_lo"), F.col("prior.hi").alias("prior_hi")))
    guessed = F.when(F.col("est_lo").isNotNull() | F.col("est_hi").isNotNull(), F.struct(F.col("est_lo").alias("lo"), F.col("est_hi").alias("hi"), F.col("conf").cast("double").alias("conf"), F.lit("INTERPOLATED").alias("source")))
    leaves = numbered.join(between, ["content_id", "number"]).select("content_id", "number", F.coalesce("seen", guessed).alias("date"))

    above = lambda df: df.withColumn("top", F.explode(E.ancestors(F.col("path"), own=False)))
    spans = _spans(nodes.where("own IS NOT NULL").select(*key, "own")).withColumn("spanned", F.lit(True))
    nodes = nodes.join(spans, key, "left").withColumn("own", F.when(F.col("spanned"), F.col("span")).otherwise(F.col("own"))).drop("span", "spanned")
    nodes = settled(nodes, "spanned")

    parts = nodes.where("depth = 0 AND own IS NOT NULL").select("content_id", F.col("own").alias("date")).unionByName(leaves.where("date IS NOT NULL").select("content_id", "date"))
    whole = plan.select("content_id").unionByName(pages.select("content_id")).distinct()
    whole = whole.join(_spanned(parts, ["content_id"], "date", "AGGREGATED", "span"), "content_id", "left").join(known, "content_id", "left").select("content_id", F.coalesce("span", "prior").alias("date"))

    down = lambda d, lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"), Y.inherited(d["conf"]).alias("conf"), F.lit("INHERITED").alias("source"))
    as_is = lambda d: down(d, d["lo"], d["hi"])
    fill = F.when(F.col("c.source").isin("INFERRED", "METADATA"), F.col("c"))
    full = leaves.join(whole.select("content_id", F.col("date").alias("c")), "content_id", "left").withColumn("fill", fill)
    full = full.select("content_id", "number", F.coalesce("date", F.when(F.col("fill").isNotNull(), as_is(F.col("fill")))).alias("date"))

    spots = on_pages.join(plan.select("content_id", "nid", "path"), ["content_id", "nid"]).withColumn("path", F.explode(E.ancestors(F.col("path")))).select(*key, F.col("page").alias("number")).distinct()
    drawn = _spanned(spots.join(full.where("date IS NOT NULL"), ["content_id", "number"]), key, "date", "AGGREGATED", "drawn")
    nodes = nodes.join(drawn, key, "left")
    chain = nodes.select("content_id", "nid", "path", F.explode(E.ancestors(F.col("path"))).alias("top")).join(nodes.select("content_id", F.col("path").alias("top"), "own", "drawn"), ["content_id", "top"])
    chain = chain.groupBy("content_id", "nid", "path").agg(F.array_sort(F.collect_list(F.struct("top", "own", "drawn"))).alias("chain"))
    chain = chain.join(whole.select("content_id", F.col("date").alias("c")), "content_id", "left").withColumn("fill", fill)

    def step(near: Column, x: Column) -> Column:
        lo, hi = E.intersect(x["drawn"]["lo"], x["drawn"]["hi"], near["lo"], near["hi"])
        meets = lo.isNotNull() | hi.isNotNull()
        narrowed = down(x["drawn"], F.when(meets, lo).otherwise(near["lo"]), F.when(meets, hi).otherwise(near["hi"]))
        return F.when(x["own"].isNotNull(), x["own"]).when(x["drawn"].isNotNull() & near.isNotNull(), narrowed).when(x["drawn"].isNotNull(), as_is(x["drawn"])).when(near.isNotNull(), as_is(near)).when(F.col("fill").isNotNull(), as_is(F.col("fill")))

    none = F.lit(None).cast("struct<lo:date,hi:date,conf:double,source:string>")
    return chain.select("content_id", "nid", "path", F.aggregate("chain", none, step).alias("date")), full, whole
