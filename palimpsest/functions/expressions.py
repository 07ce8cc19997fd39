"""Column expressions: uncertain dates, confidence sketches, geometry, text and paths. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- uncertain dates (EDTF level 0/1 with intervals)


def _bound(part: Column, last: bool) -> Column:
    """First or last day of one side of an EDTF string; null if it isn't a date, or open (``..``)."""
    p = F.regexp_replace(part, "[?~%]", "")
    y = F.regexp_extract(p, r"^(\d{4})(?:-(?:\d\d|XX)(?:-(?:\d\d|XX))?)?$", 1)
    full, month = p.rlike(r"^\d{4}-\d\d-\d\d$"), p.rlike(r"^\d{4}-\d\d(-XX)?$")
    year, decade, century = p.rlike(r"^\d{4}(-XX(-XX)?)?$"), p.rlike(r"^\d{3}X$"), p.rlike(r"^\d{2}XX$")
    day = lambda s: F.try_to_date(s, "yyyy-MM-dd")
    first = (
        F.when(full, day(p)).when(month, day(F.concat(F.substring(p, 1, 7), F.lit("-01")))).when(year, day(F.concat(y, F.lit("-01-01"))))
        .when(decade, day(F.concat(F.substring(p, 1, 3), F.lit("0-01-01")))).when(century, day(F.concat(F.substring(p, 1, 2), F.lit("00-01-01"))))
    )
    if not last:
        return F.when(F.year(first) >= 1, first)
    end = (
        F.when(full, first).when(month, F.last_day(first)).when(year, day(F.concat(y, F.lit("-12-31"))))
        .when(decade, day(F.concat(F.substring(p, 1, 3), F.lit("9-12-31")))).when(century, day(F.concat(F.substring(p, 1, 2), F.lit("99-12-31"))))
    )
    return F.when(F.year(first) >= 1, end)


def edtf_bounds(edtf: Column) -> tuple[Column, Column]:
    """(min, max) of an EDTF string. Blank, over 64 characters, with a time, without any bound, inverted or unreadable: both null."""
    parts = F.split(edtf, "/")
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.size(parts) - 1)
    two = F.size(parts) == 2
    lo, hi = _bound(a, False), _bound(b, True)
    fine = (F.length(edtf) <= 64) & ~edtf.contains("T") & (F.size(parts) <= 2)
    fine &= F.when(two, (lo.isNotNull() | (a == "..")) & (hi.isNotNull() | (b == "..")) & (lo.isNotNull() | hi.isNotNull())).otherwise(lo.isNotNull())
    fine &= F.coalesce(lo <= hi, F.lit(True))
    return F.when(fine, lo), F.when(fine, hi)


def edtf_of(lo: Column, hi: Column) -> Column:
    """The shortest EDTF for bounds: day, month, year, decade, else an interval; null if both are unknown."""
    text = lambda d: F.date_format(d, "yyyy-MM-dd")
    side = (
        lambda d, other: F.when(d.isNull(), "..").otherwise(text(d))
    )
    month = (F.dayofmonth(lo) == 1) & (hi == F.last_day(lo))
    year = (F.date_format(lo, "MM-dd") == "01-01") & (hi == F.add_months(lo, 12) - F.expr("INTERVAL 1 DAY"))
    decade = (F.date_format(lo, "MM-dd") == "01-01") & (F.year(lo) % 10 == 0) & (F.year(hi) == F.year(lo) + 9) & (F.date_format(hi, "MM-dd") == "12-31")
    return (
        F.when(lo.isNull() & hi.isNull(), F.lit(None).cast("string")).when(lo == hi, text(lo)).when(F.coalesce(month, F.lit(False)), F.date_format(lo, "yyyy-MM"))
        .when(F.coalesce(year, F.lit(False)), F.date_format(lo, "yyyy")).when(F.coalesce(decade, F.lit(False)), F.concat(F.substring(F.date_format(lo, "yyyy"), 1, 3), F.lit("X")))
        .otherwise(F.concat(side(lo, hi), F.lit("/"), side(hi, lo)))
    )


def overlaps(lo: Column, hi: Column, start, end) -> Column:
    """A null bound is open here; rows with neither bound never overlap. A null start or end drops its clause."""
    out = lo.isNotNull() | hi.isNotNull()
    if end is not None:
        out &= lo.isNull() | (lo <= end)
    if start is not None:
        out &= hi.isNull() | (hi >= start)
    return out


def contains(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> Column:
    """A null bound is unknown here, and constrains nothing."""
    return F.coalesce(other_lo >= lo, F.lit(True)) & F.coalesce(other_hi <= hi, F.lit(True))


def intersect(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> tuple[Column, Column]:
    a, b = F.greatest(lo, other_lo), F.least(hi, other_hi)
    fine = F.coalesce(a <= b, F.lit(True))
    return F.when(fine, a), F.when(fine, b)


def noon(at: Column, precision: Column) -> Column:
    """A moment at its precision: the whole time as it is; a day, month or year as noon of its first day."""
    at_noon = lambda unit: F.date_trunc(unit, at) + F.expr("INTERVAL 12 HOURS")
    return F.when(precision == "day", at_noon("day")).when(precision == "month", at_noon("month")).when(precision == "year", at_noon("year")).otherwise(at)


# --- confidence sketches: n, sum, min, max and ten buckets, all of which merge by partial aggregation


def bucket(conf: Column) -> Column:
    return F.when(conf.isNotNull(), F.least(F.lit(9), F.greatest(F.lit(0), F.floor(conf * 10).cast("int"))))  # greatest would skip a null


def conf_stats(conf: Column) -> Column:
    """Aggregate: the sketch of known confidences, null if none is known."""
    hist = F.array(*(F.count_if(bucket(conf) == i) for i in range(10)))
    made = F.struct(F.count(conf).alias("n"), F.sum(conf).alias("sum"), F.min(conf).alias("min"), F.max(conf).alias("max"), hist.alias("hist"))
    return F.when(F.count(conf) > 0, made)


def conf_merge(stats: Column) -> Column:
    """Aggregate: the sketch of all that went into some sketches; nulls add nothing."""
    hist = F.array(*(F.sum(stats["hist"][i]) for i in range(10)))
    made = F.struct(F.sum(stats["n"]).alias("n"), F.sum(stats["sum"]).alias("sum"), F.min(stats["min"]).alias("min"), F.max(stats["max"]).alias("max"), hist.alias("hist"))
    return F.when(F.count(stats) > 0, made)


# --- geometry: rings are arrays of struct<x, y>, closed implicitly


def _edges(ring: Column) -> Column:
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))


def point_in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd ray casting with half-open edges."""
    slope = lambda e: (e["bx"] - e["ax"]) * (y - e["ay"]) / F.when(e["by"] != e["ay"], e["by"] - e["ay"]).otherwise(1.0) + e["ax"]
    cross = lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < slope(e))
    return F.aggregate(_edges(ring), F.lit(False), lambda odd, e: odd != cross(e))


def ring_area(ring: Column) -> Column:
    return F.abs(F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["ax"] * e["by"] - e["bx"] * e["ay"])) / 2


def ring_box(ring: Column) -> Column:
    side = lambda c: F.transform(ring, lambda p: p[c])
    return F.struct(F.array_min(side("x")).alias("x0"), F.array_min(side("y")).alias("y0"), F.array_max(side("x")).alias("x1"), F.array_max(side("y")).alias("y1"))


# --- text


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def html_title(html: Column) -> Column:
    """The plain title of a page: what its first <title> holds, the three escapes that every page needs undone, on one line; empty without one, null for a null page."""
    text = F.regexp_extract(html, "<title>([^<]*)</title>", 1)
    for escape, sign in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(escape), F.lit(sign))
    return F.regexp_replace(F.regexp_replace(text, r"[ \t\n\f\r]+", " "), r"\A\p{Zs}+|\p{Zs}+\z", "")


def excerpt(text: Column, most: int = 120) -> Column:
    flat = collapse(text)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("…")))


def truncate(value: Column, most: int = 120) -> Column:
    return F.when(value.isNull(), "—").when(F.length(value) > most, F.concat(F.substring(value, 1, most), F.lit("…"))).otherwise(value)


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, each line and block trimmed, empty ones dropped."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    lines = lambda b: F.array_join(F.transform(F.split(b, "\n"), strip), "\n")
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    return F.filter(F.transform(F.split(flat, "\n\n"), lambda b: strip(lines(b))), lambda b: b != "")


def row_count(text: Column, header: Column) -> Column:
    """Data rows of a delimited file: line ends, and one more for a last line without one, less the header; blank lines count."""
    ends = F.length(F.regexp_replace(text, r"[^\n]", ""))
    lines = ends + F.when((F.length(text) > 0) & ~text.endswith("\n"), 1).otherwise(0)
    return F.greatest(F.lit(0), lines - F.when(header, 1).otherwise(0))


def page_range(spec: Column, total: Column) -> Column:
    """``1-5,8`` as sorted distinct page numbers within 1 to total; blank means all, and a range that falls has none."""
    side = lambda p, k: F.get(F.split(p, "-"), k).cast("int")
    last = lambda p: side(p, F.size(F.split(p, "-")) - 1)
    piece = lambda p: F.when(side(p, F.lit(0)) <= last(p), F.sequence(side(p, F.lit(0)), F.greatest(last(p), side(p, F.lit(0))))).otherwise(F.array().cast("array<int>"))
    given = F.flatten(F.transform(F.filter(F.transform(F.split(spec, ","), lambda v: F.trim(v)), lambda p: p.rlike(r"^\d+(-\d+)?$")), piece))
    whole = F.when(total >= 1, F.sequence(F.lit(1), F.greatest(total, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.when(F.trim(spec) == "", whole).otherwise(F.array_sort(F.array_distinct(F.filter(given, lambda n: (n >= 1) & (n <= total)))))


def csv_list(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, ","), lambda v: F.trim(v)), lambda v: v != "")


def csv_tags(value: Column) -> Column:
    """Trimmed, one of each spelling that differs in case alone (the first), in order of the lower-cased text, joined by comma and space."""
    tags = csv_list(value)
    low = F.transform(tags, lambda v: F.lower(v))
    first = F.filter(tags, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)
    return F.array_join(F.array_sort(first, lambda a, b: F.when(F.lower(a) < F.lower(b), -1).when(F.lower(a) > F.lower(b), 1).otherwise(0)), ", ")


def human_size(n: Column) -> Column:
    """Bytes in steps of 1024 with one decimal."""
    out = F.format_string("%d B", n)
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**k, F.format_string(f"%.1f {unit}", n / float(1024**k))).otherwise(out)
    return out


def ratio(a: Column, b: Column) -> Column:
    """Twice the characters in common over all characters (multisets); 1 when both are empty."""
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    times = lambda whole, x: F.size(F.filter(whole, lambda y: y == x))
    ca, cb = chars(a), chars(b)
    common = F.aggregate(F.array_intersect(ca, cb), F.lit(0), lambda s, x: s + F.least(times(ca, x), times(cb, x)))
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * common / total)


# --- materialised paths: four-digit segments joined by dots


def depth(path: Column) -> Column:
    return F.size(F.split(path, r"\.")) - 1


def ancestors(path: Column, own: bool = True) -> Column:
    """Paths from the root to the node (itself last, if ``own``)."""
    parts = F.split(path, r"\.")
    n = F.size(parts) if own else F.size(parts) - 1
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), ".")))


def in_subtree(path: Column, top: Column) -> Column:
    """With the separator, so that 1000 isn't above 10000."""
    return (path == top) | path.startswith(F.concat(top, F.lit(".")))
