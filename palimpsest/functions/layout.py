"""Column expressions for text runs on pages: boxes, bullets, kinds of blocks, and dates shown as text. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Glyphs that begin a list item, and how much larger than the body's a heading's and a decoration's text is.
BULLETS = ("•", "◦", "▪", "‣", "–", "-", "*")
HEADING, TITLE, DECORATION, HEADING_WORDS = 1.12, 1.5, 2.5, 9


def flipped_box(x: Column, baseline: Column, width: Column, size: Column, page_w: Column, page_h: Column) -> Column:
    """A run's box from the lower left corner's coordinates as struct<x0, y0, x1, y1> from 0 to 1, y down; null on a page without extent."""
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    x0, x1 = unit(x / page_w), unit((x + width) / page_w)
    y0, y1 = unit(1 - (baseline + 0.8 * size) / page_h), unit(1 - (baseline - 0.2 * size) / page_h)
    made = F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"))
    return F.when((page_w > 0) & (page_h > 0), made)


def bullet(text: Column) -> Column:
    """The glyph or number (up to four characters with a point or bracket) that a line starts with; null if none."""
    flat = F.ltrim(text)
    found = F.coalesce(*(F.when(flat.startswith(f"{b} "), F.lit(b)) for b in BULLETS), F.nullif(F.regexp_extract(flat, r"^(\d{1,3}[.)])(?: |$)", 1), F.lit("")))
    return found


def block_kind(lines: Column, size: Column, bold: Column, words: Column, body: Column, item: Column) -> Column:
    """li, h2, h3 or p of a block by its number of lines and its first line."""
    heads = (lines == 1) & ((size >= HEADING * body) | (bold & (words <= HEADING_WORDS)))
    return F.when(item, "li").when(heads & (size >= TITLE * body), "h2").when(heads, "h3").otherwise("p")


def decoration(lines: Column, text: Column, size: Column, body: Column) -> Column:
    """A lone glyph much larger than the body's text."""
    return (lines == 1) & (F.length(F.trim(text)) <= 1) & (size > DECORATION * body)


def joined_lines(lines: Column) -> Column:
    """Lines of a block by line ends; a hyphen at a line's end goes with it."""
    return F.aggregate(lines, F.lit(None).cast("string"), lambda s, x: F.when(s.isNull(), x).when(s.endswith("-"), F.concat(F.substring(s, F.lit(1), F.length(s) - 1), x)).otherwise(F.concat(s, F.lit("\n"), x)))


def nested(blocks: DataFrame) -> DataFrame:
    """Blocks (content_id, pos, level; null level for what isn't a heading) with ``parent``, the heading whose section each lies in: the
    nearest earlier one, for a heading the nearest of a smaller level. Six running maxima, no join."""
    back = Window.partitionBy("content_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == k, F.col("pos"))).over(back) for k in range(1, 7)]
    # a heading of level k is closed by a later one of level k or less
    rows = blocks.withColumns({f"last_{k}": c for k, c in enumerate(last, 1)})
    near = lambda top: F.greatest(*(F.coalesce(f"last_{k}", F.lit(-1)) for k in range(1, top + 1)), F.lit(-1))
    parent = F.when(F.col("level").isNull(), near(6))
    for k in range(1, 7):
        parent = parent.when(F.col("level") == k, near(k - 1) if k > 1 else F.lit(-1))
    return rows.withColumn("parent", F.nullif(parent, F.lit(-1))).drop(*(f"last_{k}" for k in range(1, 7)))


def split_blocks(lines: DataFrame) -> DataFrame:
    """Lines (page, pos, y, size, bold, text) with the number of their block: a new one starts after a gap of over 1.55 leadings or
    back up the page, where the size jumps by over 15 %, where boldness changes, or at a bullet. ``leading`` is the page's median gap."""
    w = Window.partitionBy("page").orderBy("pos")
    rows = lines.withColumns({"gap": F.lag("y").over(w) - F.col("y"), "before": F.lag(F.struct("size", "bold")).over(w)})
    rows = rows.withColumn("leading", F.median(F.when(F.col("gap") > 0, F.col("gap"))).over(Window.partitionBy("page")))
    jump = F.abs(F.col("size") - F.col("before.size")) > 0.15 * F.col("before.size")
    new = F.col("before").isNull() | (F.col("gap") > 1.55 * F.col("leading")) | (F.col("gap") < 0) | jump | (F.col("bold") != F.col("before.bold")) | bullet(F.col("text")).isNotNull()
    return rows.withColumn("block", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("gap", "before", "leading")


def shown_date(lo: Column, hi: Column) -> Column:
    """A period as text: one day, from and to with a dash, or open on a side."""
    day = lambda d: F.date_format(d, "dd.MM.yyyy")
    return F.when(lo == hi, day(lo)).when(lo.isNull() & hi.isNotNull(), F.concat(F.lit("until "), day(hi))).when(hi.isNull() & lo.isNotNull(), F.concat(F.lit("from "), day(lo))).otherwise(F.concat(day(lo), F.lit("–"), day(hi)))


def inherited(conf: Column) -> Column:
    """What is left of a confidence from 0 to 1 one step down: nine tenths as a double, rounded to two places by its exact value (so 0.95 gives
    0.85), a tie to the even side."""
    return hundredths(conf * 0.9)


def hundredths(value: Column) -> Column:
    """A double from 0 to 1 rounded to two places by its exact value, a tie to the even side."""
    # the double is a whole number of 2**-60, unless it is under 2**-8, where what is cut off decides nothing
    whole = F.lit(2**61).cast("decimal(20,0)")
    parts = (value * 2.0**60).cast("long").cast("decimal(30,0)") * 200 + 2**60
    step = ((parts - parts % whole) / whole).cast("long")
    step = F.when((parts % whole == 0) & (step % 2 == 1), step - 1).otherwise(step)
    return step / 100


#: Months as they are shown.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def period(lo: Column, hi: Column) -> Column:
    """An uncertain date for a reader: a day, month, year or decade by its name, else from and to, as short as both allow; open on a side, or undated."""
    month = lambda d: F.element_at(F.array(*map(F.lit, MONTHS)), F.month(d))
    year = lambda d: F.year(d).cast("string")
    day = lambda d: F.dayofmonth(d).cast("string")
    short = lambda d: F.concat(month(d), F.lit(" "), day(d))
    long = lambda d: F.concat(short(d), F.lit(", "), year(d))
    opens = (F.dayofmonth(lo) == 1) & (F.month(lo) == 1) & (F.dayofmonth(hi) == 31) & (F.month(hi) == 12)
    same = F.year(lo) == F.year(hi)
    return (
        F.when(lo.isNull() & hi.isNull(), "undated").when(lo.isNull(), F.concat(F.lit("on or before "), long(hi))).when(hi.isNull(), F.concat(F.lit("on or after "), long(lo)))
        .when(lo == hi, long(lo)).when((F.dayofmonth(lo) == 1) & (hi == F.last_day(lo)), F.concat(month(lo), F.lit(" "), year(lo)))
        .when(opens & same, year(lo)).when(opens & (F.year(lo) % 10 == 0) & (F.year(hi) == F.year(lo) + 9), F.concat(year(lo), F.lit("s")))
        .when(same & (F.month(lo) == F.month(hi)), F.concat(short(lo), F.lit("–"), day(hi), F.lit(", "), year(lo)))
        .when(same, F.concat(short(lo), F.lit(" – "), short(hi), F.lit(", "), year(lo))).otherwise(F.concat(long(lo), F.lit(" – "), long(hi)))
    )


def estimate(lo: Column, hi: Column, source: Column, conf: Column) -> Column:
    """``period`` with how it is known and, unless null, how surely."""
    sure = F.when(conf.isNull(), "").otherwise(F.concat(F.lit(", "), F.format_string("%.2f", hundredths(conf))))
    return F.concat(period(lo, hi), F.lit(" ("), source, sure, F.lit(")"))


def created_day(stamp: Column) -> Column:
    """The day of a file's creation stamp, null if it isn't one."""
    return F.try_to_date(F.substring(stamp, 1, 10), "yyyy-MM-dd")
