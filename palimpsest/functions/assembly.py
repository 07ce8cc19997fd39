"""Column expressions for putting a document together from read pages, and for its exports. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import expressions as E

#: Block kinds of which a page's last may go on in the next page's first, and how a finished block ends.
JOINABLE = ("p", "li", "figcaption", "blockquote", "pre", "table")
FINAL = (".", "!", "?", ":", ";", "”", "\"", "»", ")")


def strip_fence(text: Column) -> Column:
    """What stands within a Markdown code fence around the whole text; other texts as they are, but trimmed."""
    inner = F.regexp_extract(text, r"(?s)^\s*```[a-zA-Z]*\s*\n?(.*?)\s*```\s*$", 1)
    return F.when(text.rlike(r"(?s)^\s*```.*```\s*$"), inner).otherwise(F.trim(text))


def model_box(box: Column, scale: float = 1000.0) -> Column:
    """``ymin,xmin,ymax,xmax`` in thousandths as struct<x0, y0, x1, y1> from 0 to 1, sides in order; blanks part numbers as
    commas do; null unless it is four numbers."""
    parts = F.transform(F.filter(F.split(box, "[, ]"), lambda v: F.trim(v) != ""), lambda v: F.trim(v).try_cast("double") / scale)
    side = lambda k: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.get(parts, F.lit(k))))
    fine = (F.size(parts) == 4) & F.forall(parts, lambda v: v.isNotNull() & ~F.isnan(v))
    made = F.struct(F.least(side(1), side(3)).alias("x0"), F.least(side(0), side(2)).alias("y0"), F.greatest(side(1), side(3)).alias("x1"), F.greatest(side(0), side(2)).alias("y1"))
    return F.when(fine, made)


def box_attribute(box: Column) -> Column:
    """A box as four numbers of four decimals; null stays null."""
    return F.when(box.isNotNull(), F.format_string("%.4f,%.4f,%.4f,%.4f", box["x0"], box["y0"], box["x1"], box["y1"]))


def noise(kind: Column, text: Column) -> Column:
    """Up to four characters without a letter or digit; tables and figures never are."""
    flat = E.collapse(F.coalesce(text, F.lit("")))
    return ~kind.isin("table", "figure") & (F.length(flat) <= 4) & ~flat.rlike(r"[\p{L}\p{N}]")


def compatible(tail_kind: Column, head_kind: Column, merge_tables: bool = True) -> Column:
    """Whether a block of a kind may go on from one of another: kinds alike among JOINABLE, tables only where they are merged."""
    fine = (tail_kind == head_kind) & tail_kind.isin(*JOINABLE)
    return F.coalesce(fine if merge_tables else fine & (head_kind != "table"), F.lit(False))


def continued(tail_kind: Column, tail: Column, head_kind: Column, head: Column) -> Column:
    """Whether a page's first block seems to go on from the last block of the page before: kinds alike; then a tail in ``-``
    does, one that is finished doesn't, else a head that begins in lower case or with a digit does.
    A null never does, nor does a blank tail or head, nor a table."""
    flat = lambda c, p: F.regexp_replace(c, p, "")
    last, first = F.substring(flat(tail, r"(?U)\s+$"), -1, 1), F.substring(flat(head, r"(?U)^\s+"), 1, 1)
    looks = F.when(last.isNull() | (last == "") | first.isNull() | (first == ""), False).when(last == "-", True).when(last.isin(*FINAL), False).otherwise(first.rlike(r"^[\p{Ll}\p{N}]"))
    return F.coalesce(compatible(tail_kind, head_kind, merge_tables=False) & looks, F.lit(False))


def appended(tail: Column, head: Column) -> Column:
    """A block and its continuation: a hyphen at the end goes, else a space comes between."""
    return F.when(tail.endswith("-"), F.concat(F.substring(tail, F.lit(1), F.length(tail) - 1), head)).otherwise(F.concat(tail, F.lit(" "), head))


def prior(hint: Column, metadata: Column) -> Column:
    """What a document's date is before it is read: its hint (0.5, INFERRED), else its metadata (0.3, METADATA); strings that aren't dates are passed over."""
    def said(edtf: Column, conf: float, origin: str) -> Column:
        lo, hi = E.edtf_bounds(edtf)
        return F.when(lo.isNotNull() | hi.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(conf).alias("conf"), F.lit(origin).alias("origin")))

    return F.coalesce(said(hint, 0.5, "INFERRED"), said(metadata, 0.3, "METADATA"))


def model_date(edtf: Column, conf: Column) -> Column:
    """A date that a model read: null if it isn't one; its confidence within 0 to 1, and 0.5 if it gave none."""
    lo, hi = E.edtf_bounds(edtf)
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), conf))
    return F.when(lo.isNotNull() | hi.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi"), F.when(conf.isNull(), 0.5).otherwise(sure).alias("conf")))


def csv_row(cells: Sequence[Column]) -> Column:
    """Cells as one row of a CSV file: quoted where they hold a comma, a quote or a line end; null is empty."""
    def cell(c: Column) -> Column:
        c = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(c.rlike("[,\"\r\n]"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    return F.concat_ws(",", *map(cell, cells))


def redacted(headers: Column, secret: Sequence[str]) -> Column:
    """A map of headers with the values of the named ones (in any case) hidden."""
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin([s.lower() for s in secret]), "[redacted]").otherwise(v))
