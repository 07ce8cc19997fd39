"""Sources: OCR tables, stored page payloads, text decoding, and fuzzy scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a word comes after; what a character gains in a run and at a word's start, and a term as the text's prefix or within it.
WORD_START = "_-. "
RUN, START, PREFIX, INSIDE = 8, 4, 40, 20


def decode(content: bytes) -> str:
    """UTF-8 without a byte-order mark, else Latin-1."""
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def ocr_words(lines: DataFrame, *keep: str) -> DataFrame:
    """Words of an OCR table given as text lines (column value; ``keep`` names others to carry): level 5, not blank; malformed rows are skipped."""
    num = lambda c, i: F.get(c, F.lit(i)).try_cast("double")
    whole = lambda c: (F.size(c) >= 12) & (F.get(c, F.lit(0)) == "5") & (F.trim(F.get(c, F.lit(11))) != "") & num(c, 6).isNotNull() & num(c, 9).isNotNull() & num(c, 10).isNotNull()
    cells = F.get(F.filter(F.array(F.split("value", "\t")), whole), F.lit(0))  # split once, for all that asks
    c, conf = F.col("cells"), num(F.col("cells"), 10)
    rows = lines.select(*keep, cells.alias("cells")).where("cells IS NOT NULL")
    names = {"page": 1, "block": 2, "par": 3, "line": 4, "word": 5, "left": 6, "top": 7, "width": 8, "height": 9}
    return rows.select(*keep, *(num(c, i).alias(n) for n, i in names.items()), F.when(conf >= 0, conf / 100).alias("conf"), F.trim(F.get(c, F.lit(11))).alias("text"))


def ocr_paragraphs(words: DataFrame, width: float, height: float) -> DataFrame:
    """Words joined by (page, block, par), with the box they span as shares of the page, their mean confidence, and the words:
    array<struct<x0, y0, x1, y1, start, end, conf>>, offsets being those in the joined text."""
    words = words.withColumnRenamed("text", "said").withColumnRenamed("conf", "sure")
    shown = F.array_sort(F.collect_list(F.struct("line", "word", "said", "left", "top", "width", "height", "sure")))
    text = F.array_join(F.transform(shown, lambda w: w["said"]), " ")
    start = lambda i: F.aggregate(F.slice(shown, 1, i), F.lit(0), lambda s, w: s + F.length(w["said"]) + 1)
    made = lambda w, i: F.struct(
        (w["left"] / width).alias("x0"), (w["top"] / height).alias("y0"), ((w["left"] + w["width"]) / width).alias("x1"), ((w["top"] + w["height"]) / height).alias("y1"),
        start(i).alias("start"), (start(i) + F.length(w["said"])).alias("end"), w["sure"].alias("conf"),
    )
    box = {"x0": F.min("left") / width, "y0": F.min("top") / height, "x1": F.max(F.col("left") + F.col("width")) / width, "y1": F.max(F.col("top") + F.col("height")) / height}
    return words.groupBy("page", "block", "par").agg(text.alias("text"), *(v.alias(k) for k, v in box.items()), F.avg("sure").alias("conf"), F.transform(shown, made).alias("words"))


def stored_pages(payload: DataFrame) -> DataFrame:
    """Pages of stored raw payloads (content_id, raw): number, size, html, and whether it failed."""
    schema = "pages array<struct<number:int,width:double,height:double,html:string,failed:boolean,error:string>>"
    rows = payload.select("content_id", F.explode(F.from_json("raw", schema)["pages"]).alias("p"))
    return rows.select("content_id", "p.number", "p.width", "p.height", "p.html", F.coalesce("p.failed", F.lit(False)).alias("failed"), "p.error")


def fuzzy_score(term: str, text: Column) -> Column:
    """Subsequence score of one term in a text, each character at its first place after the one before: runs and word starts gain, what is skipped
    loses; a prefix or substring gains more. Null where it isn't found; an empty term scores 0."""
    term, low = term.strip().lower(), F.lower(F.coalesce(text, F.lit("")))
    if not term:
        return F.lit(0)

    def step(acc: Column, char: Column) -> Column:
        at = F.position(char, low, acc["next"])
        skipped = at - acc["next"]
        begins = (at == 1) | F.substring(low, at - 1, F.lit(1)).isin(*WORD_START)
        gain = F.when((skipped == 0) & (acc["next"] > 1), RUN).otherwise(0) + F.when(begins, START).otherwise(0) - skipped
        return F.struct((at + 1).alias("next"), F.when(at > 0, acc["score"] + gain).alias("score"))

    walked = F.aggregate(F.array(*map(F.lit, term)), F.struct(F.lit(1).alias("next"), F.lit(0).alias("score")), step)
    return walked["score"] + F.when(F.startswith(low, F.lit(term)), PREFIX).when(F.contains(low, F.lit(term)), INSIDE).otherwise(0)


#: What a hit in a description loses against one in a name.
HELP_PENALTY = 30


def fuzzy(df: DataFrame, column: str, query: str, help_column: str | None = None) -> DataFrame:
    """Rows in which every term of the query is found as a subsequence of the column, or with ``help_column`` of that for
    HELP_PENALTY less, with the better sum of their scores. A blank query finds all rows, with 0."""
    terms = query.split()
    total = lambda c: sum((fuzzy_score(t, F.col(c)) for t in terms), F.lit(0))  # noqa: E731  null where one term is missing
    score = total(column) if help_column is None or not terms else F.greatest(total(column), total(help_column) - HELP_PENALTY)
    return df.withColumn("score", score).where("score IS NOT NULL")


def ranked(found: DataFrame, key: str, recent: DataFrame, position: str) -> DataFrame:
    """What fuzzy() found, best first; of equal scores the most recently used (``recent``: key, recency from 0), then by position."""
    return found.join(F.broadcast(recent.select(key, "recency")), key, "left").orderBy(F.desc("score"), F.asc_nulls_last("recency"), position)
