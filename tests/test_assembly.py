"""Putting documents together: expressions on literal fixtures."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import assembly as A


@pytest.fixture
def one(spark):
    return lambda c: spark.range(1).select(c.alias("x")).first().x


def test_boxes(one):
    for said in ("900, 100,200,1200", "900 100 200  1200"):
        assert tuple(one(A.model_box(F.lit(said)))) == (0.1, 0.2, 1.0, 0.9)
    for bad in ("1,2,3", "a,1,2,3", "", "1,2,3,4,5"):
        assert one(A.model_box(F.lit(bad))) is None
    assert one(A.box_attribute(A.model_box(F.lit("0,0,500,1000")))) == "0.0000,0.0000,1.0000,0.5000"
    assert one(A.box_attribute(A.model_box(F.lit(None).cast("string")))) is None


def test_fence_and_noise(one):
    assert one(A.strip_fence(F.lit("```html\n<p>x</p>\n```"))) == "<p>x</p>" and one(A.strip_fence(F.lit(" <p>x</p> "))) == "<p>x</p>"
    cases = [("p", "~ .", True), ("p", "a", False), ("p", "— — —", False), ("table", "", False), ("p", None, True), ("p", "12", False)]
    assert [one(A.noise(F.lit(k), F.lit(t).cast("string"))) for k, t, _ in cases] == [x for *_, x in cases]


def test_continued(one):
    cases = [("p", "word-", "p", "Next", True), ("p", "done.", "p", "next", False), ("p", "and", "p", "then", True), ("p", "and", "p", "Then", False), ("p", "in", "p", "1943", True), ("p", "and", "li", "then", False), ("h2", "and", "h2", "then", False), ("p", None, "p", "then", False), ("table", "a", "table", "b", False), ("p", "word-", "p", " ", False), ("p", "word-\n", "p", "Next", True)]
    assert [one(A.continued(F.lit(a), F.lit(t).cast("string"), F.lit(b), F.lit(h))) for a, t, b, h, _ in cases] == [x for *_, x in cases]
    assert one(A.appended(F.lit("hy-"), F.lit("phen"))) == "hyphen" and one(A.appended(F.lit("two"), F.lit("words"))) == "two words"


def test_prior_and_model_dates(one):
    said = lambda h, m: one(A.prior(F.lit(h).cast("string"), F.lit(m).cast("string")))
    assert (said("1943", "1950").conf, said("nope", "1950").origin, said(None, None)) == (0.5, "METADATA", None)
    got = lambda e, c: one(A.model_date(F.lit(e), F.lit(c).cast("double")))
    assert (got("1943", 7.0).conf, got("1943", -1.0).conf, got("1943", None).conf, got("x", 0.9)) == (1.0, 0.0, 0.5, None)


def test_exports(one):
    assert one(A.csv_row([F.lit(1), F.lit('say "x"'), F.lit("a,b"), F.lit(None).cast("string"), F.lit("l\nm")])) == '1,"say ""x""","a,b",,"l\nm"'
    assert one(A.redacted(F.create_map(F.lit("Cookie"), F.lit("s"), F.lit("Host"), F.lit("h")), ["cookie"])) == {"Cookie": "[redacted]", "Host": "h"}
