"""Pages in files: what is read back, what a filter leaves unopened, and what becomes of pages that can't be read."""

import json
import random

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from palimpsest.sources import paged


@pytest.fixture(scope="module")
def stored(tmp_path_factory):
    """Payloads of random pages, five pages a file, and all pages as they should be read."""
    root, r, want = tmp_path_factory.mktemp("pages"), random.Random(3), {}
    for content in range(6):
        for first in range(1, 1 + 5 * r.randint(1, 4), 5):
            pages = []
            for n in range(first, first + 5):
                if r.random() < 0.2:
                    pages.append({"number": n, "failed": True, "error": "no text", "runs": [["lost", 1, 1, 1]]})
                    want[content, n] = None
                    continue
                runs = [[f"w{k} é", 10.5 * k, -2.0, "9"] + [["Bold"], [None], []][k % 3] for k in range(r.randint(0, 6))]
                want[content, n] = [(x[0], float(x[1]), x[2], 9.0, (x[4] or "") if len(x) > 4 else "") for x in runs]
                pages.append({"number": n, "width": 600, "height": None, "runs": [*runs, ["short"], ["a", "b", "c", "d"], None, [1, 2, 3, 4, 5, 6], [None, 1, 1, 1]]})
            at = root / f"content_id={content}" / f"first={first}" / f"last={first + 4}"
            at.mkdir(parents=True)
            (at / "part-0.txt").write_text(json.dumps({"pages": pages}) + "\n")
    broken = root / "content_id=9" / "first=1" / "last=3"
    broken.mkdir(parents=True)
    (broken / "part-0.txt").write_text('{"pages": [')
    (root / "_SUCCESS").write_text("")
    (root / "notes.txt").write_text("not a payload")
    want |= {(9, n): None for n in (1, 2, 3)}
    return str(root), want


def plain(rows):
    return {(x.content_id, x.number): None if x.failed else [tuple(run) for run in x.runs] for x in rows}


def test_pages_read_back(spark, stored):
    root, want = stored
    rows = paged.read(spark, "stored_runs", root).collect()
    assert len(rows) == len(want) and plain(rows) == want
    assert {x.error for x in rows if x.content_id == 9} == {"unreadable payload: JSONDecodeError"}
    for first, last in ((3, 7), (6, None), (None, 2), (400, 500)):
        got = paged.read(spark, "stored_runs", root, first, last).collect()
        assert plain(got) == {k: v for k, v in want.items() if (first or 0) <= k[1] <= (last or 999)}


def test_filters_leave_files_unopened(spark, stored):
    root, want = stored

    def opened(*filters, **options):
        reader = paged._StoredRuns({"path": root} | options)
        assert list(reader.pushFilters(list(filters))) == list(filters)  # Spark filters the rows too
        return {(c, a) for p in reader.partitions() for _, c, a, _ in p.files}

    every = opened()
    assert every == {(c, (n - 1) // 5 * 5 + 1) for c, n in want}
    number, content = ("number",), ("content_id",)
    assert opened(GreaterThan(number, 5)) == {x for x in every if x[1] >= 6}
    assert opened(LessThanOrEqual(number, 5), EqualTo(content, 2)) == {(2, 1)}
    assert opened(In(number, (7, 12)), last="9") == {x for x in every if x[1] == 6}
    assert opened(In(content, (1, 77))) == {x for x in every if x[0] == 1}
    assert opened(EqualTo(content, 1), EqualTo(content, 2)) == set()
    df = paged.read(spark, "stored_runs", root).where("number > 5 AND number <= 8 AND content_id IN (0, 1, 2)")
    assert plain(df.collect()) == {k: v for k, v in want.items() if 5 < k[1] <= 8 and k[0] < 3}


def test_files_are_dealt_to_tasks(stored, monkeypatch):
    root, _ = stored
    whole = paged._StoredRuns({"path": root}).partitions()
    assert len(whole) == 1
    monkeypatch.setattr(paged, "PACK", 1)
    each = paged._StoredRuns({"path": "file:" + root}).partitions()
    assert all(len(p.files) == 1 for p in each) and [f for p in each for f in p.files] == whole[0].files


def test_empty_folder_and_lines(spark, tmp_path):
    assert paged.read(spark, "stored_runs", str(tmp_path)).count() == 0
    rows = [(5, n, f"5\t{n}\t1\t1\t1\t1\t0\t0\t9\t9\t90\tw{n}") for n in range(1, 8)] + [(5, 2, "level\tpage_num\theader"), (5, 2, "")]
    from pyspark.sql import functions as F

    paged.write_pages(spark.createDataFrame(rows, "content_id long, number int, value string"), f"{tmp_path}/made", 3, F.array_join(F.collect_list("value"), "\n"))
    got = paged.read(spark, "ocr_lines", f"{tmp_path}/made", 2, 6).collect()
    assert sorted(tuple(x) for x in got) == sorted(x for x in rows if 2 <= x[1] <= 6 and x[2][:1] == "5")


def test_many_contents_share_files(spark, tmp_path):
    from pyspark.sql import functions as F

    pages = [(c, n) for c in range(-250, 250) for n in range(1, 2 + c % 9)] + [(7000, n) for n in range(1, 5001)]
    runs = F.array(F.array(F.concat(F.lit("w\t"), "number"), F.lit("1"), F.lit("2"), F.lit("9")))
    made = spark.createDataFrame(pages, "content_id long, number int").select("*", F.lit(600.0).alias("width"), F.lit(None).cast("double").alias("height"), F.lit(False).alias("failed"), runs.alias("runs"))
    paged.write_pages(made, root := f"{tmp_path}/made", 2, paged.payload())
    rows = paged.read(spark, "stored_runs", root).collect()
    assert plain(rows) == {(c, n): [(f"w\t{n}", 1.0, 2.0, 9.0, "")] for c, n in pages} and len(rows) == len(pages)

    def opened(*filters, **options):
        reader = paged._StoredRuns({"path": root} | options)
        list(reader.pushFilters(list(filters)))
        return {f for p in reader.partitions() for f in p.files}

    every = opened()
    assert len(every) <= 4 * 12 and all(c is None for _, c, _, _ in every)  # slots times ranges, 1 to 2, 3 to 6, 7 to 14 and so on
    assert {a for _, _, a, _ in every} == {2 * (2**k - 1) + 1 for k in range(12)}
    assert {a for _, _, a, _ in opened(GreaterThan(("number",), 2), last="9")} == {3, 7}
    one = opened(EqualTo(("content_id",), 7), LessThanOrEqual(("number",), 14))
    assert sorted(a for _, _, a, _ in one) == [1, 3, 7]
    for where in ("content_id = 7", "content_id IN (-3, 7000) AND number BETWEEN 900 AND 2100", "content_id = 7000 AND number > 4990", "number = 3"):
        got = paged.read(spark, "stored_runs", root).where(where).collect()
        assert sorted((x.content_id, x.number) for x in got) == sorted(tuple(x) for x in made.select("content_id", "number").where(where).collect()) and got


def test_a_packed_payload_that_cannot_be_read(tmp_path):
    at = tmp_path / "packed" / "first=3" / "last=6" / "slot=0-1"
    at.mkdir(parents=True)
    (at / "part-0.txt").write_text('7\t5\t6\t{"pages": [\n\nno beginning\n8\t3\t4\t{"pages": [{"number": 3, "failed": true, "error": 4}]}')
    reader = paged._StoredRuns({"path": str(tmp_path)})
    got = [tuple(x[k] for k in ("content_id", "number", "failed", "error")) for b in reader.read(reader.partitions()[0]) for x in b.to_pylist()]
    assert got == [(7, 5, True, "unreadable payload: JSONDecodeError"), (7, 6, True, "unreadable payload: JSONDecodeError"), (8, 3, True, "4")]


def test_lines_of_many_contents_share_files(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [(c, n, f"5\t{n}\t1\t1\t1\t{k}\t0\t0\t9\t9\t90\tw{c} é ") for c in range(300) for n in range(1, 2 + c % 6) for k in range(3)]
    paged.write_pages(spark.createDataFrame(rows, "content_id long, number int, value string"), root := f"{tmp_path}/made", 3, F.array_join(F.collect_list("value"), "\n"))
    got = paged.read(spark, "ocr_lines", root, 2).where("content_id <> 5").collect()
    assert sorted(tuple(x) for x in got) == sorted(x for x in rows if x[1] >= 2 and x[0] != 5)
    assert sum(len(p.files) for p in paged._OcrLines({"path": root}).partitions()) <= 4 * 2  # slots times ranges, 1 to 3 and 4 to 9
