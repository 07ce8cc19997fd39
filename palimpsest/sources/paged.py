"""Pages kept in files by content and range of pages, as two data sources that open only the files a page range asks for.

``stored_runs`` gives pages (content_id, number, width, height, failed, error, runs) of stored JSON payloads, ``ocr_lines`` lines (content_id, number, value) of tables
of recognised text. write_pages() leaves files of many contents in folders ``packed/first=7/last=14/slot=3-12``, whose lines begin with their content and the range of their payload;
ranges double, and a content's slot, the third of twelve here, is told by a hash. Folders ``content_id=7/first=1/last=20`` with files of one content are read too. What a filter says of
``content_id`` and ``number`` decides by the folders' names which files are opened and by the lines' beginnings which payloads are parsed, as do the options ``first`` and ``last``; Spark
still filters the rows. A task reads whole files, PACK bytes of them or one, so a lost one is read again and nothing else.

A page that failed is a row with no runs; a payload that can't be read is one such row for each page of its range. A run that isn't four or five values (text, x, y, size, in newer payloads a font) is
left out. Files of other names and empty folders are passed over.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate, islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

PACK = 32 << 20
RUN = "struct<text:string,x:double,y:double,size:double,font:string>"
_PLACE = re.compile(r"content_id=(-?\d+)/first=(-?\d+)/last=(-?\d+)/[^/_.][^/]*$")
_PACKED = re.compile(r"packed/first=(-?\d+)/last=(-?\d+)/slot=(\d+)-(\d+)/[^/_.][^/]*$")
#: Pages of a content that share a slot.
SPREAD = 1024
#: Bytes of a file read at once, and rows in a batch.
READ, ROWS = 1 << 20, 1000


@dataclass
class Files(InputPartition):
    """What one task reads: (path, content_id, first, last) of each file; no content_id where lines tell it."""

    files: list[tuple[str, int | None, int, int]]


def _filesystem(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub(r"^file:/(?!//)", "file:///", path) if ":" in path else "file://" + path)


class Pages(DataSourceReader):
    """Lists files, keeps those that may hold what is asked, deals them to tasks; reading a file is the subclass's."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.span = [int(options[k]) if k in options else None for k in ("first", "last")]
        self.contents: set[int] | None = None
        self.known: dict[tuple[int, int, int], set[int]] = {}

    def _narrow(self, low: int | None, high: int | None) -> None:
        a, b = self.span
        self.span = [low if a is None else a if low is None else max(a, low), high if b is None else b if high is None else min(b, high)]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("number",):
                if isinstance(f, EqualTo):
                    self._narrow(f.value, f.value)
                elif isinstance(f, GreaterThan):
                    self._narrow(f.value + 1, None)
                elif isinstance(f, GreaterThanOrEqual):
                    self._narrow(f.value, None)
                elif isinstance(f, LessThan):
                    self._narrow(None, f.value - 1)
                elif isinstance(f, LessThanOrEqual):
                    self._narrow(None, f.value)
                elif isinstance(f, In) and f.value:
                    self._narrow(min(f.value), max(f.value))
            elif name == ("content_id",) and isinstance(f, EqualTo | In):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.contents = asked if self.contents is None else self.contents & asked
            yield f  # a file may hold more than is asked

    def partitions(self) -> list[Files]:
        from pyarrow.fs import FileSelector, FileType

        fs, root = _filesystem(self.path)
        below = [root] if self.contents is None else [f"{root}/packed", *(f"{root}/content_id={c}" for c in sorted(self.contents))]
        found = [x for at in below for x in fs.get_file_info(FileSelector(at, allow_not_found=True, recursive=True)) if x.type == FileType.File]
        low, high = self.span
        out: list[Files] = []
        room = 0
        for x in sorted(found, key=lambda x: x.path):
            content = None
            if m := _PLACE.search(x.path):
                content, first, last = map(int, m.groups())
            elif m := _PACKED.search(x.path):
                first, last, slot, slots = map(int, m.groups())
                if self.contents is not None and slot not in self._slots(first, last, slots):
                    continue
            else:
                continue
            if (low is not None and last < low) or (high is not None and first > high):
                continue
            if room < x.size or not out:
                out.append(Files([]))
                room = PACK
            out[-1].files.append((x.path, content, first, last))
            room -= x.size
        return out or [Files([])]

    def _slots(self, first: int, last: int, slots: int) -> set[int]:
        """Slots of what is asked for among pages ``first`` to ``last``."""
        key = (first, last, slots)
        if key not in self.known:
            blocks = range((first - 1) // SPREAD, (last - 1) // SPREAD + 1)
            self.known[key] = {zlib.crc32(f"{c}-{b}".encode()) % slots for c in self.contents or () for b in blocks}
        return self.known[key]

    def read(self, partition: Files) -> Iterator:
        made = self._made(partition)
        while some := list(islice(made, ROWS)):
            yield self.batch(some)

    def _made(self, partition: Files) -> Iterator[tuple]:
        fs, _ = _filesystem(self.path)
        low, high = self.span
        for path, content, first, last in partition.files:
            with fs.open_input_stream(path) as stream:
                held = [(stream.readall(), content, first, last)] if content is not None else self._payloads(stream)
                for raw, c, a, b in held:
                    yield from (r for r in self.rows(raw, c, a, b) if (low is None or r[1] >= low) and (high is None or r[1] <= high))

    def _payloads(self, stream) -> Iterator[tuple[bytes, int, int, int]]:
        """Lines of a file of many contents that may hold what is asked, without their beginnings, with what these say."""
        low, high = self.span
        for line in _lines(stream):
            if line.count(b"\t", 0, 64) < 3:
                continue
            content, first, last, raw = line.split(b"\t", 3)
            c, a, b = int(content), int(first), int(last)
            if (low is None or b >= low) and (high is None or a <= high) and (self.contents is None or c in self.contents):
                yield raw, c, a, b

    def batch(self, rows: list[tuple]):
        raise NotImplementedError

    def rows(self, raw: bytes, content: int, first: int, last: int) -> Iterator[tuple]:
        raise NotImplementedError


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while some := stream.read(READ):
        *whole, rest = (rest + some).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _number(value: object) -> float | None:
    try:
        return float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None


def _runs(values: object) -> list[tuple]:
    out = []
    for v in values if isinstance(values, list) else []:
        if not isinstance(v, list) or len(v) not in (4, 5) or v[0] is None:
            continue
        x, y, size = map(_number, v[1:4])
        if x is not None and y is not None and size is not None:
            out.append((str(v[0]), x, y, size, str(v[4] or "") if len(v) == 5 else ""))
    return out


class _StoredRuns(Pages):
    def rows(self, raw, content, first, last):
        for line in raw.splitlines():
            if not line.strip():
                continue
            try:
                pages = json.loads(line)["pages"]
                made = [(content, int(p["number"]), _number(p.get("width")), _number(p.get("height")), bool(p.get("failed")), p.get("error"), [] if p.get("failed") else _runs(p.get("runs"))) for p in pages]
            except (ValueError, KeyError, TypeError, AttributeError) as problem:
                made = [(content, n, None, None, True, f"unreadable payload: {type(problem).__name__}", []) for n in range(first, last + 1)]
            yield from made

    def batch(self, rows):
        import pyarrow as pa

        *plain, error, runs = zip(*rows, strict=True)
        plain.append([None if e is None else str(e) for e in error])
        fields = [pa.array(v, k) for v, k in zip(plain, (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.bool_(), pa.string()), strict=True)]
        each = [run for page in runs for run in page]
        parts = list(zip(*each, strict=True)) or [[]] * 5
        kinds = {"text": pa.string(), "x": pa.float64(), "y": pa.float64(), "size": pa.float64(), "font": pa.string()}
        made = pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(parts, kinds.values(), strict=True)], fields=[pa.field(n, k) for n, k in kinds.items()])
        ends = [0, *accumulate(map(len, runs))]
        return pa.RecordBatch.from_arrays([*fields, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)], ["content_id", "number", "width", "height", "failed", "error", "runs"])


class _OcrLines(Pages):
    def rows(self, raw, content, first, last):
        for line in raw.decode("utf-8-sig", "replace").split("\n"):
            cells = line.split("\t", 2)
            if len(cells) > 1 and re.fullmatch(r"\s*\d{1,9}\s*", cells[1]):
                yield content, int(cells[1]), line.rstrip("\r")

    def batch(self, rows):
        import pyarrow as pa

        content, number, value = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(content, pa.int64()), pa.array(number, pa.int32()), pa.array(value, pa.string())], ["content_id", "number", "value"])


class StoredRuns(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stored_runs"

    def schema(self) -> str:
        return f"content_id long, number int, width double, height double, failed boolean, error string, runs array<{RUN}>"

    def reader(self, schema) -> DataSourceReader:
        return _StoredRuns(dict(self.options))


class OcrLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ocr_lines"

    def schema(self) -> str:
        return "content_id long, number int, value string"

    def reader(self, schema) -> DataSourceReader:
        return _OcrLines(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes both sources known to a session, ``spark.read.format("stored_runs").load(path)``, and lets filters reach Python sources, which they ask for."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (StoredRuns, OcrLines):
        spark.dataSource.register(source)


def write_pages(pages: DataFrame, path: str, chunk: int, value: Column) -> None:
    """``pages`` (content_id, number and what ``value``, an aggregate over the pages of a chunk, reads) as payloads of ``chunk`` pages, each of one or more lines, in text files
    of many contents. Folders name ranges of pages, 1, 2, 4 and so on times a chunk, and slots, as many as there are shuffle partitions: files grow in number with the tasks,
    not with the contents. One shuffle by folder, over which a content of very many pages is spread."""
    slots = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor((F.col("number") - 1) / chunk)
    own = {"start": F.col("part") * chunk + 1, "end": (F.col("part") + 1) * chunk}
    level = F.when(F.col("part") >= 0, F.expr("shiftleft(1L, length(bin(part + 1)) - 1)"))
    folder = {"first": F.coalesce((level - 1) * chunk + 1, "start"), "last": F.coalesce((2 * level - 1) * chunk, "end")}
    slot = F.concat_ws("-", F.crc32(F.concat_ws("-", "content_id", F.floor((F.col("start") - 1) / SPREAD)).cast("binary")) % slots, F.lit(slots))
    placed = pages.withColumn("part", part).withColumns(own).withColumns(folder).withColumn("slot", slot).where("content_id IS NOT NULL AND part IS NOT NULL")
    made = placed.repartition("first", "last", "slot").groupBy("content_id", "part", "start", "end", "first", "last", "slot").agg(value.alias("value"))
    begins = F.concat_ws("\t", "content_id", "start", "end", F.lit(""))
    lines = F.concat(begins, F.replace("value", F.lit("\n"), F.concat(F.lit("\n"), begins)))
    made.select("first", "last", "slot", lines.alias("value")).write.partitionBy("first", "last", "slot").text(f"{path}/packed")


def payload() -> Column:
    """Pages (number, width, height, failed, runs: array of arrays of strings) of a chunk as a payload, for write_pages()."""
    pages = F.array_sort(F.collect_list(F.struct("number", "width", "height", "failed", "runs")))
    return F.to_json(F.struct(pages.alias("pages")))


def read(spark: SparkSession, source: str, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Pages or lines of files under ``path``, those from page ``first`` to ``last`` if they are given."""
    register(spark)
    reader = spark.read.format(source)
    for name, at in (("first", first), ("last", last)):
        reader = reader if at is None else reader.option(name, str(at))
    return reader.load(path)
