"""CSV records found in splits of their files, also where a record spans lines or splits.

A quote is either the border of a cell or doubled inside one, so a line ends a record when the quotes from the file's
start to the line's end are even. Three steps, none of which orders or moves lines:

1. every split counts its lines with an odd number of quotes: one plain scan, one row a split;
2. a running sum over a file's splits tells each one whether it begins inside a record, and where that record began;
3. every split parses the records that begin and end in it. What is left, a head before the first record and a tail
   after the last one, is put together by record, a few lines for each split.

The ranges are as many as the splits, which the driver plans anyway. A quote inside an unquoted cell is an error, as is a
record with too few or too many cells. Records end with ``\\n`` or ``\\r\\n``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowferry.session import small_frame

_FRAGMENT = "file string, home long, block long, header boolean, body string"


@dataclass(frozen=True)
class Range:
    """A split of a file: whether it begins inside a record, and the split that record began in."""

    inside: bool
    home: int


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def locate_records(lines: DataFrame) -> dict[tuple[str, int], Range]:
    """How every split of every file begins."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counts = lines.groupBy("file", "block").agg(F.sum(quotes % 2).alias("odd")).orderBy("file", "block").toArrow()
    out: dict[tuple[str, int], Range] = {}
    last, inside, home, odd, block = None, False, 0, 0, 0
    for file, here, n in zip(*(counts.column(c).to_pylist() for c in ("file", "block", "odd"))):
        if file != last:
            if inside != bool(odd % 2):
                raise ValueError(f"a quote in {last} is never closed")
            last, inside, home, odd, block = file, False, here, 0, here
        # A split without an odd line that begins inside a record also ends inside that one.
        home = home if inside and odd == 0 else block
        inside = inside != bool(odd % 2)
        out[file, here] = Range(inside, home if inside else here)
        odd, block = n, here
    if inside != bool(odd % 2):
        raise ValueError(f"a quote in {last} is never closed")
    return out


class Walker:
    """Goes through a task's lines, split by split, and tells complete records from heads and tails of others."""

    def __init__(self, ranges: dict[tuple[str, int], Range]):
        self.ranges = ranges
        self.at: tuple[str, int] | None = None
        self.held: list[str] = []
        self.inside = self.head = self.first = False

    def segments(self, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
        for batch in batches:
            if not len(batch):
                continue
            file, block = (batch.column(c).dictionary_encode() for c in ("file", "block"))
            code = file.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(block.dictionary) + block.indices.to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1, [len(code)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield (batch.column("file")[a].as_py(), batch.column("block")[a].as_py()), batch.column("value").slice(a, b - a)

    def walk(self, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        """``("whole", header, lines, records)``, and ``("head" or "tail", split, header, lines)`` for parts of a record."""
        for key, values in self.segments(batches):
            if key != self.at:
                yield from self.end()
                if key not in self.ranges:
                    raise RuntimeError(f"{key[0]} was split in another way when it was read again; read it anew")
                self.at, self.inside = key, self.ranges[key].inside
                self.head, self.first = self.inside, key[1] == 0
            odd = pc.count_substring(values, '"').to_numpy(zero_copy_only=False) & 1
            after = (np.cumsum(odd) + self.inside) & 1
            ends = np.flatnonzero(after == 0)
            texts = values.to_pylist()
            self.inside = bool(after[-1])
            if not len(ends):
                self.held += texts
                continue
            begin = 0
            if self.head:
                yield "head", self.at, False, self.held + texts[: ends[0] + 1]
                self.held, self.head, begin, ends = [], False, int(ends[0]) + 1, ends[1:]
            while self.first and len(ends):
                lines = self.held + texts[begin : ends[0] + 1]
                if lines not in ([""], ["\r"]):
                    yield "whole", True, lines, 1
                    self.first = False
                self.held, begin, ends = [], int(ends[0]) + 1, ends[1:]
            if len(ends):
                stop = int(ends[-1]) + 1
                alone = np.diff(np.concatenate([[begin - len(self.held) - 1], ends])) == 1
                blank = sum(texts[e] in ("", "\r") for e in ends[alone])
                yield "whole", False, self.held + texts[begin:stop], len(ends) - blank
                self.held, begin = [], stop
            self.held += texts[begin:]

    def end(self) -> Iterator[tuple]:
        if self.held:
            yield "head" if self.head else "tail", self.at, self.first and not self.head, self.held
        self.held = []


def parse(lines: list[str], names: list[str], records: int) -> pa.RecordBatch:
    """Records as text columns; an empty cell is an empty text."""
    data = ("\n".join(lines) + "\n").encode()
    places = [str(i) for i in range(len(names))]
    if not records:
        return pa.RecordBatch.from_arrays([pa.array([], pa.string()) for _ in names], names)
    table = pacsv.read_csv(
        pa.py_buffer(data),
        read_options=pacsv.ReadOptions(column_names=places, block_size=len(data) + 1, use_threads=False),
        parse_options=pacsv.ParseOptions(newlines_in_values=True),
        convert_options=pacsv.ConvertOptions(column_types=dict.fromkeys(places, pa.string()), strings_can_be_null=False),
    ).combine_chunks()
    if table.num_rows != records:
        raise ValueError(f"{records} records were read as {table.num_rows}: a quote or a line break inside an unquoted cell")
    return pa.RecordBatch.from_arrays([table.column(p).chunk(0) for p in places], names)


def check_header(lines: list[str], names: list[str]) -> None:
    """Every file has the same header; repeated names carry a number among ``names``."""
    row = parse(lines, [str(i) for i in range(len(names))], 1).to_pylist()[0]
    cells = [c.removeprefix("\ufeff") for c in row.values()]
    if any(c and n != c and not (n.startswith(c) and n[len(c) :].isdigit()) for c, n in zip(cells, names)):
        raise ValueError(f"a file has the header {cells}, another one {names}")


def read_records(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The records below a path as text columns, without their headers, in as many tasks as the files have splits."""
    ranges = locate_records(_lines(spark, path))
    known = spark.sparkContext.broadcast(ranges)

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, *rest in Walker(known.value).walk(batches):
            if kind == "whole":
                header, lines, records = rest
                if header:
                    check_header(lines, names)
                else:
                    yield parse(lines, names, records)

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Walker(known.value)
        for source in (walker.walk(batches), walker.end()):
            for kind, *rest in source:
                if kind != "whole":
                    (file, block), header, lines = rest
                    # A split's tail belongs to a record that begins there, its head to an earlier one.
                    home = known.value[file, block].home if kind == "head" else block
                    yield pa.RecordBatch.from_pydict({"file": [file], "home": [home], "block": [block], "header": [header], "body": ["\n".join(lines)]})

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, header in zip(batch.column("body").to_pylist(), batch.column("header").to_pylist()):
                if header:
                    check_header([body], names)
                else:
                    yield parse([body], names, 1)

    fields = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    rows = _lines(spark, path).mapInArrow(whole, fields)
    borders = {(f, b) for (f, b), r in ranges.items() if r.inside}
    if not borders:
        return rows
    # Only splits that a record leaves or enters hold parts of one.
    wanted = borders | {(f, ranges[f, b].home) for f, b in borders}
    small = F.broadcast(small_frame(spark, sorted(wanted), "file string, block long"))
    found = _lines(spark, path).join(small, ["file", "block"], "left_semi").select("value", "file", "block").mapInArrow(parts, _FRAGMENT)
    bodies = found.groupBy("file", "home").agg(F.array_sort(F.collect_list(F.struct("block", "body"))).alias("parts"), F.bool_or("header").alias("header"))
    records = bodies.select(F.concat_ws("\n", F.transform("parts", lambda p: p["body"])).alias("body"), "header")
    return rows.unionByName(records.mapInArrow(joined, fields))
