"""Offset pages over any order, previews and newest-first listings.

A page deep in a table, or one that takes all that follows, is found by order statistics: sampled keys cut the table into
ranges, exact counts say which range holds a position, and that range is cut again until the row at the position is
known. The page is then what lies between two such rows, a filter; nothing is numbered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowferry.operators.mapping import column

# Fixed value: rows of a preview page where none are asked for.
PAGE_SIZE = 50

# A page that ends within so many rows is a top-n, where every task keeps that many rows at most.
FRONT = 10_000
# Keys that cut a range, and rows of equal content made by one task.
_CUTS = 31
_COPIES = 1_000_000


def clamp_page(page: int) -> int:
    return max(1, page)


def clamp_page_size(size: int, largest: int | None = None) -> int:
    """Rows on a page, 50 where none are asked for; more than ``largest`` is an error, never quietly fewer."""
    if largest is not None and size > largest:
        raise ValueError(f"a page of {size} rows was asked for; the largest is {largest}")
    return PAGE_SIZE if size <= 0 else size


@dataclass(frozen=True)
class Bound:
    """One end of a range of keys, with or without the key itself."""

    key: tuple
    closed: bool = False


class TotalOrder:
    """An order of all rows: some columns first, then every other one, so that only equal rows tie. Nulls sort first.

    Conditions are written as SQL text: a tree of comparisons is then one call to the engine, not thousands.
    """

    def __init__(self, df: DataFrame, order_by: Sequence[str]):
        kinds = {f.name: f.dataType for f in df.schema.fields}
        for c in order_by:
            if c not in kinds:
                raise ValueError(f"no column {c} to order by; the columns are {df.columns}")
        names = [*order_by, *sorted(c for c in df.columns if c not in order_by)]
        # Nested values are ordered by a hash of them: which order does not matter, only that there is one.
        nested = (T.StructType, T.ArrayType, T.MapType)
        self.columns = [self._hash(c, kinds[c]) if isinstance(kinds[c], nested) else _quoted(c) for c in names]
        self.kinds = [T.LongType() if isinstance(kinds[c], nested) else kinds[c] for c in names]

    @staticmethod
    def _hash(name: str, kind: T.DataType) -> str:
        return f"xxhash64(to_json(struct({_quoted(name)})))" if "map<" in kind.simpleString() else f"xxhash64({_quoted(name)})"

    def of_columns(self, names: Sequence[str]) -> TotalOrder:
        """The same order over rows that hold the key's columns only."""
        out = object.__new__(TotalOrder)
        out.columns, out.kinds = [_quoted(n) for n in names], self.kinds
        return out

    def key_columns(self) -> list[Column]:
        return [F.expr(c).alias(f"k{i}") for i, c in enumerate(self.columns)]

    def collected(self, df: DataFrame) -> list[tuple]:
        """Keys of a few rows in a form that literals can be made of without loss."""
        plain = []
        for i, (c, kind) in enumerate(zip(self.columns, self.kinds)):
            text = f"unix_micros({c})" if isinstance(kind, T.TimestampType) else c if isinstance(kind, T.BinaryType) else f"cast({c} as string)"
            plain.append(F.expr(text).alias(f"k{i}"))
        return [tuple(r) for r in df.select(*plain).collect()]

    def _literals(self, key: tuple) -> list[str | None]:
        out: list[str | None] = []
        for value, kind in zip(key, self.kinds):
            if value is None:
                out.append(None)
            elif isinstance(kind, T.TimestampType):
                out.append(f"timestamp_micros({value})")
            elif isinstance(kind, T.BinaryType):
                out.append(f"X'{bytes(value).hex()}'")
            else:
                out.append(f"cast(decode(X'{value.encode().hex()}', 'UTF-8') as {kind.simpleString()})")
        return out

    def literals_of(self, df: DataFrame) -> list[str]:
        """The first column of some rows as SQL literals, in the rows' order; nulls left out."""
        return [self._literals(key)[0] for key in self.collected(df) if key[0] is not None]

    def equal_text(self, key: tuple) -> str:
        return " AND ".join(f"{c} IS NULL" if v is None else f"{c} <=> {v}" for c, v in zip(self.columns, self._literals(key)))

    def before_text(self, key: tuple, last: bool = False) -> str:
        """Rows before a key, or up to it: column by column, so that most rows are told by the first."""
        out = str(last).lower()
        for c, v in reversed(list(zip(self.columns, self._literals(key)))):
            # Only a null is not behind a null.
            out = f"({c} IS NULL AND {out})" if v is None else f"CASE WHEN {c} IS NULL OR {c} < {v} THEN true WHEN {c} = {v} THEN {out} ELSE false END"
        return out

    def equal(self, key: tuple) -> Column:
        return F.expr(self.equal_text(key))

    def before(self, key: tuple) -> Column:
        return F.expr(self.before_text(key))

    def within(self, low: Bound | None, high: Bound | None) -> Column:
        """Rows between two keys; bounds of the first column are told apart, as a scan can use them."""
        out, first = ["true"], self.columns[0]
        bounded = not isinstance(self.kinds[0], (T.FloatType, T.DoubleType))  # a scan orders NaN in its own way
        if low is not None:
            out.append(f"NOT {self.before_text(low.key, last=not low.closed)}")
            if low.key[0] is not None and bounded:
                out.append(f"{first} >= {self._literals(low.key)[0]}")
        if high is not None:
            out.append(self.before_text(high.key, last=high.closed))
            if bounded:
                out.append(f"{first} IS NULL" if high.key[0] is None else f"({first} IS NULL OR {first} <= {self._literals(high.key)[0]})")
        return F.expr(" AND ".join(out))

    def sort(self, df: DataFrame) -> DataFrame:
        return df.orderBy(*[F.expr(c) for c in self.columns])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Place:
    """The row at a position: its key, and how many rows equal to it come before it."""

    key: tuple
    skip: int


class Ranges:
    """Sampled keys of some rows, and how many rows lie at and between them: odd ranges are at a key, even ones between two.

    A key that many rows share is most likely among the samples, and its rows are a range of their own.
    """

    def __init__(self, part: DataFrame, order: TotalOrder, cuts: int, low: Bound | None, high: Bound | None):
        names = [f"k{i}" for i in range(len(order.kinds))]
        picked = part.select(*order.key_columns()).orderBy(F.rand(17)).limit(cuts).distinct().orderBy(*names)
        self.keys = order.of_columns(names).collected(picked)
        self.low, self.high = low, high

        def tree(lo: int, hi: int) -> str:
            """As many comparisons as log2 of the keys."""
            if lo == hi:
                return str(2 * lo)
            mid = (lo + hi) // 2
            key = self.keys[mid]
            return f"CASE WHEN {order.before_text(key)} THEN {tree(lo, mid)} WHEN {order.equal_text(key)} THEN {2 * mid + 1} ELSE {tree(mid + 1, hi)} END"

        counts = part.groupBy(F.expr(tree(0, len(self.keys))).alias("at")).agg(F.count(F.lit(1)).alias("n")).collect() if self.keys else []
        self.counts = sorted((r["at"], r["n"]) for r in counts)

    def cover(self, position: int, n: int = 1) -> tuple[int, int, int, int] | None:
        """The first and last range that hold some positions, how many rows these ranges have, and how many lie before them."""
        before, found = 0, []
        for at, rows in self.counts:
            if before + rows > position and before < position + n:
                found.append((at, rows, before))
            before += rows
        return (found[0][0], found[-1][0], sum(f[1] for f in found), found[0][2]) if found else None

    def bounds(self, first: int, last: int) -> tuple[Bound | None, Bound | None]:
        low = Bound(self.keys[first // 2], True) if first % 2 else Bound(self.keys[first // 2 - 1]) if first else self.low
        high = Bound(self.keys[last // 2], True) if last % 2 else Bound(self.keys[last // 2]) if last // 2 < len(self.keys) else self.high
        return low, high


def locate(df: DataFrame, order: TotalOrder, position: int, cuts: int = _CUTS) -> Place | None:
    """The row at a position (from 0) of the ordered table; None past its end.

    Each round reads the range left over: once for a few sampled keys, once to count the rows between them.
    """
    low = high = None
    part = df
    while True:
        ranges = Ranges(part, order, cuts, low, high)
        found = ranges.cover(position)
        if found is None:
            return None
        at, _, rows, before = found
        position -= before
        if at % 2:
            return Place(ranges.keys[at // 2], position)
        low, high = ranges.bounds(at, at)
        part = df.where(order.within(low, high))
        if rows <= FRONT:
            names = [f"k{i}" for i in range(len(order.kinds))]
            ordered = order.sort(part).select(*order.key_columns())
            key = order.of_columns(names).collected(ordered.offset(position).limit(1))[0]
            return Place(key, position - part.where(order.before(key)).count())


def _copies(df: DataFrame, order: TotalOrder, key: tuple, n: int) -> DataFrame:
    """``n`` of the equal rows that have a key, made anew by as many tasks as they ask for."""
    one = df.where(order.equal(key)).limit(1)
    if n <= 1:
        return one.limit(n)
    blocks = one.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // _COPIES))))
    if n > _COPIES:
        blocks = blocks.repartition(F.col("_block"))
    last = F.least(F.lit(_COPIES), F.lit(n) - F.col("_block") * _COPIES)
    return blocks.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), last.cast("long")))).drop("_block", "_copy")


def page(df: DataFrame, order_by: Sequence[str], offset: int = 0, limit: int = 0) -> DataFrame:
    """Rows ``offset .. offset+limit`` of the table in key order; limit 0 means all that follow, in many partitions.

    Rows that tie in ``order_by`` are ordered by their other columns, so a page's content is fixed. Nulls sort first.
    """
    if limit and offset + limit <= FRONT:
        out = TotalOrder(df, order_by).sort(df)
        return (out.offset(offset) if offset else out).limit(limit)
    return deep_page(df, order_by, offset, limit)


def deep_page(df: DataFrame, order_by: Sequence[str], offset: int, limit: int = 0, cuts: int = _CUTS) -> DataFrame:
    """The same page without sorting what lies before it or behind it.

    A short page is a top-n of the narrow ranges it falls into; a long one is what lies between the rows at its ends.
    """
    order = TotalOrder(df, order_by)
    part, low, high, position = df, None, None, offset
    while limit and limit <= FRONT:
        ranges = Ranges(part, order, cuts, low, high)
        found = ranges.cover(position, limit)
        if found is None:
            return df.limit(0)
        first, last, rows, before = found
        low, high = ranges.bounds(first, last)
        part, position = df.where(order.within(low, high)), position - before
        if position + limit <= FRONT and rows <= 100 * FRONT:
            return order.sort(part).offset(position).limit(limit)
        if first != last or first % 2:
            break
    begin = locate(df, order, offset, cuts) if offset else None
    if offset and begin is None:
        return df.limit(0)
    end = locate(df, order, offset + limit, cuts) if limit else None
    if begin and end and begin.key == end.key:
        return _copies(df, order, begin.key, end.skip - begin.skip)
    out = df.where(order.within(Bound(begin.key, not begin.skip) if begin else None, Bound(end.key) if end else None))
    if begin and begin.skip:
        same = df.where(order.equal(begin.key)).count()
        out = out.union(_copies(df, order, begin.key, same - begin.skip))
    if end and end.skip:
        out = out.union(_copies(df, order, end.key, end.skip))
    return order.sort(out)


@dataclass(frozen=True)
class PreviewPage:
    """One page of a query: ``rows`` are the page's, ``total`` counts the whole result."""

    columns: list[str]
    rows: DataFrame
    total: int
    page: int
    page_size: int


def preview(df: DataFrame, page_no: int = 1, page_size: int = 0, order_by: Sequence[str] = (), largest: int | None = None) -> PreviewPage:
    """A preview page of exactly the size asked for (50 without one); more than ``largest`` rows is an error.

    Without ``order_by`` the query's own order decides, and where it has none all its columns do, so that pages never
    overlap.
    """
    number, size = clamp_page(page_no), clamp_page_size(page_size, largest)
    skip = (number - 1) * size
    if order_by or not _is_sorted(df):
        rows = page(df, order_by, skip, size)
    else:
        rows = df.offset(skip).limit(size)
    return PreviewPage(df.columns, rows, df.count(), number, size)


def _is_sorted(df: DataFrame) -> bool:
    return not df._jdf.queryExecution().optimizedPlan().outputOrdering().isEmpty()


def newest(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """The ``n`` rows with the highest id, newest first."""
    return df.orderBy(column(id_col).desc()).limit(n)
