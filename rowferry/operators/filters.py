"""Row filters: free-form text, high-water marks, key lists and JSON document filters."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowferry.model import Watermark
from rowferry.operators.mapping import column

# A key list up to this many rows may be broadcast; longer ones join by shuffle.
BROADCAST_KEYS = 100_000


def where_all(df: DataFrame, *predicates: str | Column | None) -> DataFrame:
    """AND of every non-blank predicate; each is its own expression, so ``a OR b`` stays whole."""
    for p in predicates:
        if isinstance(p, str):
            p = F.expr(p) if p.strip() else None
        if p is not None:
            df = df.where(p)
    return df


def mark_number(text: str):
    try:
        return int(text)
    except ValueError:
        return Decimal(text)


def mark_instant(text: str) -> datetime:
    """RFC 3339 text (or a zone-free timestamp, taken as UTC) as naive UTC."""
    at = datetime.fromisoformat(text.strip())
    return at.astimezone(timezone.utc).replace(tzinfo=None) if at.tzinfo else at


def mark_literal(df: DataFrame, mark: Watermark, value: str) -> Column:
    """A stored mark as a literal of the column's own type, so the comparison reaches the scan."""
    kind = df.schema[mark.column].dataType
    if mark.kind == "id":
        return F.lit(mark_number(value))
    at = mark_instant(value).isoformat(sep=" ")
    if isinstance(kind, T.TimestampType):
        return F.lit(at + "Z").cast(kind)
    if isinstance(kind, T.DateType):
        return F.lit(at).cast("timestamp_ntz")
    return F.lit(at).cast(kind if isinstance(kind, T.TimestampNTZType) else "timestamp_ntz")


def after_mark(df: DataFrame, mark: Watermark, last: str = "", upto: str = "") -> DataFrame:
    """Rows strictly above ``last`` and, if given, not above ``upto``.

    A blank ``last`` is a first run and adds no lower bound. Rows whose mark is
    null come along on that first run only; later runs compare, which drops them.
    """
    c = column(mark.column)
    if last:
        df = df.where(c > mark_literal(df, mark, last))
    if upto:
        bound = c <= mark_literal(df, mark, upto)
        df = df.where(bound if last else bound | c.isNull())
    return df


def lookup(df: DataFrame, key: str, values: Sequence) -> DataFrame:
    """Rows whose key is in a list: one semi join, broadcast while the list is short."""
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], T.StructType([T.StructField(key, df.schema[key].dataType)]))
    if len(values) <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    return df.join(wanted, key, "left_semi")


_EXTENDED = {
    "$numberLong": int,
    "$numberInt": int,
    "$numberDouble": float,
    "$numberDecimal": Decimal,
    "$oid": str,
}


def _literal(value):
    if isinstance(value, Mapping) and len(value) == 1:
        (tag, raw), *_ = value.items()
        if tag in _EXTENDED:
            return F.lit(_EXTENDED[tag](raw))
        if tag == "$date":
            millis = raw.get("$numberLong") if isinstance(raw, Mapping) else raw
            if isinstance(millis, str) and not millis.lstrip("-").isdigit():
                return F.lit(mark_instant(millis).isoformat(sep=" ")).cast("timestamp_ntz")
            return F.timestamp_millis(F.lit(int(millis))).cast("timestamp_ntz")
    if isinstance(value, (Mapping, list)):
        raise ValueError(f"unsupported value in document filter: {value!r}")
    return F.lit(value)


def _field(schema: T.StructType, path: str) -> tuple[Column, T.DataType]:
    """A flattened column of that dotted name, else the nested field."""
    if path in schema.names:
        return column(path), schema[path].dataType
    kind: T.DataType = schema
    value: Column | None = None
    for part in path.split("."):
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
        if not isinstance(inner, T.StructType) or part not in inner.names:
            return F.lit(None), T.NullType()
        if isinstance(kind, T.ArrayType):
            # A path through an array of documents reaches the field of each.
            value, kind = F.transform(value, lambda x, p=part: x[p]), T.ArrayType(inner[part].dataType)
            if isinstance(kind.elementType, T.ArrayType):
                value, kind = F.flatten(value), kind.elementType
        else:
            value, kind = column(part) if value is None else value[part], inner[part].dataType
    return value, kind


def _like(kind: T.DataType, value: Column, literal) -> bool:
    """Whether a value of the column can equal or order against a literal: both numbers, texts, truth values or times."""
    if isinstance(literal, Mapping) and len(literal) == 1:
        (tag, raw), *_ = literal.items()
        if tag == "$date":
            return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))
        literal = _EXTENDED[tag](raw) if tag in _EXTENDED else literal
    if isinstance(literal, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(literal, (int, float, Decimal)):
        return isinstance(kind, T.NumericType)
    return isinstance(literal, str) and isinstance(kind, (T.StringType, T.NullType))


def _equals(c: Column, kind: T.DataType, value) -> Column:
    if value is None:
        return c.isNull()
    literal = _literal(value)
    if isinstance(kind, T.ArrayType) and not isinstance(value, list):
        return F.coalesce(F.array_contains(c, literal), F.lit(False)) if _like(kind.elementType, c, value) else F.lit(False)
    # Unlike types never match, as in the store; they are no error.
    return F.coalesce(c == literal, F.lit(False)) if _like(kind, c, value) else F.lit(False)


def _any(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _all(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


_ORDER = {
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
}


def _condition(c: Column, kind: T.DataType, test: Mapping) -> Column:
    parts = []
    for op, value in test.items():
        if op == "$eq":
            parts.append(_equals(c, kind, value))
        elif op == "$ne":
            parts.append(~_equals(c, kind, value))
        elif op == "$in":
            parts.append(_any([_equals(c, kind, v) for v in value]))
        elif op == "$nin":
            parts.append(~_any([_equals(c, kind, v) for v in value]))
        elif op == "$exists":
            parts.append(c.isNotNull() if value else c.isNull())
        elif op in _ORDER:
            literal = _literal(value)
            if isinstance(kind, T.ArrayType):
                test_one = F.exists(c, lambda x, o=_ORDER[op], v=literal: F.coalesce(o(x, v), F.lit(False)))
                parts.append(F.coalesce(test_one, F.lit(False)) if _like(kind.elementType, c, value) else F.lit(False))
            else:
                parts.append(F.coalesce(_ORDER[op](c, literal), F.lit(False)) if _like(kind, c, value) else F.lit(False))
        else:
            raise ValueError(f"unsupported operator in document filter: {op}")
    return _all(parts)


def document_predicate(schema: T.StructType, text: str) -> Column:
    """Compile a JSON document filter to one predicate; blank matches all, bad JSON is an error.

    ``$ne`` and ``$nin`` match absent fields, ordering operators do not, and an
    array field equals a value it contains. An absent field and a null field
    read alike.
    """
    if not text.strip():
        return F.lit(True)
    try:
        tree = json.loads(text)
    except json.JSONDecodeError as error:
        raise ValueError(f"invalid document filter JSON: {error}") from error
    if not isinstance(tree, dict):
        raise ValueError("a document filter must be a JSON object")
    return _compile(schema, tree)


def _compile(schema: T.StructType, tree: Mapping) -> Column:
    parts = []
    for key, value in tree.items():
        if key == "$and":
            parts.append(_all([_compile(schema, v) for v in value]))
        elif key == "$or":
            parts.append(_any([_compile(schema, v) for v in value]))
        elif key.startswith("$"):
            raise ValueError(f"unsupported operator in document filter: {key}")
        else:
            c, kind = _field(schema, key)
            operators = isinstance(value, dict) and value and all(k.startswith("$") for k in value)
            if operators and not set(value) <= {*_EXTENDED, "$date"}:
                parts.append(_condition(c, kind, value))
            else:
                parts.append(_equals(c, kind, value))
    return _all(parts)
