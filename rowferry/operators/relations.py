"""A change feed whose rows are bare values: schema messages in the feed say which columns they are.

Messages are ``(seq, kind, relation, table, columns, before, after)``. Kind R describes a relation from its ``seq`` on;
I, U and D carry the values of a row, in the order of the columns that the relation had at that time; B and C are ignored.
A value is ``(kind, value)``: ``t`` text, ``n`` null, ``u`` left as it was.

Each event is read by the version valid for it, found by a join on relation and ``seq``: versions are as many as there
were schema changes, so they are broadcast as long as their measured size allows, and the events never move. A column
that a later version adds reaches the target, with nulls in the rows from before. A column that a version lacks is one
its updates leave as it was. Events of relations that no message described, or with more values than columns, are
rejected and harm no others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from rowferry.functions.typemap import spark_type
from rowferry.operators.changes import apply_changes, reject_reason
from rowferry.operators.mapping import column
from rowferry.session import Staged


def _structs(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields.items()]))


_VALUES = _structs(kind=T.StringType(), value=T.StringType())
MESSAGES = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("relation", T.LongType()),
        T.StructField("table", T.StringType()),
        T.StructField("columns", _structs(name=T.StringType(), type=T.StringType())),
        T.StructField("before", _VALUES),
        T.StructField("after", _VALUES),
    ]
)


def relation_messages(messages: DataFrame) -> DataFrame:
    """``relation, table, columns, since`` of each schema message."""
    told = messages.where("kind = 'R' AND seq IS NOT NULL AND relation IS NOT NULL AND columns IS NOT NULL")
    return told.select("relation", "table", "columns", F.col("seq").alias("since"))


def versions(told: DataFrame) -> DataFrame:
    """From when to when (exclusive) each description of a relation holds. The same message twice is one."""
    one = told.groupBy("relation", "since").agg(F.min(F.struct("table", "columns")).alias("m")).select("relation", "since", "m.*")
    return one.withColumn("until", F.lead("since").over(Window.partitionBy("relation").orderBy("since")))


def table_fields(known: DataFrame, table: str) -> list[T.StructField]:
    """Every column a table ever had, in order of appearance, by its newest type; as many rows as columns reach the driver."""
    each = known.where(F.col("table") == table).select("since", F.posexplode("columns").alias("pos", "c"))
    rows = each.groupBy(F.col("c.name").alias("name")).agg(F.max_by("c.type", "since").alias("type"), F.min(F.struct("since", "pos")).alias("first"))
    return [T.StructField(r["name"], T.StructType.fromDDL(f"x {spark_type(r['type'] or 'text')}")[0].dataType) for r in rows.orderBy("first").collect()]


def read_events(messages: DataFrame, known: Staged, table: str, fields: Sequence[T.StructField]) -> DataFrame:
    """The events of one table, their images as text by column name, and, with a ``reason``, those no version explains.

    Where a version has each column is told with the version, once, not looked for with every value.
    """
    names = F.transform("columns", lambda c: c["name"])
    places = [(F.array_position(names, f.name) - 1).cast("int").alias(f"_at{i}") for i, f in enumerate(fields)]
    valid = F.broadcast(known.df) if known.small else known.df
    valid = valid.select(F.col("relation").alias("_relation"), F.col("table").alias("_table"), F.size(names).alias("_names"), "since", "until", *places)
    events = messages.where("kind IS NULL OR kind NOT IN ('R', 'B', 'C')").select("seq", "kind", "relation", "before", "after")
    at = (F.col("relation") == F.col("_relation")) & (F.col("seq") > F.col("since")) & (F.col("until").isNull() | (F.col("seq") < F.col("until")))
    read = events.join(valid, at, "left")
    most = F.greatest(*[F.coalesce(F.size(s), F.lit(0)) for s in ("before", "after")])
    reason = F.when(F.col("_relation").isNull(), "unknown relation").when(most > F.col("_names"), "more values than columns")
    read = read.withColumn("reason", reason).where((F.col("_table") == table) | F.col("reason").isNotNull())

    def image(side: str) -> Column:
        cells = [F.get(side, F.col(f"_at{i}")) for i in range(len(fields))]
        values = [F.when(c["kind"].isin("t", "b"), c["value"]).alias(f.name) for c, f in zip(cells, fields)]
        return F.when(F.col(side).isNotNull() & F.col("reason").isNull(), F.struct(*values)).alias(side)

    kinds = [F.get("after", F.col(f"_at{i}"))["kind"] for i in range(len(fields))]
    absent = [F.when(k.isNull() | (k == "u"), F.lit(f.name)) for k, f in zip(kinds, fields)]
    unchanged = F.when(F.col("kind") == "U", F.array_compact(F.array(*absent)))
    return read.select("seq", F.col("kind").alias("op"), image("before"), image("after"), unchanged.alias("unchanged"), "relation", "reason")


def decode(messages: DataFrame, known: Staged, table: str, fields: Sequence[T.StructField]) -> tuple[DataFrame, DataFrame]:
    """The feed of one table, its images as text by column name, and the events no version explains."""
    return split_read(read_events(messages, known, table, fields))


def split_read(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good events, rejects) of read ones."""
    good = read.where("reason IS NULL").drop("relation", "reason")
    return good, read.where("reason IS NOT NULL").select("seq", F.col("op").alias("kind"), "relation", "reason")


def widen(target: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """The target with the columns it lacks, null in every row."""
    return target.select(*[column(c) for c in target.columns], *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields if f.name not in target.columns])


def read_messages(messages: DataFrame, known: Staged, table: str, keys: Sequence[str], target: T.StructType) -> tuple[DataFrame, list[T.StructField]]:
    """``(events, fields)`` of a table, for ``split_read``; values that do not fit the widened target's types are rejects too."""
    fields = table_fields(known.df, table)
    if any(k not in {f.name for f in fields} for k in keys):
        # No message has told of the table: whatever its events are, none can be read.
        fields = fields + [T.StructField(k, T.StringType()) for k in keys if k not in {f.name for f in fields}]
    read = read_events(messages, known, table, fields)
    wide = T.StructType([*target.fields, *[f for f in fields if f.name not in target.names]])
    unread = F.col("reason").isNotNull()
    return read.withColumns({"reason": F.coalesce("reason", reject_reason(read, keys, wide)), "relation": F.when(unread, F.col("relation"))}), fields


def apply_messages(target: DataFrame, messages: DataFrame, table: str, keys: Sequence[str], mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    """``(the table after the messages, rejects)``."""
    known = Staged(versions(relation_messages(messages)), "relations")
    read, fields = read_messages(messages, known, table, keys, target.schema)
    good, bad = split_read(read)
    return apply_changes(widen(target, fields), good, keys, mode), bad
