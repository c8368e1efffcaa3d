"""Apply a change feed to a table: the result of replaying its events one by one, as set operations.

A feed row is ``(seq, op, before, after)``: ``op`` is I, U or D, ``before`` and
``after`` are row images (structs; a delete carries ``before``, the others
``after``), ``seq`` orders the events and is unique. An optional ``unchanged``
array names columns whose value the feed left out.

Per key, with ``d`` its last delete: events up to ``d`` do not matter. A row
that was there and never deleted takes the last update. Otherwise the first
insert after ``d`` revives the key, and the last update after that insert
decides its values; updates without an insert are lost.

What a stretch of events amounts to (last delete, first insert and last update
after it) can be told from what its parts amount to, so events are folded by key
and stretch of ``seq``, then stretches by key and longer stretch, until one is
left. No task gets more than a stretch of one key's events at a time, however
many the key has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from rowferry.model import FieldMapping
from rowferry.operators.mapping import column, rename_feed
from rowferry.operators.merge import outer_match, require_keys

# Binary digits of the order that one level of folding takes away: a group holds 2^16 numbers at most.
LEVEL_BITS = 16

# An order before that of any event.
BEFORE_ALL = -(2**63)

MODES = ("strict", "upsert")


def map_feed(feed: DataFrame, mappings: Sequence[FieldMapping]) -> DataFrame:
    """Rename the fields of both images; unmapped fields keep their name, disabled ones drop."""

    def image(name: str) -> Column:
        names = rename_feed(feed.schema[name].dataType.names, mappings)
        built = F.struct(*[F.col(name)[s].alias(t) for s, t in names.items()])
        return F.when(F.col(name).isNotNull(), built)

    out = feed
    for name in ("before", "after"):
        if name in feed.columns:
            out = out.withColumn(name, image(name))
    if "unchanged" in feed.columns:
        names = rename_feed(feed.schema["after"].dataType.names, mappings)
        renamed = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        out = out.withColumn("unchanged", F.transform("unchanged", lambda c: F.try_element_at(renamed, c)))
    return out


def reject_reason(feed: DataFrame, keys: Sequence[str], table: T.StructType | None = None) -> Column:
    """Why an event cannot be applied, null for a good one; see ``split_feed``."""
    no_image = F.when(F.col("op") == "D", _image(feed, "before", "after").isNull()).otherwise(_image(feed, "after").isNull())
    key_of = [_key(feed, k) for k in keys]
    null_key = F.lit(False)
    for k in key_of:
        null_key = null_key | k.isNull()
    reason = (
        F.when(F.col("seq").isNull(), "no sequence number")
        .when(F.col("op").isNull() | ~F.col("op").isin("I", "U", "D"), "unknown operation")
        .when(no_image, "no row image")
        .when(null_key, "null key")
    )
    if table is not None:
        types = {f.name: f.dataType for f in table.fields}
        bad_key = F.lit(False)
        for k, value in zip(keys, key_of):
            if k in types:
                bad_key = bad_key | _unfit(value, feed.schema["after"].dataType[k].dataType, types[k])
        bad_value = F.lit(False)
        for f in feed.schema["after"].dataType.fields:
            if f.name in types and f.name not in keys:
                bad_value = bad_value | _unfit(F.col("after")[f.name], f.dataType, types[f.name])
        reason = reason.when(bad_key, "key of another type").when(F.col("op").isin("I", "U") & bad_value, "value of another type")
    if "_corrupt_record" in feed.columns:
        reason = F.when(F.col("_corrupt_record").isNotNull(), "unreadable").otherwise(reason)
    return reason


def split_feed(feed: DataFrame, keys: Sequence[str], table: T.StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """(good events, rejects with a ``reason``): a bad event never stops the feed.

    With the schema of the ``table`` it applies to, events whose key or values
    do not convert to the table's types are rejected too, rather than lost or
    turned to null on the way.
    """
    marked = feed.withColumn("reason", reject_reason(feed, keys, table))
    return marked.where("reason IS NULL").drop("reason", "_corrupt_record"), marked.where("reason IS NOT NULL")


def _image(feed: DataFrame, *names: str) -> Column:
    present = [F.col(n) for n in names if n in feed.columns]
    return F.coalesce(*present) if len(present) > 1 else present[0]


def _key(feed: DataFrame, k: str) -> Column:
    """The key an event addresses: that of the image its operation carries."""
    after = F.col("after")[k]
    if "before" not in feed.columns or k not in feed.schema["before"].dataType.names:
        return after
    before = F.col("before")[k]
    return F.when(F.col("op") == "D", F.coalesce(before, after)).otherwise(after)


def _events(feed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per event: ``k0..``, ``ord``, ``op``, ``image`` (and ``unchanged``).

    An update that moves a row to another key becomes delete old, delete new,
    insert new; ``ord`` leaves room for the three within one ``seq``.
    """
    image = F.col("after")
    moves = "before" in feed.columns and all(k in feed.schema["before"].dataType.names for k in keys)
    unchanged = F.col("unchanged") if "unchanged" in feed.columns else F.lit(None).cast("array<string>")
    new = [_key(feed, k) for k in keys]
    if not moves:
        return feed.select(*[k.alias(f"k{i}") for i, k in enumerate(new)], F.col("seq").alias("ord"), "op", image.alias("image"), unchanged.alias("unchanged"))
    old = [F.col("before")[k] for k in keys]
    moved = F.lit(False)
    for o, n in zip(old, new):
        moved = moved | (o.isNotNull() & ~o.eqNullSafe(n))

    # A moved row keeps what the feed left out, as far as its old image tells.
    before_names = feed.schema["before"].dataType.names
    after_names = feed.schema["after"].dataType.names
    absent = F.coalesce(unchanged, F.array().cast("array<string>"))
    carried = F.struct(
        *[
            (F.when(F.array_contains(absent, c), F.col("before")[c]).otherwise(image[c]) if c in before_names else image[c]).alias(c)
            for c in after_names
        ]
    )

    def event(key: Sequence[Column], sub: int, op: Column, img: Column, unch: Column) -> Column:
        return F.struct(
            *[k.alias(f"k{i}") for i, k in enumerate(key)],
            (F.col("seq") * 4 + sub).alias("ord"),
            op.alias("op"),
            img.alias("image"),
            unch.alias("unchanged"),
        )

    none = F.lit(None).cast(feed.schema["after"].dataType)
    no_names = F.lit(None).cast("array<string>")
    plain = F.array(event(new, 0, F.col("op"), image, unchanged))
    move = F.array(
        event(old, 0, F.lit("D"), none, no_names),
        event(new, 1, F.lit("D"), none, no_names),
        event(new, 2, F.lit("I"), carried, no_names),
    )
    is_move = (F.col("op") == "U") & moved
    return feed.select(F.explode(F.when(is_move, move).otherwise(plain)).alias("e")).select("e.*")


def _units(events: DataFrame, feed: DataFrame, keys: Sequence[str], partial: bool) -> DataFrame:
    """Each event as a stretch of its own: ``del_ord``, ``ins``/``ins_ord``, ``upd``/``upd_ord``, and values sent."""
    op, order = F.col("op"), F.col("ord")
    image = F.col("image")
    out = [
        F.when(op == "D", order).alias("del_ord"),
        F.when(op == "I", image).alias("ins"),
        F.when(op == "I", order).alias("ins_ord"),
        F.when(op == "U", image).alias("upd"),
        F.when(op == "U", order).alias("upd_ord"),
    ]
    if partial:
        for i, c in enumerate(_free_columns(feed, keys)):
            sent = (op == "U") & ~F.coalesce(F.array_contains("unchanged", c), F.lit(False))
            out += [F.when(sent, image[c]).alias(f"v{i}"), F.when(sent, order).alias(f"o{i}")]
    return events.select(*[f"k{i}" for i in range(len(keys))], "ord", *out)


def _fold_stretches(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Stretches of one group as one stretch: what counts is after the group's last delete.

    The last delete is a window over the group and the rest an aggregate by the same columns, so rows move once.
    """
    last = F.max("del_ord").over(Window.partitionBy(*by))
    marked = parts.withColumn("_last", F.coalesce(last, F.lit(BEFORE_ALL)))

    def after(order: str) -> Column:
        return F.when(F.col(order) > F.col("_last"), F.col(order))

    aggs = [
        F.max("del_ord").alias("del_ord"),
        F.min_by("ins", after("ins_ord")).alias("ins"),
        F.min(after("ins_ord")).alias("ins_ord"),
        F.max_by("upd", after("upd_ord")).alias("upd"),
        F.max(after("upd_ord")).alias("upd_ord"),
    ]
    for name in [c for c in parts.columns if c.startswith("o") and c[1:].isdigit()]:
        aggs += [F.max_by("v" + name[1:], after(name)).alias("v" + name[1:]), F.max(after(name)).alias(name)]
    return marked.groupBy(*by).agg(*aggs, F.min("ord").alias("ord"))


def _levels(events: DataFrame, bits: int) -> tuple[int, int]:
    """The smallest order and how many levels of folding the span asks for: one narrow aggregate."""
    low, high = events.agg(F.min("ord"), F.max("ord")).first()
    span = 0 if low is None else high - low
    return low or 0, max(1, -(-span.bit_length() // bits))


def fold_events(feed: DataFrame, keys: Sequence[str], mode: str = "strict", level_bits: int = LEVEL_BITS) -> DataFrame:
    """One row per key that saw an event: what its events amount to.

    Columns ``k0..``; ``del_ord`` the last delete; ``ins``/``ins_ord`` the reviving insert;
    ``upd``/``upd_ord`` the last update; and, where the feed leaves values out,
    ``v<n>``/``o<n>`` the last value it did send. A group of events that are folded together
    spans ``2 ** level_bits`` numbers of the order.
    """
    if mode not in MODES:
        raise ValueError(f"unknown change mode: {mode}")
    partial = "unchanged" in feed.columns
    events = _events(feed, keys)
    k = [f"k{i}" for i in range(len(keys))]
    # A change without a key addresses no row.
    for name in k:
        events = events.where(F.col(name).isNotNull())
    if mode == "strict":
        low, levels = _levels(events, level_bits)
        folded = _units(events, feed, keys, partial)
        for level in range(1, levels):
            stretch = F.shiftright(F.col("ord") - F.lit(low), level * level_bits)
            folded = _fold_stretches(folded.withColumn("_stretch", stretch), [*k, "_stretch"]).drop("_stretch")
        return _fold_stretches(folded, k).drop("ord")
    # Both writes set the row, so only the last one counts and no event needs to know the last delete.
    op, order = F.col("op"), F.col("ord")
    is_update = op.isin("I", "U")
    aggs = [
        F.max(F.when(op == "D", order)).alias("del_ord"),
        F.lit(None).cast(feed.schema["after"].dataType).alias("ins"),
        F.lit(None).cast("long").alias("ins_ord"),
        F.max_by("image", F.when(is_update, order)).alias("upd"),
        F.max(F.when(is_update, order)).alias("upd_ord"),
    ]
    if partial:
        sent = lambda c: F.when(is_update & ~F.coalesce(F.array_contains("unchanged", c), F.lit(False)), order)
        for i, c in enumerate(_free_columns(feed, keys)):
            aggs += [F.max_by(F.col("image")[c], sent(c)).alias(f"v{i}"), F.max(sent(c)).alias(f"o{i}")]
    folded = events.groupBy(*k).agg(*aggs)
    live = F.col("del_ord").isNull() | (F.col("upd_ord") > F.col("del_ord"))
    return folded.withColumn("upd", F.when(live, F.col("upd"))).withColumn("upd_ord", F.when(live, F.col("upd_ord")))


def _free_columns(feed: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in feed.schema["after"].dataType.names if c not in keys]


def apply_changes(
    target: DataFrame,
    feed: DataFrame,
    keys: Sequence[str],
    mode: str = "strict",
    mappings: Sequence[FieldMapping] = (),
    level_bits: int = LEVEL_BITS,
) -> DataFrame:
    """The whole target after the feed.

    ``strict`` replays like a database with a primary key: an insert of a
    present key and an update of an absent one do nothing. ``upsert`` lets both
    set the row, for feeds that deliver an event more than once. Feed columns
    new to the target are added; columns only the target has keep their value
    on rows that live on and are null on revived ones.
    """
    if mappings:
        feed = map_feed(feed, mappings)
    require_keys(keys, target.columns)
    return settle(target, fold_events(feed, keys, mode, level_bits), keys, feed.schema["after"].dataType, mode)


def settle(
    target: DataFrame, folded: DataFrame, keys: Sequence[str], image: T.StructType, mode: str = "strict", small: bool = False
) -> DataFrame:
    """Bring the outcome of ``fold_events`` into the target; ``image`` is the feed's row type.

    ``small`` broadcasts the outcome, whose size the caller has checked, so the
    target is not shuffled.
    """
    partial = "o0" in folded.columns
    k = [f"k{i}" for i in range(len(keys))]
    joined = outer_match(target.withColumn("_here", F.lit(True)), folded, keys, k, small, null_keys=False)

    here = F.col("_here").isNotNull()
    alive = here & F.col("del_ord").isNull()
    has_upd = F.col("upd_ord").isNotNull()
    if mode == "strict":
        revived = ~alive & F.col("ins_ord").isNotNull()
        upd_counts = has_upd & (alive | (F.col("upd_ord") > F.col("ins_ord")))
    else:
        revived = ~alive & has_upd
        upd_counts = has_upd
    image_fields = {f.name: f.dataType for f in image.fields}
    target_types = {f.name: f.dataType for f in target.schema.fields}
    free = [c for c in image.names if c not in keys]

    def sent(c: str) -> Column:
        """The feed's value of a column, falling back to what the key last had."""
        if not partial:
            return F.when(upd_counts, F.col("upd")[c]).otherwise(F.col("ins")[c])
        i = free.index(c)
        floor = F.coalesce(F.greatest("ins_ord", "del_ord"), F.lit(BEFORE_ALL))
        usable = F.col(f"o{i}").isNotNull() & (alive | (F.col(f"o{i}") > floor))
        kept = column(c) if c in target_types else F.lit(None)
        return F.when(usable, F.col(f"v{i}")).when(alive, kept).otherwise(F.col("ins")[c])

    out = []
    for c in [*target.columns, *[c for c in image_fields if c not in target_types]]:
        kind = target_types.get(c) or image_fields[c]
        if c in keys:
            value = F.coalesce(column(c), F.col(k[keys.index(c)]).cast(kind))
        elif c not in image_fields:
            value = F.when(alive, column(c))
        else:
            old = column(c) if c in target_types else F.lit(None)
            value = F.when(upd_counts | revived, convert(sent(c), image_fields[c], kind)).when(alive, old)
        out.append(value.alias(c))
    return joined.where(alive | revived).select(out)


def _unfit(value: Column, source: T.DataType, target: T.DataType) -> Column:
    """Whether a value that is there is lost by conversion."""
    if source == target or isinstance(source, (T.StructType, T.ArrayType, T.MapType)):
        return F.lit(False)
    if isinstance(target, T.BooleanType) and isinstance(source, T.StringType):
        return value.isNotNull() & ~value.isin("t", "true", "f", "false")
    return value.isNotNull() & value.try_cast(target).isNull()


def convert(value: Column, source: T.DataType, target: T.DataType) -> Column:
    """Feed text to the target's type; ``t`` and ``true`` are true, a bad value becomes null."""
    if source == target:
        return value
    if isinstance(target, T.BooleanType) and isinstance(source, T.StringType):
        return value.isin("t", "true")
    if isinstance(source, (T.StructType, T.ArrayType, T.MapType)):
        return value.cast(target)
    return value.try_cast(target)


def apply_keyless(target: DataFrame, feed: DataFrame) -> DataFrame:
    """A feed whose table has no key: inserts add rows, deletes remove equal rows, updates are skipped.

    A delete matches on its non-null columns only. Deletes are grouped by which
    columns those are; each such pattern is one equi-join against the latest
    delete of each value, and a row falls if a later delete names it. The loop
    runs over patterns (a handful of column subsets), not over rows.
    """
    fields = feed.schema["after"].dataType.names
    none = F.lit(None).cast("long")
    rows = target.withColumn("_seq", none).unionByName(
        feed.where("op = 'I'").select(F.col("after.*"), F.col("seq").alias("_seq")), allowMissingColumns=True
    )
    image = _image(feed, "before", "after")
    gone = feed.where("op = 'D'").select(F.col("seq"), *[image[c].alias(c) for c in fields])
    gone = gone.withColumn("_set", F.concat_ws(",", *[F.when(column(c).isNotNull(), F.lit(str(i))) for i, c in enumerate(fields)]))
    for (pattern,) in gone.select("_set").distinct().where("_set <> ''").collect():
        cols = [fields[int(i)] for i in pattern.split(",")]
        last = gone.where(F.col("_set") == pattern).groupBy(*[column(c) for c in cols]).agg(F.max("seq").alias("_gone"))
        hit = F.col("_gone").isNotNull() & (F.col("_seq").isNull() | (F.col("_gone") > F.col("_seq")))
        rows = rows.join(last, cols, "left").where(~hit).drop("_gone")
    return rows.select(*[column(c) for c in [*target.columns, *[c for c in fields if c not in target.columns]]])
