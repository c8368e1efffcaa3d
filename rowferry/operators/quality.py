"""Row-count checks, sampled and full field comparison, and the status they lead to."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rowferry.functions.compare import values_match
from rowferry.operators.mapping import column
from rowferry.operators.merge import hash_parts, keep_first
from rowferry.operators.shards import Cuts, balanced_cuts
from rowferry.session import Staged, remove, small_frame

# Rows sampled by default, and the limits of the status rules.
SAMPLE_SIZE = 50
MAX_COUNT_DIFF = 0.01
MIN_MATCH_RATIO = 0.98

# The most keys a sample may hold: they pass through the driver and are broadcast.
MAX_SAMPLE = 10_000


def row_counts(source: DataFrame, target: DataFrame, counted: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """One row ``(source_rows, target_rows)``; each side is one partial count unless it is given."""
    zero = F.lit(0).cast("long")

    def one(df: DataFrame, name: str, known: int | None) -> DataFrame:
        if known is None:
            return df.agg(F.count("*").alias(name))
        return df.sparkSession.range(0, 1, 1, 1).select(F.lit(known).cast("long").alias(name))

    s = one(source, "source_rows", counted[0]).withColumn("target_rows", zero)
    t = one(target, "target_rows", counted[1]).select(zero.alias("source_rows"), "target_rows")
    return s.unionByName(t).agg(F.sum("source_rows").alias("source_rows"), F.sum("target_rows").alias("target_rows"))


def pick_keys(df: DataFrame, keys: Sequence[str], n: int = SAMPLE_SIZE, how: str = "random", seed: int = 42) -> DataFrame:
    """Keys of ``n`` rows to verify: by key hash (the same rows every time) or the first by key.

    A top-n over the key columns alone: each task keeps ``n`` keys at most.
    """
    by_key = [column(k) for k in keys]
    narrow = df.select(*by_key)
    if how == "first":
        return narrow.orderBy(*by_key).limit(n)
    if how != "random":
        raise ValueError(f"unknown sampling: {how}")
    return narrow.orderBy(F.xxhash64(*by_key, F.lit(seed)), *by_key).limit(n)


def _sides(source: DataFrame, target: DataFrame, keys, pairs):
    """Both sides under fixed names: k0.. for keys, s0../t0.. for the compared columns."""
    renames = dict(pairs)
    tkeys = [renames.get(k, k) for k in keys]
    s = source.select(
        [column(k).alias(f"k{i}") for i, k in enumerate(keys)] + [column(a).alias(f"s{i}") for i, (a, _) in enumerate(pairs)]
    )
    t = target.select(
        [column(k).alias(f"k{i}") for i, k in enumerate(tkeys)] + [column(b).alias(f"t{i}") for i, (_, b) in enumerate(pairs)]
    )
    return s, t, [f"k{i}" for i in range(len(keys))]


def _column_matches(s: DataFrame, t: DataFrame, n: int, tolerance: float) -> list[Column]:
    return [
        values_match(F.col(f"s{i}"), F.col(f"t{i}"), s.schema[f"s{i}"].dataType, t.schema[f"t{i}"].dataType, tolerance)
        for i in range(n)
    ]


def _all(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def sample_compare(
    source: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    pairs: Sequence[tuple[str, str]],
    n: int = SAMPLE_SIZE,
    how: str = "random",
    seed: int = 42,
    tolerance: float = 1e-4,
) -> DataFrame:
    """One row ``(sample_total, sample_matched)`` over ``n`` source rows.

    The sampled keys, ``n`` at most, are read first and then filter both sides
    as a literal list: parquet skips row groups by it, a database uses its
    index. A key missing from the target counts as unmatched. The first source
    row of a key stands for it; target repeats fold into one flag.
    """
    if n > MAX_SAMPLE:
        raise ValueError(f"a sample holds {MAX_SAMPLE} rows at most; use the full comparison")
    picked = sorted({tuple(r) for r in pick_keys(source, keys, n, how, seed).collect()}, key=repr)
    s, t, k = _sides(source, target, keys, pairs)
    for i, name in enumerate(k):
        values = list({p[i] for p in picked})
        s, t = s.where(column(name).isin(values)), t.where(column(name).isin(values))
    if len(k) > 1:
        # Several key columns: the lists let other combinations through, the exact keys do not.
        spark = source.sparkSession
        wanted = F.broadcast(spark.createDataFrame(picked, s.select(*k).schema))
        s, t = s.join(wanted, k, "left_semi"), t.join(wanted, k, "left_semi")
    first = F.broadcast(keep_first(s, k, []))
    hit = F.max(_all(_column_matches(s, t, len(pairs), tolerance)).cast("long"))
    flags = t.join(first, k).groupBy(*k).agg(hit.alias("hit"))
    return flags.agg(
        F.lit(len(picked)).cast("long").alias("sample_total"), F.coalesce(F.sum("hit"), F.lit(0)).alias("sample_matched")
    )


def with_status(result: DataFrame) -> DataFrame:
    """Add ``status``: passed, warning or failed.

    A count difference over 1% fails, any other count difference warns (and
    settles the matter before the sample is looked at); then a match ratio
    under 98% fails. An empty source skips the count rule.
    """
    diff = F.abs(F.col("source_rows") - F.col("target_rows")) / F.col("source_rows")
    ratio = F.col("sample_matched") / F.col("sample_total")
    counted = F.col("source_rows") > 0
    return result.withColumn(
        "status",
        F.when(counted & (diff > MAX_COUNT_DIFF), "failed")
        .when(counted & (diff > 0), "warning")
        .when((F.col("sample_total") > 0) & (ratio < MIN_MATCH_RATIO), "failed")
        .otherwise("passed"),
    )


def check_quality(
    source: DataFrame,
    target: DataFrame,
    pairs: Sequence[tuple[str, str]],
    keys: Sequence[str] = (),
    n: int = SAMPLE_SIZE,
    how: str = "random",
    target_filter: str = "",
    counted: tuple[int | None, int | None] = (None, None),
) -> DataFrame:
    """One row: both counts, the sample outcome and the status.

    ``source`` comes filtered as the copy was; the target is counted whole
    unless ``target_filter`` narrows it to the copied slice. Without keys the
    sample is skipped. ``counted`` gives counts a source has already made.
    """
    slice_ = target.where(target_filter) if target_filter else target
    zero = F.lit(0).cast("long")
    counts = row_counts(source, slice_, counted).withColumn("sample_total", zero).withColumn("sample_matched", zero)
    if keys:
        sample = sample_compare(source, target, keys, pairs, n, how)
        counts = counts.unionByName(sample.select(zero.alias("source_rows"), zero.alias("target_rows"), "*")).agg(
            *[F.sum(c).alias(c) for c in counts.columns]
        )
    return with_status(counts)


DIFFERS = "source_rows <> 1 OR target_rows <> 1 OR ds <> dt OR no_key"


def key_digests(source: DataFrame, target: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Per key the number of rows and a digest of the compared columns, for both sides."""
    s, t, k = _sides(source, target, keys, pairs)
    types = {i: (s.schema[f"s{i}"].dataType, t.schema[f"t{i}"].dataType) for i in range(len(pairs))}

    def digest(side: str) -> Column:
        # Columns of unlike types are digested as text, where equal text counts as equal.
        frame = s if side == "s" else t
        parts: list[Column] = []
        for i, (a, b) in types.items():
            null, value = hash_parts(frame, [f"{side}{i}"])
            parts += [null, value if a == b else F.col(f"{side}{i}").cast("string")]
        return F.xxhash64(*parts) if parts else F.lit(0).cast("long")

    null = F.lit(None).cast("long")
    rows = s.select(*k, digest("s").alias("ds"), null.alias("dt")).unionByName(t.select(*k, null.alias("ds"), digest("t").alias("dt")))
    grouped = rows.groupBy(*k).agg(
        F.count("ds").alias("source_rows"), F.count("dt").alias("target_rows"), F.max("ds").alias("ds"), F.max("dt").alias("dt")
    )
    return grouped.withColumn("no_key", reduce(lambda a, b: a | b, [F.col(c).isNull() for c in k]))


def differing_keys(source: DataFrame, target: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Keys whose rows are not bit-equal on both sides, without moving the rows.

    Only the key and one 8-byte row digest per row are shuffled, folded in the
    map tasks, so two nearly equal wide tables compare at a small part of their
    size. Keys repeated on a side are listed too, as a digest cannot clear them,
    and so are null keys, which equal nothing.
    """
    names = [F.col(f"k{i}").alias(name) for i, name in enumerate(keys)]
    return key_digests(source, target, keys, pairs).where(DIFFERS).select(*names, "source_rows", "target_rows")


# Ranges of a level of the descent, and rows from which on a region is cut again.
RANGES = 64
LEAST_REGION = 1_000_000


def _range_digests(side: DataFrame, cuts: Cuts, parts: Sequence[Column]) -> DataFrame:
    """Per key range the number of rows and sums of their hashes that do not depend on order."""
    h = F.xxhash64(*parts)
    rows = side.select(cuts.shard_of("k0").alias("shard"), h.alias("h"))
    return rows.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.shiftright("h", 32)).alias("high"), F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low")
    )


def differing_region(source: DataFrame, target: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]], ranges: int = RANGES, least: int = LEAST_REGION) -> tuple[str, int]:
    """A condition on ``k0`` for the key ranges whose rows are not the same on both sides, and how often rows were read.

    One pass over both sides gives a digest for each of ``ranges`` ranges; only
    those that differ are cut again and read again, through a filter on the
    key that reaches row groups or the source's index, until what is left has few rows
    or mostly differs.
    """
    s, t, k = _sides(source, target, keys, pairs)
    parts = {side: _digest_parts(s, t, side, len(pairs), k) for side in "st"}
    region, level = "true", 0
    while True:
        here, there = s.where(region), t.where(region)
        cuts = balanced_cuts(here, "k0", ranges)
        both = _range_digests(here, cuts, parts["s"]).withColumn("side", F.lit(1)).unionByName(_range_digests(there, cuts, parts["t"]).withColumn("side", F.lit(2)))
        found = both.groupBy("shard").agg(
            F.sum("n").alias("n"), (F.count(F.lit(1)) < 2).alias("alone"), *[(F.min(c) != F.max(c)).alias(f"d_{c}") for c in ("x", "high", "low")], (F.min("n") != F.max("n")).alias("d_n")
        ).collect()
        level += 1
        bad = [r for r in found if r["alone"] or r["d_n"] or r["d_x"] or r["d_high"] or r["d_low"]]
        if not bad:
            return "false", level
        predicates = cuts.predicates("k0")
        region = f"({region}) AND (" + " OR ".join(f"({predicates[r['shard']]})" for r in sorted(bad, key=lambda r: r["shard"])) + ")"
        if sum(r["n"] for r in bad) <= least or 2 * len(bad) > len(found):
            return region, level


def _digest_parts(s: DataFrame, t: DataFrame, side: str, n: int, k: Sequence[str]) -> list[Column]:
    """What a row's hash is made of: keys as text, and values as text where the sides' types differ."""
    frame, out = (s if side == "s" else t), [F.col(c).cast("string") for c in k]
    for i in range(n):
        null, value = hash_parts(frame, [f"{side}{i}"])
        same = s.schema[f"s{i}"].dataType == t.schema[f"t{i}"].dataType
        out += [null, value if same else F.col(f"{side}{i}").cast("string")]
    return out


def descend(source: DataFrame, target: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]], ranges: int = RANGES, least: int = LEAST_REGION) -> DataFrame:
    """``differing_keys`` of two large tables that are nearly equal, reading all rows once and the differing ranges again.

    Nothing but one row a range moves until the region is small. A key that is
    repeated in the same way on both sides counts as equal here; null keys,
    which equal nothing, are listed as always.
    """
    region, _ = differing_region(source, target, keys, pairs, ranges, least)
    s, t, k = _sides(source, target, keys, pairs)
    some = F.expr(region) | reduce(lambda a, b: a | b, [F.col(c).isNull() for c in k])
    found = differing_keys(s.where(some), t.where(some), k, [(f"s{i}", f"t{i}") for i in range(len(pairs))])
    return found.select(*[F.col(c).alias(name) for c, name in zip(k, keys)], "source_rows", "target_rows")


def full_compare(
    source: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    pairs: Sequence[tuple[str, str]],
    tolerance: float = 1e-4,
    unique: bool = False,
) -> DataFrame:
    """The sample comparison with the sample set to everything, plus mismatches per column.

    One row: ``source_keys``, ``matched``, ``missing`` (no target row),
    ``extra`` (no source row), ``diff_<source column>`` for each pair, and
    ``source_repeats`` and ``target_repeats``, the rows beyond the first of each
    key. With ``unique`` both sides are trusted to hold one row per key;
    otherwise the first row of each key stands for it, so the join never
    multiplies, and repeats are counted over the keys alone.
    """
    s, t, k = _sides(source, target, keys, pairs)
    counts = None
    if not unique:
        counts = _repeats(s, t, k)
        s, t = keep_first(s, k, []), keep_first(t, k, [])
    matches = _column_matches(s, t, len(pairs), tolerance)
    here = F.col("_s").isNotNull()
    there = F.col("_t").isNotNull()
    joined = s.withColumn("_s", F.lit(1)).join(t.withColumn("_t", F.lit(1)), k, "full_outer")
    both = here & there
    found = joined.agg(
        F.count_if(here).alias("source_keys"),
        F.count_if(both & _all(matches)).alias("matched"),
        F.count_if(here & ~there).alias("missing"),
        F.count_if(there & ~here).alias("extra"),
        *[F.count_if(both & ~m).alias(f"diff_{a}") for m, (a, _) in zip(matches, pairs)],
    )
    names = [f.name for f in found.schema.fields]
    zero = F.lit(0).cast("long")
    if counts is None:
        return found.select("*", *[zero.alias(c) for c in REPEATS])
    # Two single rows become one by adding up what the other lacks.
    both_rows = found.select("*", *[zero.alias(c) for c in REPEATS]).unionByName(counts.select(*[zero.alias(c) for c in names], *REPEATS))
    return both_rows.agg(*[F.sum(c).alias(c) for c in (*names, *REPEATS)])


REPEATS = ("source_repeats", "target_repeats")


def _repeats(s: DataFrame, t: DataFrame, k: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key, on either side: counts that combine in the map tasks."""
    one, zero = F.lit(1), F.lit(0)
    rows = s.select(*k, one.alias("a"), zero.alias("b")).unionByName(t.select(*k, zero.alias("a"), one.alias("b")))
    per_key = rows.groupBy(*k).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    more = lambda c: F.coalesce(F.sum(F.greatest(F.col(c) - 1, F.lit(0))), F.lit(0)).cast("long")
    return per_key.agg(more("a").alias(REPEATS[0]), more("b").alias(REPEATS[1]))


def compare_tables(
    source: DataFrame, target: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]], tolerance: float = 1e-4
) -> DataFrame:
    """``full_compare`` of two large tables that should be nearly equal, with little moved.

    One pass of row digests finds the keys that differ at all; only the rows of
    those keys are then compared field by field. The differing keys are staged,
    so their size decides between a broadcast and a shuffle.
    """
    from pyspark.sql import Observation

    seen = Observation()
    more = lambda c: F.coalesce(F.sum(F.greatest(F.col(c) - 1, F.lit(0))), F.lit(0)).cast("long")
    grouped = key_digests(source, target, keys, pairs).observe(
        seen, F.count_if(F.col("source_rows") > 0).alias("source_keys"), more("source_rows").alias("source_repeats"), more("target_rows").alias("target_repeats")
    )
    k = [f"k{i}" for i in range(len(keys))]
    staged = Staged(grouped.where(DIFFERS).select(*k), "differing")
    wanted = F.broadcast(staged.df) if staged.small else staged.df
    s, t, _ = _sides(source, target, keys, pairs)

    def only(side: DataFrame) -> DataFrame:
        same = [F.col(c).eqNullSafe(F.col(f"w_{c}")) for c in k]
        return side.join(wanted.select([F.col(c).alias(f"w_{c}") for c in k]), same, "left_semi")

    names = [(f"s{i}", f"t{i}") for i in range(len(pairs))]
    # Repeats were seen in the digests, so the rest is compared without counting them again, and runs once.
    rest = full_compare(keep_first(only(s), k, []), keep_first(only(t), k, []), k, names, tolerance, unique=True)
    row = rest.first().asDict()
    equal = seen.get["source_keys"] - row["source_keys"]
    row |= {"source_keys": row["source_keys"] + equal, "matched": row["matched"] + equal, **{c: seen.get[c] for c in REPEATS}}
    renamed = {f"diff_s{i}": f"diff_{a}" for i, (a, _) in enumerate(pairs)}
    remove(source.sparkSession, staged.path)
    return small_frame(source.sparkSession, [tuple(row[f] for f in rest.columns)], ", ".join(f"`{renamed.get(f, f)}` long" for f in rest.columns))
