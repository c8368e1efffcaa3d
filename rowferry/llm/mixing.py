"""Mixing sources to target weights: a token budget runs down a tree of domains, languages and sources.

At each node the budget is split by the children's weights, none above what its
subtree holds in all allowed epochs; what one child lacks goes to its siblings,
and only what a whole family lacks goes to the siblings of an ancestor. A leaf
is then read in whole epochs, and its last epoch up to the token where its
budget ends, in an order seeded by leaf epoch and document; ``mix`` cuts the
last text there. Everything is built from DataFrame functions.

The end of a leaf's prefix is found by three narrowing looks at sums over hash
ranges, so no leaf is ever sorted or held in one task.

Nulls: null texts have no tokens and null levels are a value of their own. A
null ``doc_id`` orders as the empty text. Rows that repeat an id are ordered by a
hash of their text; where that is equal too they enter one by one, in no
certain order. A weight of zero takes nothing. With less text than budget everything is taken in all epochs. An empty
table gives an empty result. Other columns are kept by ``mixed``, whatever they
are called but for names beginning with ``_mix``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowferry.session import Staged

WORD = r"[^\x20\x09-\x0D]+"
NONE = "(none)"
LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mixture:
    """Weights are whole numbers by value, 1 where none is given; the budget is a percentage of all tokens there are."""

    domains: dict[str, str] = field(default_factory=dict)  # source: domain; others are ``other_domain``
    other_domain: str = "web"
    weights: dict[str, dict[str, int]] = field(default_factory=dict)  # level: value: weight
    budget_percent: int = 100
    epochs: int = 2
    seed: int = 7


STANDARD = Mixture(
    domains={"src1": "books", "src2": "books", "src3": "books", "src4": "reference", "src5": "reference", "src6": "forums", "src7": "forums", "src8": "forums"},
    weights={"domain": {"web": 5, "books": 2, "reference": 2, "forums": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}},
)


def leaf_columns(m: Mixture) -> dict[str, Column]:
    source = F.coalesce(F.col("source"), F.lit(NONE))
    domain = F.lit(m.other_domain)
    if m.domains:
        domain = F.coalesce(F.create_map(*[F.lit(x) for pair in sorted(m.domains.items()) for x in pair])[source], domain)
    return {"_mix_domain": domain, "_mix_lang": F.coalesce(F.col("lang"), F.lit(NONE)), "_mix_source": source}


def _weight(m: Mixture, level: str) -> Column:
    given = m.weights.get(level, {})
    if not given:
        return F.lit(1).cast("long")
    return F.coalesce(F.create_map(*[x for k, v in sorted(given.items()) for x in (F.lit(k), F.lit(v))])[F.col(f"_mix_{level}")], F.lit(1)).cast("long")


def _split(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Divide each parent's ``budget`` among its children by ``weight``, none above its ``cap``; adds ``share``."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    by_need = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), name) if parent else Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), name)
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    live = children.where("weight > 0")
    rows = live.withColumns({
        "before": F.coalesce(F.sum("cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")),
        "from": F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing)),
    })
    rows = rows.withColumn("full", wide("cap") * wide("from") <= (wide("budget") - wide("before")) * wide("weight"))
    rows = rows.withColumns({
        "left": F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(family), F.lit(0).cast("long")),
        "open": F.sum(F.when(~F.col("full"), F.col("weight"))).over(family),
        "run": F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(F.lit(0).cast("long"))).over(by_need),
    })
    # Rounding the running sum keeps the parts whole and their sum exact.
    part = F.expr("(cast(left as decimal(38,0)) * run) div open - (cast(left as decimal(38,0)) * (run - weight)) div open")
    return rows.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(part)).drop("before", "from", "full", "left", "open", "run", "budget", "cap", "weight")


def budgets(leaves: DataFrame, m: Mixture) -> DataFrame:
    """``leaves`` has ``_mix_domain, _mix_lang, _mix_source, held`` (tokens of one epoch); adds ``share`` (tokens to take)."""
    names = [f"_mix_{x}" for x in LEVELS]
    capped = leaves.withColumn("cap", F.col("held") * m.epochs)
    total = leaves.agg(F.sum("held")).first()[0] or 0
    above = capped.groupBy(names[0]).agg(F.sum("cap").alias("cap")).withColumn("budget", F.lit(int(total) * m.budget_percent // 100).cast("long"))
    level = _split(above.withColumn("weight", _weight(m, LEVELS[0])), [], names[0])
    for k in (1, 2):
        keys = names[: k + 1]
        below = capped.groupBy(*keys).agg(F.sum("cap").alias("cap")).join(level.withColumnRenamed("share", "budget"), names[:k])
        level = _split(below.withColumn("weight", _weight(m, LEVELS[k])), names[:k], names[k])
    return leaves.join(level, names, "left").withColumn("share", F.coalesce("share", F.lit(0).cast("long")))


def _order(seed: int, epoch: Column) -> Column:
    """Where a document stands in an epoch of its leaf: 64 hexadecimal digits, of the seeded id and of the text."""
    placed = F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return F.concat(placed, F.col("_mix_text"))


def _text_hash() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def _narrow(rows: DataFrame, plan: DataFrame, names: list[str], digits: Column, at: str) -> DataFrame:
    """The range of the order in which each leaf's remainder runs out: adds ``at``, and moves ``done`` up to its begin."""
    sums = rows.groupBy(*names, digits.alias(at)).agg(F.sum("_mix_tokens").alias("sum"))
    so_far = F.sum("sum").over(Window.partitionBy(*names).orderBy(at))
    sums = sums.withColumn("upto", so_far).join(plan.select(*names, "rest", "done"), names)
    end = sums.where((F.col("done") + F.col("upto") >= F.col("rest")) & (F.col("done") + F.col("upto") - F.col("sum") < F.col("rest")))
    end = end.select(*names, at, (F.col("done") + F.col("upto") - F.col("sum")).alias("done"))
    return plan.drop("done").join(end, names, "left")


def mix_plan(docs: DataFrame, m: Mixture = STANDARD) -> Staged:
    """Per leaf its tokens, its share, whole epochs, and where and after how many tokens of a document the last one ends."""
    names = [f"_mix_{x}" for x in LEVELS]
    tokens = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    measured = Staged(docs.select(*[c.alias(n) for n, c in leaf_columns(m).items()], "doc_id", _text_hash().alias("_mix_text"), tokens.alias("_mix_tokens")), "tokens").df
    leaves = Staged(measured.groupBy(*names).agg(F.sum("_mix_tokens").alias("held")), "leaves").df
    plan = budgets(leaves, m).withColumn("whole", F.when(F.col("held") > 0, F.expr("share div held")).otherwise(F.lit(0).cast("long")))
    plan = Staged(plan.withColumn("rest", F.col("share") - F.col("whole") * F.col("held")).withColumn("done", F.lit(0).cast("long")), "plan")
    ordered = _beside(measured, plan, names, {"whole": "whole", "rest": "rest"}).where("rest > 0").select(*names, "_mix_tokens", _order(m.seed, F.col("whole")).alias("_mix_order"))
    ordered = Staged(ordered, "ordered").df
    upper, lower = F.substring("_mix_order", 1, 3), F.substring("_mix_order", 4, 3)
    plan = Staged(_narrow(ordered, plan.df, names, upper, "upper"), "plan")
    some = _beside(ordered, plan, names, {"upper": "upper"}).where(upper == F.col("upper"))
    plan = Staged(_narrow(some, plan.df, names, lower, "lower"), "plan")
    some = _beside(ordered, plan, names, {"upper": "upper", "lower": "lower"}).where((upper == F.col("upper")) & (lower == F.col("lower")))
    plan = Staged(_narrow(some, plan.df, names, F.col("_mix_order"), "last"), "plan")
    return Staged(plan.df.select(*names, "held", "share", "whole", "last", F.when(F.col("last").isNotNull(), F.col("rest") - F.col("done")).alias("cut")), "plan")


def _beside(rows: DataFrame, plan: Staged, names: list[str], extra: dict[str, str]) -> DataFrame:
    """Rows with columns of their leaf's plan: broadcast where what was written of it is small, else joined, hot leaves split at run time."""
    table = plan.df.select(*names, *[F.col(c).alias(n) for n, c in extra.items()])
    return rows.join(F.broadcast(table) if plan.small else table, names)


def _numbered(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows of one place numbered from 0, by file of a staged copy, so that no task numbers more than a file."""
    held = Staged(rows, "last-places").df.select("*", F.col("_metadata.file_name").alias("_mix_file"), F.col("_metadata.row_index").alias("_mix_row"))
    counts = held.groupBy(*names, "_mix_file").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*names).orderBy("_mix_file").rowsBetween(Window.unboundedPreceding, -1))
    based = held.join(counts.select(*names, "_mix_file", F.coalesce(before, F.lit(0).cast("long")).alias("_mix_base")), [*names, "_mix_file"])
    within = F.row_number().over(Window.partitionBy(*names, "_mix_file").orderBy("_mix_row")) - 1
    return based.withColumn("_mix_nth", F.col("_mix_base") + within).drop("_mix_file", "_mix_row", "_mix_base")


def mixed(docs: DataFrame, plan: Staged, m: Mixture = STANDARD) -> DataFrame:
    """Each row with ``_mix_copies``, the epochs it enters, and ``_mix_cut``, the tokens of it in the last one if it is cut there."""
    names = [f"_mix_{x}" for x in LEVELS]
    ends = {"_mix_whole": "whole", "_mix_last": "last", "_mix_end": "cut"}
    rows = _beside(docs.withColumns(leaf_columns(m)).withColumn("_mix_text", _text_hash()), plan, names, ends).withColumn("_mix_order", _order(m.seed, F.col("_mix_whole")))
    at_end = F.col("_mix_order").eqNullSafe(F.col("_mix_last"))
    none = F.lit(None).cast("long")
    enters = F.coalesce(F.col("_mix_order") < F.col("_mix_last"), F.lit(False))
    plain = rows.where(~at_end).withColumns({"_mix_copies": F.col("_mix_whole") + enters.cast("long"), "_mix_cut": none})
    # At the place where a leaf ends, equal rows enter one by one until its tokens are used up.
    last = _numbered(rows.where(at_end), names).withColumn("_mix_tokens", F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long"))
    left = F.col("_mix_end") - F.col("_mix_nth") * F.col("_mix_tokens")
    last = last.withColumns({"_mix_copies": F.col("_mix_whole") + (left > 0).cast("long"), "_mix_cut": F.when((left > 0) & (left < F.col("_mix_tokens")), left)})
    gone = (*ends, "_mix_text", "_mix_order")
    return plain.drop(*gone).unionByName(last.drop(*gone, "_mix_nth", "_mix_tokens"))


def mix_report(docs: DataFrame, m: Mixture = STANDARD) -> DataFrame:
    """``doc_id, domain, lang, source, n_tokens, copies, taken_tokens`` for every row."""
    tokens = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    rows = mixed(docs.select("doc_id", "lang", "source", "text", tokens.alias("n_tokens")), mix_plan(docs, m), m)
    lost = F.when(F.col("_mix_cut").isNotNull(), F.greatest(F.col("n_tokens") - F.col("_mix_cut"), F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    return rows.select("doc_id", F.col("_mix_domain").alias("domain"), "lang", "source", "n_tokens", F.col("_mix_copies").alias("copies"), (F.col("_mix_copies") * F.col("n_tokens") - lost).alias("taken_tokens"))


def mix(docs: DataFrame, m: Mixture = STANDARD) -> DataFrame:
    """The rows of the mixture with their columns, each as often as it enters; the last text of a leaf is cut behind its last token."""
    columns = docs.columns
    rows = mixed(docs, mix_plan(docs, m), m).where("_mix_copies > 0")
    each = rows.withColumn("_mix_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies"))))
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(words, 1, F.col("_mix_cut").cast("int")), "")
    ends = F.col("_mix_cut").isNotNull() & (F.col("_mix_nth") == F.col("_mix_copies"))
    return each.withColumn("text", F.when(ends, cut).otherwise(F.col("text"))).select(*columns)
