"""Filter interaction audit: what each of five filters removes in every order they could be applied.

1. Each text gets a mask of the filters it fails: A under 100 words, B under 80% distinct words, C over 10% capitals A-Z,
   D one of ``#$%&*|``, E identical to the text of a smaller id anywhere in the table. Words are runs of characters
   other than ASCII white space.
2. Rows become cells: a part (language) and a mask with counts, at most 32 a part.
3. A recursive query extends filter prefixes by the letters they lack. It joins the masks that occur and carries the
   bits applied so far; each level says what its step does to every mask cell: removed here, failing but removed
   earlier, or kept. Its size depends on the masks alone, not on rows or parts.
4. Cells weigh those outcomes; an order's step ``k`` is the prefix of its first ``k`` letters.

E needs no join: rows are counted by text and id, then by text, and meet at a text only as counts of the smallest id, so
a text that a third of all rows share is a row for each task.

Nulls: a null text is an empty one, a null language is the part of the empty text. A null id is no smaller than any
other and has no label. Rows that repeat an id and text all stay or go by it: only a smaller id makes a copy.
Several labels of an id count as 1 if one of them is 1. An empty table has no parts and gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowferry.session import Staged

LETTERS = "ABCDE"
SPACE = "[\\x20\\x09-\\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_mask(text: Column, words: Column) -> Column:
    """The bits of the filters that a text fails by itself: A 1, B 2, C 4, D 8."""
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (
        F.size(words) < 100,
        100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        100 * capitals > 10 * F.length(text),
        text.rlike("[#$%&*|]"),
    )
    return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)), F.lit(0)).cast("int")


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: how many documents of a part fail exactly the filters of a mask."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("*", F.array_remove(F.split("text", SPACE), "").alias("words"), F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("same"))
    rows = rows.select("doc_id", "part", "same", text_mask(F.col("text"), F.col("words")).alias("mask"))
    rows = rows.groupBy("doc_id", "part", "same", "mask").agg(F.count(F.lit(1)).alias("n"))
    marked = labels.select(F.col("doc_id").cast("long").alias("label_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    marked = Staged(marked.where("label_id is not null and (good or toxic)").groupBy("label_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")), "audit-labels").df
    # Null ids match no label; the second key keeps them from meeting in one task.
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("same")).otherwise(F.lit(0))
    rows = rows.withColumn("spread", spread).join(marked.withColumn("none", F.lit(0).cast("long")), (F.col("doc_id") == F.col("label_id")) & (F.col("spread") == F.col("none")), "left")
    kinds = ["part", "mask", "good", "toxic"]
    rows = rows.select("doc_id", "same", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "n")
    by_text = rows.groupBy("same", *kinds).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("low")
    )
    first = F.min("low.doc_id").over(Window.partitionBy("same"))
    by_text = by_text.withColumn("first", first)
    lone = F.col("nameless") + F.when(F.col("low.doc_id") == F.col("first"), F.col("low.n")).otherwise(F.lit(0))
    halves = F.explode(F.array(F.struct(F.col("mask").alias("mask"), lone.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - lone).alias("n"))))
    split = by_text.select("part", "good", "toxic", halves.alias("half")).select("part", "good", "toxic", "half.mask", "half.n").where("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def walk(cells: DataFrame) -> DataFrame:
    """``prefix, letter, step, mask, fate, alone`` for each ordered choice of filters and each mask that occurs."""
    unused = ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << k})" for k, x in enumerate(LETTERS))
    return cells.sparkSession.sql(
        f"""
        WITH RECURSIVE walk(prefix, letter, applied, step, mask, fate, alone) AS (
          SELECT '', '', 0, 0, mask, 'kept', false FROM (SELECT DISTINCT mask FROM {{cells}})
          UNION ALL
          SELECT concat(prefix, next.letter), next.letter, applied | next.bit, step + 1, mask,
            CASE WHEN mask & next.bit = 0 THEN (CASE WHEN mask & applied = 0 THEN 'kept' ELSE 'gone' END)
                 WHEN mask & applied = 0 THEN 'removed' ELSE 'redundant' END,
            mask = next.bit
          FROM (SELECT *, explode(filter(array({unused}), f -> applied & f.bit = 0)) AS next FROM walk)
        )
        SELECT prefix, letter, step, mask, fate, alone FROM walk WHERE step > 0
        """,
        cells=cells,
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step`` and that step's counts, for every part, order and step, zeros included."""
    cells = Staged(mask_cells(docs, labels), "audit-cells").df
    steps = Staged(walk(cells), "audit-walk").df
    n, fate = F.col("n"), F.col("fate")

    def total(condition: Column, what: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(what)).otherwise(F.lit(0)))

    metrics = steps.join(cells, "mask").groupBy("part", "prefix", "letter", "step").agg(
        total(fate == "kept").alias("kept"), total(fate == "removed").alias("removed"), total(fate == "redundant").alias("redundant"),
        total(F.col("alone")).alias("unique_fails"), total(fate == "removed", "good").alias("good_lost"), total(fate == "removed", "toxic").alias("toxic_lost"),
    )
    orders = steps.where(F.col("step") == len(LETTERS)).select(F.col("prefix").alias("filter_order")).distinct()
    orders = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    orders = orders.select("filter_order", F.expr("substring(filter_order, 1, step)").alias("prefix"))
    every = metrics.join(orders, "prefix")
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return every.select("part", "filter_order", "step", *(F.col(c).cast("long").alias(c) for c in COUNTS), shapley.cast("long").alias("shapley"))
