"""Quality rules: base counts of every text, and divergence of its histograms from language references.

Two histograms of a document, over character classes and over common words
(with one bucket for all other words), are compared by Jensen-Shannon distance
(0 equal, 1 disjoint) with references of its language, which are the summed
histograms of all documents of that language. A distance above its limit
rejects the document; texts too short for a histogram to mean anything are not
judged by it. Everything is built from DataFrame functions.

Nulls: a null text has no words, so it fails the base rule. A document that is
too far from its own language's reference, or whose ``lang`` is null or has no
list of common words, is judged by the nearest of all references, their
mixtures in halves and the pooled one, so that mixed or mislabelled prose
passes; with no reference at all only the base rule holds. A null
``doc_id`` is carried along. Repeated rows are judged each, and count each in
the references. Ties cannot matter. An empty table gives an empty result. Other
columns are ignored by ``judge`` and kept by ``keep_good``.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from rowferry.session import Staged

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
SPAN = 5

# Common words by language: which words a histogram tells apart. Any other language falls to the nearest of these.
COMMON = {
    "de": "auf das dem den der des die durch ein eine einer er es für haben ich im in ist mit nicht sich sie sind und von war zu zum".split(),
    "en": "a and are as at be but by for from had have he his in is it not of on or that the they this to was were which with you".split(),
    "es": "al como con de del el en era es está la las lo los más no para pero por que se ser sin sobre son su una un y".split(),
    "fr": "au aux avec ce dans de des du elle en est et il la le les mais ne on ou par pas pour que qui se sur un une".split(),
}
# Counted in this order, then characters of two bytes or more (by their further bytes, so rarer scripts weigh more),
# then all that is left, mostly small ASCII letters.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "mark": r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"}
N_CLASSES = len(CLASSES) + 2

# The reference of all languages together: the yardstick of texts that mix languages.
POOLED = ""
LEAST_WORDS = 10
REPEAT_PERCENT = 20
# Shortest text, in characters of words and in words, whose histogram is judged, and the largest distance allowed.
CLASS_GUARD, CLASS_LIMIT = 200, 0.30
WORD_GUARD, WORD_LIMIT = 100, 0.30


def _spread(words: list[str]) -> list[str]:
    return sorted({v for w in words for v in (w, w[:1].upper() + w[1:])})


def _covered(placed: Column) -> Column:
    """Words covered by the windows in ``placed``, a sorted column of (hash, place), that share their hash with a neighbour."""
    twice = F.filter(placed, lambda x, i: (x["h"] == F.get(placed, i - 1)["h"]) | F.coalesce(x["h"] == F.get(placed, i + 1)["h"], F.lit(False)))
    at = F.sort_array(F.transform(twice, lambda x: x["i"]))
    zero = F.struct(F.lit(-SPAN).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(at, zero, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(SPAN), i - s["last"])).alias("n")), lambda s: s["n"])


def measure(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Per row the base counts, the counts of each character class and the common words it holds with their counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    known = _spread([w for words in COMMON.values() for w in words])
    keep = ["doc_id", "lang"] if keep is None else keep
    rows = docs.select(*keep, text.alias("_text"), F.array_remove(F.split(text, SPACE + "+"), "").alias("_words"))
    n, words = F.size("_words"), F.col("_words")
    rows = rows.select(
        *keep,
        "_text",
        n.cast("long").alias("n_words"),
        F.slice(F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, SPAN)])), F.lit(1), F.greatest(n - (SPAN - 1), F.lit(0))).alias("_windows"),
        F.sort_array(F.transform(F.filter(words, lambda w: w.isin(known)), F.lower)).alias("_common"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD)).alias("_lines"),
    )
    common = F.col("_common")
    # Where a run of one word begins in the sorted words.
    begins = F.filter(F.sequence(F.lit(0), F.size(common)), lambda i: (i == F.size(common)) | (i == 0) | (F.get(common, i) != F.get(common, i - 1)))
    rows = rows.select(
        *keep,
        "n_words",
        (F.length("_text") - F.regexp_count("_text", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        # Most texts repeat no window and skip the sort.
        F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_placed"),
        F.array(*[F.regexp_count("_text", F.lit(p)).cast("long") for p in CLASSES.values()], (F.octet_length("_text") - F.length("_text")).cast("long")).alias("classes"),
        "_common",
        begins.alias("_begins"),
    )
    b = F.col("_begins")
    runs = F.when(F.size("_common") > 0, F.transform(F.slice(b, 1, F.size(b) - 1), lambda i, k: F.struct(F.get(F.col("_common"), i).alias("word"), (F.get(b, k + 1) - i).cast("long").alias("n"))))
    classes = F.concat(F.col("classes"), F.array(F.greatest(F.col("word_chars") - F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))))
    return rows.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(_covered(F.col("_placed")), F.lit(0).cast("long")).alias("n_repeat_words"), classes.alias("classes"), F.coalesce(runs, F.array().cast("array<struct<word:string,n:bigint>>")).alias("common"))


def references(measured: DataFrame) -> dict[str, tuple[list[float], dict[str, float]]]:
    """For each language with a list, and for all of them pooled, the shares of classes and of common words.

    What comes back is a handful of sums: as many languages, classes and words as this module lists.
    """
    listed = measured.where(F.col("lang").isin(sorted(COMMON)))
    sums = listed.groupBy("lang").agg(F.sum("n_words").alias("n_words"), *[F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(N_CLASSES)]).collect()
    words = listed.select("lang", F.explode("common").alias("c")).groupBy("lang", "c.word").agg(F.sum("c.n").alias("n")).collect()
    out = {}
    pooled = sum(r["n_words"] for r in sums)
    if pooled:
        classes = [sum(r[f"c{i}"] for r in sums) for i in range(N_CLASSES)]
        every = {w["word"] for w in words}
        out[POOLED] = ([c / max(sum(classes), 1) for c in classes], {x: sum(w["n"] for w in words if w["word"] == x) / pooled for x in every})
    for r in sums:
        chars = sum(r[f"c{i}"] for i in range(N_CLASSES))
        if chars and r["n_words"]:
            out[r["lang"]] = ([r[f"c{i}"] / chars for i in range(N_CLASSES)], {w["word"]: w["n"] / r["n_words"] for w in words if w["lang"] == r["lang"]})
    return out


def mixture(a, b):
    """The histogram of as much text of one reference as of the other."""
    if isinstance(a, dict):
        return {w: (a.get(w, 0.0) + b.get(w, 0.0)) / 2 for w in a.keys() | b.keys()}
    return [(x + y) / 2 for x, y in zip(a, b)]


def _half(p: Column, q: Column) -> Column:
    """The part of one outcome in the divergence, in bits."""
    m = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) / 2 + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0) / 2


def _root(x: Column) -> Column:
    return F.sqrt(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def _doubles(shares: list[float]) -> Column:
    return F.split(F.lit(",".join(repr(float(q)) for q in shares)), ",").cast("array<double>")


def _constant(lang: str | None, histogram: list[float] | dict[str, float]) -> Column:
    """One reference as a constant; a mixture has no language."""
    if isinstance(histogram, dict):
        words = sorted(histogram)
        shares = F.map_from_arrays(F.split(F.lit(",".join(words)), ","), _doubles([histogram[w] for w in words])) if words else F.create_map().cast("map<string,double>")
    else:
        shares = _doubles(histogram)
    total = sum(histogram.values() if isinstance(histogram, dict) else histogram)
    return F.struct(F.lit(lang).cast("string").alias("lang"), shares.alias("shares"), F.lit(float(total)).alias("total"))


def class_distance(ref: Column) -> Column:
    total = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    parts = F.zip_with(F.transform("classes", lambda c: c / total), ref["shares"], _half)
    return _root(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x))


def word_distance(ref: Column) -> Column:
    """Words of the reference that the text lacks add half their share; its own common words are looked up one by one."""
    n = F.col("n_words").cast("double")
    both = F.transform("common", lambda x: F.struct((x["n"] / n).alias("p"), F.coalesce(F.try_element_at(ref["shares"], x["word"]), F.lit(0.0)).alias("q")))
    zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
    step = lambda s, x: F.struct((s["d"] + _half(x["p"], x["q"])).alias("d"), (s["p"] + x["p"]).alias("p"), (s["q"] + x["q"]).alias("q"))
    end = lambda s: s["d"] + (ref["total"] - s["q"]) / 2 + _half(F.greatest(1 - s["p"], F.lit(0.0)), F.greatest(1 - ref["total"], F.lit(0.0)))
    return _root(F.aggregate(both, zero, step, end))


def judge(docs: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, both distances (null where guarded) and ``kept``.

    ``measured`` may be the written result of ``measure``, which is otherwise written here: it is read twice, once for
    the references.
    """
    measured = Staged(measure(docs), "quality").df if measured is None else measured
    refs = references(measured)

    def nearest(distance, index: int, limit: float) -> Column:
        """To the reference of the document's language; only if that is too far, to the nearest of all and their mixtures.

        The references are one constant array, and a distance is written once for whichever of them: written out for each,
        the plan alone fills the driver.
        """
        single = {lang: r[index] for lang, r in sorted(refs.items())}
        if not single:
            return F.lit(None).cast("double")
        mixed = [mixture(single[a], single[b]) for a, b in combinations([x for x in single if x != POOLED], 2)]
        every = F.array(*[_constant(lang, r) for lang, r in [*single.items(), *[(None, r) for r in mixed]]])
        own = F.get(F.transform(F.filter(every, lambda r: r["lang"] == F.col("lang")), distance), F.lit(0))
        return F.when(own <= limit, own).otherwise(F.array_min(F.transform(every, distance)))

    out = measured.withColumns({
        "class_distance": F.when(F.col("word_chars") >= CLASS_GUARD, nearest(class_distance, 0, CLASS_LIMIT)),
        "word_distance": F.when(F.col("n_words") >= WORD_GUARD, nearest(word_distance, 1, WORD_LIMIT)),
        "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")),
    })
    far = F.coalesce(F.col("class_distance") > CLASS_LIMIT, F.lit(False)) | F.coalesce(F.col("word_distance") > WORD_LIMIT, F.lit(False))
    return out.drop("classes", "common").withColumn("kept", ~F.col("base_failed") & ~far)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that the rules keep, with their columns.

    Rows are told apart by id and a hash of their text, so the texts themselves are never shuffled: the rejected
    keys are broadcast where what was written of them is small, else joined by key.
    """
    keyed = docs.withColumn("__quality_mark", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    measured = Staged(measure(keyed, ["doc_id", "lang", "__quality_mark"]), "quality")
    bad = judge(docs, measured.df).where(~F.col("kept")).select(F.col("doc_id").alias("__quality_id"), F.col("__quality_mark").alias("__quality_bad"))
    bad = Staged(bad.distinct(), "rejected")
    small = F.broadcast(bad.df) if bad.small else bad.df
    same = F.col("doc_id").eqNullSafe(F.col("__quality_id")) & (F.col("__quality_mark") == F.col("__quality_bad"))
    return keyed.join(small, same, "left_anti").drop("__quality_mark")
