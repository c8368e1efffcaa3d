"""The audit against plain counting over every order."""

import re
from itertools import permutations

from rowferry.llm import filter_audit as fa

WORDS = re.compile("[^\x20\x09-\x0d]+")


def plain(docs, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    rows = []
    for i, text, lang in docs:
        t = text or ""
        w = WORDS.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and first[t] < i}
        rows.append((lang or "", {x for x, bad in fails.items() if bad}, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        cells, shapley = {}, dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                here = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                fails = [r for r in own if x in r[1]]
                shapley[x] += len(here)
                cells["".join(order), step, x] = (len(left), len(here), len(fails) - len(here), sum(len(r[1]) == 1 for r in fails), sum(r[2] for r in here), sum(r[3] for r in here))
        out += [(part, order, step, *counts, shapley[x]) for (order, step, x), counts in cells.items()]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("part", "filter_order", "step", *fa.COUNTS, "shapley")) for r in df.collect())


def test_whole_table_matches_plain_counting(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    want = plain([(r.doc_id, r.text, r.lang) for r in docs.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert rows_of(fa.audit(docs, labels)) == want


def test_nulls_repeats_clashing_names(spark, awkward):
    marks = [(1, 1, 0), (1, 0, 1), (2, None, 1), (None, 1, 1), (5, None, None), (9, 0, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").selectExpr("*", "'t' as text", "1 as mask", "2 as n", "3 as good")
    docs = awkward.selectExpr("*", "1 as mask", "2 as step", "'p' as prefix", "4 as good")
    assert rows_of(fa.audit(docs, labels)) == plain([(r.doc_id, r.text, r.lang) for r in awkward.collect()], marks)


def test_one_text_and_one_id_for_a_third_of_all_rows(spark):
    docs = [(i % 40, "same Text # again", "en") for i in range(300)] + [(7, f"text {i}", None) for i in range(300)] + [(None, f"text {i % 50}", "de") for i in range(300)]
    labels = [(7, 1, 1)]
    got = fa.audit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert rows_of(got) == plain(docs, labels)


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(nothing, labels).collect() == []


def test_recursion_has_every_ordered_choice(spark):
    got = fa.walk(spark.createDataFrame([("x", 3)], "part string, mask int")).collect()
    assert len({r.prefix for r in got}) == len(got) == 5 + 20 + 60 + 120 + 120
    assert {r.prefix: r.fate for r in got}["AB"] == "redundant"
