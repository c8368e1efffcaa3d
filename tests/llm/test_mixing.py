from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from oracle_check import compare
from rowferry.llm import mixing, oracles


def poured(budget, caps, weights):
    """Real-valued filling by weights under caps."""
    out, live = dict.fromkeys(caps, 0.0), set(caps)
    while live and budget > 1e-9:
        w = sum(weights[c] for c in live)
        full = {c for c in live if caps[c] - out[c] <= budget * weights[c] / w + 1e-9}
        if not full:
            for c in live:
                out[c] += budget * weights[c] / w
            break
        for c in full:
            budget -= caps[c] - out[c]
            out[c] = caps[c]
        live -= full
    return out


def test_budgets_go_to_siblings_before_ancestors(spark):
    leaves = [("a", "x", "1", 100), ("a", "x", "2", 1000), ("a", "y", "3", 50), ("b", "x", "4", 10), ("b", "y", "5", 20), ("c", "z", "6", 5000)]
    df = spark.createDataFrame(leaves, "_mix_domain string, _mix_lang string, _mix_source string, held long")
    m = mixing.Mixture(weights={"domain": {"a": 3, "b": 5}}, budget_percent=40, epochs=2)
    got = {r["_mix_source"]: r["share"] for r in mixing.budgets(df, m).collect()}
    budget = sum(h for *_, h in leaves) * 40 // 100
    caps, langs = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for d, x, s, h in leaves:
        caps[d] += 2 * h
        langs[d][x] += 2 * h
    top = poured(budget, caps, {"a": 3, "b": 5, "c": 1})
    want = {}
    for d in caps:
        mid = poured(top[d], langs[d], defaultdict(lambda: 1))
        for x in langs[d]:
            want |= poured(mid[x], {s: 2 * h for dd, xx, s, h in leaves if (dd, xx) == (d, x)}, defaultdict(lambda: 1))
    assert sum(got.values()) == budget
    assert all(abs(got[s] - want[s]) <= 3 for s in want), (got, want)


def test_taken_tokens_meet_the_budget_exactly(docs):
    rows = mixing.mix_report(docs)
    r = rows.agg(F.sum("taken_tokens").alias("t"), F.sum("n_tokens").alias("n")).first()
    assert r["t"] == r["n"]


def test_awkward_rows(awkward, nothing):
    got = mixing.mix_report(awkward)
    assert got.count() == awkward.count()
    out = mixing.mix(awkward)
    assert out.columns == awkward.columns
    assert out.count() == got.agg(F.sum("copies")).first()[0]
    assert tokens_of(out) == got.agg(F.sum("taken_tokens")).first()[0]
    assert mixing.mix_report(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def tokens_of(df):
    return df.agg(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(mixing.WORD)))).first()[0]


@pytest.fixture(scope="module")
def repeats(spark, tmp_path_factory):
    """Null and repeated ids, with equal and other texts, in leaves that end inside them."""
    rows = [(None, f"no id but words {i % 3} and more", "en", "src1", i) for i in range(300)]
    rows += [(7, "the same row again and again", "de", "src4", 1)] * 300 + [(8, f"one id other text {i}", "fr", "src6", i) for i in range(200)]
    rows += [(100 + i, "w " * (i % 40), "en", "src0", i) for i in range(400)] + [(None, None, None, None, None), (9, "", "es", "src8", 0)]
    at = str(tmp_path_factory.mktemp("repeats"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{at}/documents.parquet")
    return at


def test_repeats_meet_each_leafs_share(spark, repeats):
    docs = spark.read.parquet(f"{repeats}/documents.parquet")
    rows = mixing.mix_report(docs)
    names = [f"_mix_{x}" for x in mixing.LEVELS]
    plan = {tuple(r[n] for n in names): r["share"] for r in mixing.mix_plan(docs).df.collect()}
    got = {(r["domain"], r["lang"] or mixing.NONE, r["source"] or mixing.NONE): r["t"] for r in rows.groupBy("domain", "lang", "source").agg(F.sum("taken_tokens").alias("t")).collect()}
    assert got == plan
    assert rows.count() == docs.count() and rows.where("taken_tokens > copies * n_tokens").isEmpty()


def test_query_and_sql_agree_on_repeats(spark, repeats):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{repeats}/documents.parquet/*.parquet')")
    assert compare(spark, con, lambda s, d: mixing.mix_report(s.read.parquet(f"{d}/documents.parquet")), oracles.mixing_report(), repeats) == ""


def test_the_last_text_of_a_leaf_is_cut(spark, repeats):
    docs = spark.read.parquet(f"{repeats}/documents.parquet")
    out, report = mixing.mix(docs), mixing.mix_report(docs)
    assert tokens_of(out) == report.agg(F.sum("taken_tokens")).first()[0]
    whole = {r["text"] for r in docs.collect()}
    cut = [r["text"] for r in out.collect() if r["text"] not in whole]
    assert cut and all(any(w and w.startswith(c) for w in whole) for c in cut)


def test_an_order_depends_on_the_seed(docs):
    a = {r["doc_id"] for r in mixing.mix_report(docs).where("copies = 1").collect()}
    b = {r["doc_id"] for r in mixing.mix_report(docs, mixing.Mixture(mixing.STANDARD.domains, weights=mixing.STANDARD.weights, seed=8)).where("copies = 1").collect()}
    assert a != b
