import re
from collections import Counter

from rowferry.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_awkward_rows_are_counted_like_plain_python(awkward):
    got = quality.judge(awkward).collect()
    assert len(got) == awkward.count()
    text = {(r["doc_id"], r["text"] and len(r["text"])): r["text"] for r in awkward.collect()}
    want = sorted((repr(i), *base_counts(t)) for (i, _), t in text.items())
    assert sorted({(repr(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got}) == want
    by = {r["doc_id"]: r for r in got if r["doc_id"]}
    assert by[3]["base_failed"] and not by[3]["kept"] and by[6]["base_failed"]
    assert by[1]["kept"]


def test_nothing_in_nothing_out(nothing):
    assert quality.judge(nothing).count() == 0
    assert quality.keep_good(nothing).count() == 0


def test_keep_good_keeps_columns_and_drops_what_is_judged(awkward):
    kept = quality.keep_good(awkward)
    assert kept.columns == awkward.columns
    judged = [r for r in quality.judge(awkward).collect() if r["kept"]]
    assert kept.count() == len(judged)


def test_symbols_and_lists_are_far_from_prose(spark, docs, schema):
    prose = " ".join(r["text"] for r in docs.where("lang = 'en'").limit(3).collect())[:3000]
    words = prose.split()
    listed = " | ".join(w for w in words if len(w) > 5)
    noisy = " ".join(w + "$$$" for w in words)
    more = spark.createDataFrame([(10**9, prose, "en", "x", 1), (10**9 + 1, listed, "en", "x", 1), (10**9 + 2, noisy, "en", "x", 1)], schema)
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs.union(more)).where("doc_id >= 1000000000").collect()}
    assert got == {10**9: True, 10**9 + 1: False, 10**9 + 2: False}


def test_the_references_are_in_a_plan_once_for_each_use(spark, docs):
    """Written out for each reference and each use of a share, the rules filled the driver: a plan of over a million characters."""
    judged = quality.judge(docs).where("not kept").select("doc_id")
    text = judged._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < text.count("keys: [") <= 3 * 11
    assert len(text) < 80_000
