r"""License mentions by ordered signature rules, in DataFrame functions only.

Rules are regular expressions over a text's words (A-Z lower-cased, one space
between words, one at either end). A rule runs only where its keyword occurs.
Every match is an interval of characters; a match that lies inside one of a
rule with higher priority, or of the same priority and longer, is suppressed.
Fixed phrases (``BASE``) are counted and labelled apart and never suppressed.

Nulls: a null text is an empty one: no words, no labels, score 0. Repeated rows
are scanned each. Equal intervals of equal priority both stay. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, functions as F

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Rule:
    """``priority``: 4 an identifier tag, 3 a grant with version, 2 a name with version, 1 a bare name, 0 a general hint."""

    label: str
    keyword: str
    pattern: str
    priority: int
    score: float


# Families: label, keyword, how the name is written, versions (label suffix: how it is written) and the tag's name.
_NUMBERS = {"1.0": "1(?: 0)?", "1.1": "1 1", "2.0": "2(?: 0)?", "2.1": "2 1", "2.5": "2 5", "3.0": "3(?: 0)?", "4.0": "4(?: 0)?"}
_FAMILIES: list[tuple[str, str, str, tuple[str, ...], str]] = [
    ("apache", "apache", "apache(?: software)?(?: license)?", ("1.0", "1.1", "2.0"), "apache"),
    ("gpl", "general public", "(?:gnu )?(?:gpl|general public licen[sc]e)", ("1.0", "2.0", "3.0"), "gpl"),
    ("gpl", "gpl", "(?:gnu )?gpl", ("1.0", "2.0", "3.0"), "gpl"),
    ("lgpl", "lesser general", "(?:gnu )?(?:lesser|library) general public licen[sc]e", ("2.0", "2.1", "3.0"), "lgpl"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", ("2.0", "2.1", "3.0"), "lgpl"),
    ("agpl", "affero", "(?:gnu )?affero general public licen[sc]e", ("1.0", "3.0"), "agpl"),
    ("agpl", "agpl", "(?:gnu )?agpl", ("1.0", "3.0"), "agpl"),
    ("gfdl", "free documentation", "(?:gnu )?free documentation licen[sc]e", ("1.1",), "gfdl"),
    ("mpl", "mozilla", "mozilla public licen[sc]e", ("1.0", "1.1", "2.0"), "mpl"),
    ("epl", "eclipse", "eclipse public licen[sc]e", ("1.0", "2.0"), "epl"),
    ("cddl", "common development", "common development and distribution licen[sc]e", ("1.0", "1.1"), "cddl"),
    ("cpl", "common public", "common public licen[sc]e", ("1.0",), "cpl"),
    ("eupl", "european union", "european union public licen[sc]e", ("1.0", "1.1"), "eupl"),
    ("osl", "open software", "open software licen[sc]e", ("1.0", "2.0", "2.1", "3.0"), "osl"),
    ("afl", "academic free", "academic free licen[sc]e", ("2.0", "2.1", "3.0"), "afl"),
    ("artistic", "artistic", "(?:perl )?artistic licen[sc]e", ("1.0", "2.0"), "artistic"),
    ("boost", "boost", "boost software licen[sc]e", ("1.0",), "bsl"),
    ("ms-pl", "microsoft public", "microsoft public licen[sc]e", (), "ms pl"),
    ("odbl", "open database", "open database licen[sc]e", ("1.0",), "odbl"),
    ("ofl", "open font", "(?:sil )?open font licen[sc]e", ("1.0", "1.1"), "ofl"),
    ("php", "php license", "php licen[sc]e", ("3.0",), "php"),
    ("python", "python software", "python software foundation licen[sc]e", ("2.0",), "psf"),
    ("mit", "mit", "(?:the )?mit licen[sc]e", (), "mit"),
    ("isc", "isc license", "(?:the )?isc licen[sc]e", (), "isc"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[sc]e", (), "zlib"),
    ("unlicense", "unlicense", "the unlicense", (), "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", ("2.0",), "wtfpl"),
    ("bsd", "bsd", "(?:new |modified |simplified )?bsd(?: style)? licen[sc]e", (), "bsd"),
]
_BSD = {"bsd-0": "(?:0|zero) clause", "bsd-2": "(?:2|two) clause", "bsd-3": "(?:3|three) clause", "bsd-4": "(?:4|four) clause"}
_CC = {
    "cc-by": ("by", "attribution"),
    "cc-by-sa": ("by sa", "attribution share ?alike"),
    "cc-by-nd": ("by nd", "attribution no ?deriv(?:ative)?s"),
    "cc-by-nc": ("by nc", "attribution non ?commercial"),
    "cc-by-nc-sa": ("by nc sa", "attribution non ?commercial share ?alike"),
    "cc-by-nc-nd": ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"),
}
_GRANT = "(?:licen[sc]ed|released|distributed|available|published|made available) (?:under|subject to)(?: the)?(?: terms)?(?: of)?(?: the)? "
_LATER = "(?: or(?: at your option)?(?: any)? later(?: version)?| and later)"
_VERSION = "(?: version| v| ver)? ?v?"
# Wording that stands in the licenses themselves, or speaks of rights without a name.
_TEXTS: list[tuple[str, str, str, float]] = [
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", 0.95),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee", 0.95),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted", 0.95),
    ("bsd-3", "neither the name", "neither the name of [^ ]+(?: [^ ]+){0,12}? nor the names of its contributors", 0.9),
    ("bsd-4", "advertising materials", "all advertising materials mentioning features or use of this software", 0.9),
    ("zlib", "provided as is", "this software is provided as is without any express or implied warranty", 0.8),
    ("apache-2.0", "apache org", "apache org licenses license 2 0", 0.95),
    ("gpl", "gnu org", "gnu org licenses gpl", 0.9),
    ("lgpl", "gnu org", "gnu org licenses lgpl", 0.9),
    ("agpl", "gnu org", "gnu org licenses agpl", 0.9),
    ("mpl-2.0", "mozilla org", "mozilla org mpl 2 0", 0.95),
    ("mit", "opensource org", "opensource org licenses mit", 0.95),
    ("bsd-3", "opensource org", "opensource org licenses bsd 3 clause", 0.95),
    ("unlicense", "public domain", "this is free and unencumbered software released into the public domain", 0.95),
    ("public-domain", "public domain", "(?:released into|dedicated to|in) the public domain", 0.7),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", 0.9),
    ("cc0", "publicdomain zero", "creativecommons org publicdomain zero", 0.95),
    ("proprietary", "all rights reserved", "all rights reserved", 0.6),
    ("proprietary", "confidential", "(?:confidential and proprietary|proprietary and confidential)", 0.7),
]


def _number(version: str) -> str:
    return f"{_VERSION}{_NUMBERS[version]}"


def rules() -> list[Rule]:
    """All rules, most specific first."""
    out: list[Rule] = []
    for family, keyword, name, versions, tag in _FAMILIES:
        for v in versions:
            number = _number(v)
            out += [
                Rule(f"{family}-{v}", "spdx", f"spdx license identifier {tag} {_NUMBERS[v]}(?: only)?", 4, 1.0),
                Rule(f"{family}-{v}-or-later", "spdx", f"spdx license identifier {tag} {_NUMBERS[v]} or later", 4, 1.0),
                Rule(f"{family}-{v}-or-later", keyword, f"{_GRANT}{name}{number}{_LATER}", 3, 0.97),
                Rule(f"{family}-{v}", keyword, f"{_GRANT}{name}{number}", 3, 0.95),
                Rule(f"{family}-{v}-or-later", keyword, f"{name}{number}{_LATER}", 2, 0.9),
                Rule(f"{family}-{v}", keyword, f"{name}{number}", 2, 0.85),
            ]
        out += [
            Rule(family, "spdx", f"spdx license identifier {tag}", 4, 0.95),
            Rule(family, keyword, f"{_GRANT}{name}", 3, 0.9),
            Rule(family, keyword, name if "licen" in name and not name.endswith(")?") else f"{name} licen[sc]e", 1, 0.8),
        ]
    for label, name in _BSD.items():
        out += [
            Rule(label, "spdx", f"spdx license identifier bsd {label[-1]} clause", 4, 1.0),
            Rule(label, "clause", f"{_GRANT}{name} bsd(?: style)?(?: licen[sc]e)?", 3, 0.95),
            Rule(label, "clause", f"(?:{name} bsd(?: style)?|bsd {name})(?: licen[sc]e)?", 2, 0.85),
        ]
    for label, (short, long) in _CC.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            out += [
                Rule(f"{label}-{v}", "spdx", f"spdx license identifier cc {short} {_NUMBERS[v]}", 4, 1.0),
                Rule(f"{label}-{v}", "cc by", f"{_GRANT}(?:a )?cc {short} {_NUMBERS[v]}", 3, 0.97),
                Rule(f"{label}-{v}", "cc by", f"cc {short} {_NUMBERS[v]}", 2, 0.9),
                Rule(f"{label}-{v}", "creative commons", f"creative commons {long} {_NUMBERS[v]}", 2, 0.9),
                Rule(f"{label}-{v}", "creativecommons org", f"creativecommons org licenses {short} {_NUMBERS[v]}", 3, 0.95),
            ]
        out += [Rule(label, "cc by", f"cc {short}", 1, 0.8), Rule(label, "creative commons", f"creative commons {long}", 1, 0.8)]
    out += [Rule(label, keyword, pattern, 3, score) for label, keyword, pattern, score in _TEXTS]
    out.append(Rule("cc", "creative commons", "creative commons(?: licen[sc]e)?", 0, 0.5))
    return out


def _found(norm: Column, rule: Column) -> Column:
    """Intervals of one rule's matches: the lengths of what lies between matches and of the matches give the places."""
    pattern = F.concat(F.lit("(?<= )(?:"), rule["pattern"], F.lit(")(?= )"))
    hits = F.regexp_extract_all(norm, pattern, F.lit(0))
    gaps = F.transform(F.split(norm, pattern, F.lit(-1)), F.length)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        a = s["at"] + x["gap"]
        b = a + F.length(x["hit"])
        return F.struct(b.alias("at"), F.concat(s["out"], F.array(F.struct(a.alias("a"), b.alias("b")))).alias("out"))

    pairs = F.zip_with(hits, gaps, lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    places = F.aggregate(F.filter(pairs, lambda x: x["hit"].isNotNull()), zero, step, lambda s: s["out"])
    return F.transform(places, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), rule["priority"].alias("p"), rule["label"].alias("label"), rule["score"].alias("score")))


def _table(some: list[Rule]) -> Column:
    """The rules as one literal."""
    return F.from_json(F.lit(json.dumps([asdict(r) for r in some])), "array<struct<label:string,keyword:string,pattern:string,priority:int,score:double>>")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections`` for every row.

    ``detections`` holds what was kept, as intervals of characters in the text of words; its highest score is the text's.
    """
    some = rules()
    keywords = sorted({r.keyword for r in some})
    # Each keyword's longest word; a text without any of them is left alone.
    gate = sorted({max(k.split(" "), key=len) for k in keywords} | {w for phrase in BASE for w in phrase.split(" ")[:1]})
    # Lower-casing beyond A-Z turns no character into a separator and spells no phrase or keyword that was not there.
    rows = docs.select("doc_id", F.array_remove(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), NOT_WORD), "").alias("_words"))
    live = F.arrays_overlap("_words", F.array(*[F.lit(w) for w in gate]))
    rows = rows.select("doc_id", F.size("_words").cast("long").alias("n_words"), F.when(live, F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))).alias("_norm"))
    norm = F.col("_norm")
    base = "(?<= )(?:" + "|".join(BASE) + ")(?= )"
    rows = rows.withColumn("_live", F.when(norm.isNotNull(), F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: norm.contains(k))))
    rows = rows.withColumn("_rules", F.when(F.size("_live") > 0, F.filter(_table(some), lambda r: F.array_contains(F.col("_live"), r["keyword"]))))
    rows = rows.withColumn("_hits", F.when(F.size("_rules") > 0, F.flatten(F.transform("_rules", lambda r: _found(norm, r)))))
    hits = F.col("_hits")
    inside = lambda x: F.exists(hits, lambda y: (y["a"] <= x["a"]) & (y["b"] >= x["b"]) & ((y["p"] > x["p"]) | ((y["p"] == x["p"]) & (y["b"] - y["a"] > x["b"] - x["a"]))))
    rows = rows.withColumn("_kept", F.filter(hits, lambda x: ~inside(x)))
    rows = rows.withColumn("_gaps", F.when(norm.rlike(base), F.transform(F.split(norm, base), lambda g: F.size(F.split(F.trim(g), " ")) - F.when(F.trim(g) == "", 1).otherwise(0))))
    rows = rows.withColumn("_base", F.when(F.col("_gaps").isNotNull(), F.regexp_extract_all(norm, F.lit(base), F.lit(0))))
    gaps, found = F.col("_gaps"), F.col("_base")
    names = F.create_map(*[F.lit(x) for pair in BASE.items() for x in pair])
    empty = F.array().cast("array<string>")
    base_labels = F.coalesce(F.transform(F.array_distinct(found), lambda p: names[p]), empty)
    labels = F.array_union(base_labels, F.coalesce(F.transform("_kept", lambda x: x["label"]), empty))
    after = F.element_at(gaps, -1) + F.size(F.split(F.element_at(found, -1), " "))
    return rows.select(
        "doc_id",
        "n_words",
        F.when(found.isNull(), 0).otherwise(F.size(found)).cast("long").alias("n_base"),
        F.when(found.isNotNull(), F.element_at(gaps, 1)).cast("long").alias("first_word"),
        F.when(found.isNotNull(), F.col("n_words") - after).cast("long").alias("last_word"),
        F.array_join(F.sort_array(base_labels), ",").alias("base_labels"),
        F.array_join(F.sort_array(labels), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("_kept", lambda x: x["score"])), F.when(found.isNotNull(), 0.8), F.lit(0.0)).alias("score"),
        F.coalesce(F.transform("_kept", lambda x: F.concat_ws(":", x["a"].cast("string"), x["b"].cast("string"), x["label"])), empty).alias("detections"),
    )
