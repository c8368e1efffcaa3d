"""SQL for those registered queries of this subpackage that SQL can express."""

from __future__ import annotations

from itertools import combinations

from rowferry.llm import licenses, mixing, quality, urls


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _half(p: str, q: str) -> str:
    m = f"(({p} + {q}) / 2)"
    return f"((CASE WHEN {p} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END) / 2 + (CASE WHEN {q} > 0 THEN {q} * log2({q} / {m}) ELSE 0 END) / 2)"


def quality_rules() -> str:
    known = sorted({v for words in quality.COMMON.values() for w in words for v in (w, w[:1].upper() + w[1:])})
    languages = sorted(quality.COMMON)
    counts = [f"length(regexp_replace(text, '[^{p[1:-1]}]', '', 'g'))" for p in quality.CLASSES.values()]
    n = quality.N_CLASSES
    pairs = " UNION ALL ".join(f"SELECT '{a}+{b}', '{a}', '{b}'" for a, b in combinations(languages, 2))
    class_sum = " + ".join(_half(f"(d.classes[{i}] / greatest(list_sum(d.classes), 1))", f"r.q[{i}]") for i in range(1, n + 1))
    return f"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT rid, doc_id, lang, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM base
), spots AS (
  SELECT rid, i, list_aggregate(w[i:i + 4], 'string_agg', chr(31)) AS win FROM words, unnest(range(1, len(w) - 3)) AS u(i) WHERE len(w) >= 5
), twice AS (
  SELECT rid, i FROM spots QUALIFY count(*) OVER (PARTITION BY rid, win) > 1
), repeated AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(0, 5) AS r(k) GROUP BY rid
), lines AS (
  SELECT rid, count(*) - count(DISTINCT l) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM words) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY rid
), counted AS (
  SELECT words.rid, doc_id, lang, len(w)::BIGINT AS n_words, (length(text) - length(regexp_replace(text, '[^\\x20\\x09-\\x0D]', '', 'g')))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words,
    [{", ".join(f"{c}::BIGINT" for c in counts)}, (strlen(text) - length(text))::BIGINT] AS parts
  FROM words LEFT JOIN lines USING (rid) LEFT JOIN repeated USING (rid)
), measured AS (
  SELECT * EXCLUDE (parts, word_chars, white, length_words), length_words AS word_chars, list_append(parts, greatest(length_words - list_sum(parts), 0)::BIGINT) AS classes
  FROM (SELECT *, word_chars AS white FROM counted) JOIN (SELECT rid, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS length_words FROM base) USING (rid)
), common AS (
  SELECT rid, lower(x) AS word, count(*) AS n FROM (SELECT rid, unnest(w) AS x FROM words) WHERE x IN ({", ".join(map(_text, known))}) GROUP BY ALL
), listed AS (
  SELECT * FROM measured WHERE lang IN ({", ".join(map(_text, languages))})
), sums AS (
  SELECT lang AS ref, sum(n_words)::DOUBLE AS n_words, [{", ".join(f"sum(classes[{i}])::DOUBLE" for i in range(1, n + 1))}] AS c FROM listed GROUP BY lang
  UNION ALL SELECT '', sum(n_words)::DOUBLE, [{", ".join(f"sum(classes[{i}])::DOUBLE" for i in range(1, n + 1))}] FROM listed
), single_class AS (
  SELECT ref, list_transform(c, lambda x: x / list_sum(c)) AS q FROM sums
), single_word AS (
  SELECT ref, word, sum(n) / any_value(s.n_words) AS q FROM listed JOIN common USING (rid) JOIN sums s ON s.ref = listed.lang OR s.ref = '' GROUP BY ALL
), pairs(ref, a, b) AS ({pairs}
), class_refs AS (
  SELECT * FROM single_class UNION ALL
  SELECT p.ref, list_transform(range(1, {n + 1}), lambda i: (x.q[i] + y.q[i]) / 2) FROM pairs p JOIN single_class x ON x.ref = p.a JOIN single_class y ON y.ref = p.b
), word_refs AS (
  SELECT * FROM single_word UNION ALL
  SELECT p.ref, word, sum(q) / 2 FROM pairs p JOIN single_word s ON s.ref IN (p.a, p.b) WHERE p.a IN (SELECT ref FROM sums) AND p.b IN (SELECT ref FROM sums) GROUP BY ALL
), totals AS (
  SELECT ref, sum(q) AS t FROM word_refs GROUP BY ref
), class_far AS (
  SELECT d.rid, d.lang, r.ref, sqrt(least(greatest({class_sum}, 0), 1)) AS far FROM measured d, class_refs r
), word_some AS (
  SELECT d.rid, r.ref, sum({_half("(c.n / d.n_words::DOUBLE)", "coalesce(w.q, 0)")}) AS s, sum(c.n / d.n_words::DOUBLE) AS p, sum(coalesce(w.q, 0)) AS q
  FROM measured d JOIN common c USING (rid) CROSS JOIN totals r LEFT JOIN word_refs w ON w.ref = r.ref AND w.word = c.word GROUP BY ALL
), word_parts AS (
  SELECT d.rid, d.lang, t.ref, t.t, coalesce(x.s, 0) AS s, coalesce(x.p, 0) AS p, coalesce(x.q, 0) AS q FROM measured d CROSS JOIN totals t LEFT JOIN word_some x ON x.rid = d.rid AND x.ref = t.ref
), word_far AS (
  SELECT rid, lang, ref, sqrt(least(greatest(s + (t - q) / 2 + {_half("greatest(1 - p, 0)", "greatest(1 - t, 0)")}, 0), 1)) AS far FROM word_parts
), judged AS (
  SELECT m.*, (SELECT max(far) FROM class_far f WHERE f.rid = m.rid AND f.ref = m.lang) AS class_own, (SELECT min(far) FROM class_far f WHERE f.rid = m.rid) AS class_any,
    (SELECT max(far) FROM word_far f WHERE f.rid = m.rid AND f.ref = m.lang) AS word_own, (SELECT min(far) FROM word_far f WHERE f.rid = m.rid) AS word_any
  FROM measured m
), verdict AS (
  SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed,
    word_chars >= {quality.CLASS_GUARD} AND coalesce(CASE WHEN class_own <= {quality.CLASS_LIMIT} THEN class_own ELSE class_any END, 0) > {quality.CLASS_LIMIT} AS class_bad,
    n_words >= {quality.WORD_GUARD} AND coalesce(CASE WHEN word_own <= {quality.WORD_LIMIT} THEN word_own ELSE word_any END, 0) > {quality.WORD_LIMIT} AS word_bad
  FROM judged
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT class_bad AND NOT word_bad AS kept FROM verdict"""


def _split_sql(children: str, parent: str, name: str, out: str) -> str:
    """The steps that divide a parent's budget: names of ``children`` to a table ``out`` with ``share``."""
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""{out}_a AS (
  SELECT *, coalesce(sum(cap) OVER (n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before_,
    (sum(weight) OVER (n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS from_
  FROM {children} WHERE weight > 0 WINDOW n AS ({by} ORDER BY cap / weight, {name} NULLS FIRST)
), {out}_b AS (
  SELECT *, cap::HUGEINT * from_ <= (budget - before_) * weight AS full_ FROM {out}_a
), {out}_c AS (
  SELECT *, (budget - coalesce(sum(CASE WHEN full_ THEN cap END) OVER f, 0))::HUGEINT AS left_, (sum(CASE WHEN NOT full_ THEN weight END) OVER f)::HUGEINT AS open_,
    (sum(CASE WHEN NOT full_ THEN weight ELSE 0 END) OVER n)::HUGEINT AS run_
  FROM {out}_b WINDOW n AS ({by} ORDER BY cap / weight, {name} NULLS FIRST), f AS ({by})
), {out} AS (
  SELECT * EXCLUDE (cap, weight, budget, before_, from_, full_, left_, open_, run_),
    (CASE WHEN full_ THEN cap ELSE (left_ * run_) // open_ - (left_ * (run_ - weight)) // open_ END)::BIGINT AS share
  FROM {out}_c
)"""


def _case(column: str, given: dict, other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {_text(k)} THEN {_text(v) if isinstance(v, str) else v}" for k, v in sorted(given.items())) + f" ELSE {other} END" if given else other


def mixing_report() -> str:
    m = mixing.STANDARD
    weight = lambda level: _case(level, m.weights.get(level, {}), "1")
    return f"""
WITH rows_ AS (
  SELECT row_number() OVER () AS rid, doc_id, md5(coalesce(text, '')) AS text_, lang AS lang_, source AS source_, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens,
    {_case("coalesce(source, '(none)')", m.domains, _text(m.other_domain))} AS domain, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source
  FROM documents
), leaves AS (
  SELECT domain, lang, source, sum(tokens)::BIGINT AS held, (sum(tokens) * {m.epochs})::BIGINT AS cap FROM rows_ GROUP BY ALL
), d0 AS (
  SELECT domain, sum(cap)::BIGINT AS cap, {weight("domain")} AS weight, (SELECT (sum(held) * {m.budget_percent} // 100)::BIGINT FROM leaves) AS budget FROM leaves GROUP BY domain
), {_split_sql("d0", "", "domain", "d1")},
l0 AS (
  SELECT domain, lang, sum(cap)::BIGINT AS cap, {weight("lang")} AS weight, any_value(share) AS budget FROM leaves JOIN d1 USING (domain) GROUP BY ALL
), {_split_sql("l0", "domain", "lang", "l1")},
s0 AS (
  SELECT domain, lang, source, cap, {weight("source")} AS weight, share AS budget FROM leaves JOIN l1 USING (domain, lang)
), {_split_sql("s0", "domain, lang", "source", "s1")},
plan AS (
  SELECT domain, lang, source, CASE WHEN held > 0 THEN coalesce(share, 0) // held ELSE 0 END AS whole, coalesce(share, 0) - (CASE WHEN held > 0 THEN coalesce(share, 0) // held ELSE 0 END) * held AS rest
  FROM leaves LEFT JOIN s1 USING (domain, lang, source)
), placed AS (
  SELECT r.*, whole, rest, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{m.seed}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')), text_, rid ROWS UNBOUNDED PRECEDING) - tokens AS before_
  FROM rows_ r JOIN plan USING (domain, lang, source)
)
SELECT doc_id, domain, lang_ AS lang, source_ AS source, tokens AS n_tokens, (whole + CASE WHEN before_ < rest AND (tokens > 0 OR before_ < rest) THEN 1 ELSE 0 END)::BIGINT AS copies,
  (whole * tokens + CASE WHEN before_ < rest THEN least(tokens, rest - before_) ELSE 0 END)::BIGINT AS taken_tokens
FROM placed"""


def license_rules() -> str:
    rules = ", ".join(f"({i}, {_text(r.label)}, {_text(r.keyword)}, {_text(' (?:' + r.pattern + ') ')}, {r.priority}, {r.score})" for i, r in enumerate(licenses.rules()))
    gate = sorted({max(r.keyword.split(" "), key=len) for r in licenses.rules()} | {p.split(" ")[0] for p in licenses.BASE})
    phrases = ", ".join(f"({_text(p)}, {_text(label)})" for p, label in licenses.BASE.items())
    # RE2 looks at no neighbours, so spaces are doubled and each match takes one on either side.
    return f"""
WITH rules(nth, label, keyword, pattern, p, score) AS (VALUES {rules}
), phrases(phrase, label) AS (VALUES {phrases}
), words AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), live AS (
  SELECT rid, w, ' ' || array_to_string(w, ' ') || ' ' AS norm FROM words WHERE list_has_any(w, [{", ".join(map(_text, gate))}])
), places AS (
  SELECT rid, i - 1 AS spot, label FROM live, unnest(range(1, len(w) + 1)) AS u(i), phrases WHERE array_to_string(w[i:i + len(string_split(phrase, ' ')) - 1], ' ') = phrase
), base AS (
  SELECT rid, count(*) AS n, min(spot) AS first_word, max(spot) AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, list_distinct(list(label)) AS names FROM places GROUP BY rid
), runs AS (
  SELECT rid, label, p, score, replace(norm, ' ', '  ') AS t, replace(pattern, ' ', '  ') AS pattern, regexp_extract_all(replace(norm, ' ', '  '), replace(pattern, ' ', '  ')) AS hits
  FROM live JOIN rules ON contains(norm, keyword)
), cut AS (
  SELECT *, string_split_regex(t, pattern) AS gaps FROM runs WHERE len(hits) > 0
), spans AS (
  SELECT rid, label, p, score, k, list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) AS a, length(hits[k]) AS size
  FROM cut, unnest(range(1, len(hits) + 1)) AS u(k)
), kept AS (
  SELECT DISTINCT * FROM spans x WHERE NOT EXISTS (
    SELECT 1 FROM spans y WHERE y.rid = x.rid AND y.a <= x.a AND y.a + y.size >= x.a + x.size AND (y.p > x.p OR (y.p = x.p AND y.size > x.size)))
), found AS (
  SELECT rid, list_distinct(list(label)) AS names, max(score) AS score FROM kept GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.first_word::BIGINT AS first_word, base.last_word::BIGINT AS last_word,
  coalesce(base.labels, '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.names, []::VARCHAR[]), coalesce(found.names, []::VARCHAR[])))), ',') AS labels,
  coalesce(found.score, CASE WHEN base.n > 0 THEN 0.8 END, 0.0)::DOUBLE AS score
FROM words LEFT JOIN base USING (rid) LEFT JOIN found USING (rid)"""


def url_filter() -> str:
    rules = ", ".join(f"({_text(r.verdict)}, {_text(r.host)}, {_text(r.path)})" for r in urls.RULES)
    upper = "translate(regexp_extract(coalesce({0}, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = "regexp_extract(coalesce({0}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    return f"""
WITH RECURSIVE rules(verdict, rhost, rpath) AS (VALUES {rules}
), pages_ AS (
  SELECT row_number() OVER () AS rid, page_id, url, coalesce(html, '') AS html FROM pages
), links AS (
  SELECT rid, url, unnest(list_concat(
    list_transform(list_filter(regexp_extract_all(html, '(?is)<link\\b[^>]*'), lambda t: regexp_matches(t, '(?is)\\brel\\s*=\\s*["'']?canonical\\b')), lambda t: regexp_extract(t, '(?is)\\bhref\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1)),
    list_transform(list_filter(regexp_extract_all(html, '(?is)<meta\\b[^>]*'), lambda t: regexp_matches(t, '(?is)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')), lambda t: regexp_extract(t, '(?is)\\bcontent\\s*=\\s*["'']?\\s*[0-9.]*\\s*[;,]\\s*url\\s*=\\s*["'']?([^"''\\s>]+)', 1)))) AS link
  FROM pages_
), targets AS (
  SELECT DISTINCT url AS page, CASE WHEN contains(link, '://') THEN link WHEN starts_with(link, '//') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || link
    WHEN starts_with(link, '/') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || '://' || {upper.format("url")} || link
    ELSE regexp_extract(url, '(?s)^(.*?)://', 1) || '://' || {upper.format("url")} || CASE WHEN regexp_extract({path.format("url")}, '(?s)^(.*/)', 1) = '' THEN '/' ELSE regexp_extract({path.format("url")}, '(?s)^(.*/)', 1) END || link END AS url
  FROM links WHERE link <> '' AND {upper.format("url")} <> ''
), every AS (
  SELECT DISTINCT url FROM (SELECT url FROM pages_ UNION ALL SELECT url FROM targets)
), parsed AS (
  SELECT url, {upper.format("url")} AS host, {path.format("url")} AS path, regexp_replace(regexp_replace({upper.format("url")}, ':(80|443)$', ''), '^www\\.', '') AS short,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '(?s)^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^{urls.TRACKING}$'))), '&') AS query
  FROM every
), fits AS (
  SELECT p.*, rhost || rpath AS rule, verdict FROM parsed p LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY length(rhost || rpath) DESC NULLS LAST, verdict = 'allow' DESC, rhost || rpath) = 1
), keyed AS (
  SELECT *, CASE WHEN short <> '' THEN short || regexp_replace(path, '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS key FROM fits
), edges AS (
  SELECT a.key AS a, b.key AS b FROM targets t JOIN keyed a ON a.url = t.page JOIN keyed b ON b.url = t.url WHERE a.key <> b.key
), both_ AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reach(node, other) AS (
  SELECT DISTINCT key, key FROM keyed WHERE key IS NOT NULL UNION SELECT r.node, e.b FROM reach r JOIN both_ e ON e.a = r.other
), spread AS (
  SELECT node, bool_or(k.verdict = 'block') AND NOT bool_or(k.verdict = 'allow') AS bad FROM reach JOIN keyed k ON k.key = reach.other WHERE k.verdict IS NOT NULL GROUP BY node
)
SELECT page_id, coalesce(k.host, '') AS host, coalesce(k.path, '') AS path, k.rule, coalesce(k.verdict, CASE WHEN s.bad THEN 'block' END, 'allow') AS verdict
FROM pages_ p LEFT JOIN keyed k ON k.url IS NOT DISTINCT FROM p.url LEFT JOIN spread s ON s.node = k.key"""


def ngram_components() -> str:
    percent = 90
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), flat AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b ON a.h = b.h AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  GROUP BY ALL HAVING 100 * count(*) >= {percent} * (any_value(a.n) + any_value(b.n) - count(*))
), reach(node, other) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT r.node, l.y FROM reach r JOIN links l ON l.x = r.other
)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, r.c AS component_id, coalesce(l.n, 0)::BIGINT AS n_links
FROM sets s JOIN (SELECT node, min(other) AS c FROM reach GROUP BY node) r ON r.node = s.doc_id LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) l ON l.x = s.doc_id"""


def nearest_neighbours() -> str:
    return """
WITH live AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])), lambda a, b: a + b)) AS score
  FROM live q JOIN live c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INTEGER AS rank, vec_id, score FROM pairs QUALIFY rank <= 10"""


def repeat_removal() -> str:
    return """
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents
), dup AS (
  SELECT rid, i FROM (SELECT rid, i, md5(b[i + 1:i + 400]) AS h FROM texts, range(octet_length(b) - 399) AS r(i)) QUALIFY count(*) OVER (PARTITION BY h) > 1
), marked AS (
  SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM dup
), spans AS (
  SELECT rid, min(i) AS a, max(i) + 400 AS z FROM (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS span FROM marked) GROUP BY rid, span
), gaps AS (
  SELECT rid, z AS a, coalesce(lead(a) OVER (PARTITION BY rid ORDER BY a), 1099511627776) AS z FROM (SELECT rid, a, z FROM spans UNION ALL SELECT rid, -1, 0 FROM texts)
), kept AS (
  SELECT rid, string_agg(hex(b[a + 1:z]), '' ORDER BY a) AS h FROM gaps JOIN texts USING (rid) WHERE z > a GROUP BY rid
), found AS (
  SELECT rid, sum(z - a) AS n, count(*) AS spans FROM spans GROUP BY rid
)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(f.n, 0)::BIGINT AS n_removed, coalesce(f.spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM texts LEFT JOIN found f USING (rid) LEFT JOIN kept USING (rid)"""


def vector_codes() -> str:
    parts, entries, rounds = 8, 16, 6
    far = """
  SELECT rid, p, e, d FROM (SELECT rid, p, e, sum((x - c) * (x - c)) AS d FROM xs JOIN book{k} USING (p, i) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY rid, p ORDER BY d, e) = 1"""
    steps = "".join(
        f""", near{k} AS MATERIALIZED ({far.format(k=k)}
), book{k + 1} AS MATERIALIZED (
  SELECT p, e, i, coalesce(u.c, b.c) AS c FROM book{k} b LEFT JOIN (
    SELECT p, e, i, ((s - (((s % n) + n) % n)) // n)::BIGINT AS c FROM (SELECT p, e, i, sum(x) AS s, count(*) AS n FROM xs JOIN near{k} USING (rid, p) GROUP BY ALL)) u USING (p, e, i)
)"""
        for k in range(rounds)
    )
    return f"""
WITH live AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), usual AS (SELECT len(v) AS w FROM live GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1
), xs AS MATERIALIZED (
  SELECT rid, (k // (w // {parts})) AS p, k % (w // {parts}) AS i, floor(4096 * v[k + 1])::BIGINT AS x FROM live JOIN usual ON len(v) = w, unnest(range(w)) AS u(k)
), begun AS (
  SELECT arg_min(rid, v) AS rid, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM live JOIN usual ON len(v) = w WHERE vec_id IS NOT NULL GROUP BY vec_id QUALIFY e < {entries}
), book0 AS MATERIALIZED (SELECT p, e, i, x AS c FROM xs JOIN begun USING (rid)
){steps}, found AS ({far.format(k=rounds)}
), coded AS (
  SELECT rid, string_agg(printf('%02x', e::INTEGER), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM found GROUP BY rid
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN live USING (rid)"""


def filter_audit() -> str:
    return """
WITH RECURSIVE filters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), masked AS (
  SELECT t.*, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM texts t LEFT JOIN marks ON marks.doc_id = t.doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masked GROUP BY ALL
), walk(prefix, letter, bit, before, step) AS (
  SELECT '', '', 0, 0, 0 UNION ALL SELECT prefix || f.letter, f.letter, f.bit, before | w.bit, step + 1 FROM walk w JOIN filters f ON (before | w.bit) & f.bit = 0
), metrics AS (
  SELECT part, prefix, letter, step, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS toxic_lost
  FROM walk CROSS JOIN cells WHERE step > 0 GROUP BY ALL
)
SELECT part, o.prefix AS filter_order, m.step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM (SELECT prefix FROM walk WHERE step = 5) o JOIN metrics m ON m.prefix = left(o.prefix, m.step)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules(),
        "op2_mixing": mixing_report(),
        "op5_licenses": license_rules(),
        "op6_url_filter": url_filter(),
        "op8_ngram_join": ngram_components(),
        "op9_nearest_neighbours": nearest_neighbours(),
        "op11_suffix_dedup": repeat_removal(),
        "op12_vector_codes": vector_codes(),
        "op13_filter_audit": filter_audit(),
    }
