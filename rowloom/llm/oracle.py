"""The queries of this folder as DuckDB SQL, where SQL can express them; the others are tested against brute force."""

from __future__ import annotations

from rowloom.llm import decontaminate, licenses, mixing, revisits, search
from rowloom.llm.queries import MOST_TURNS, TOP_K, TURN_GROUP


def _texts(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::varchar[]"


def op1() -> str:
    reach = max(len(t.words) for t in licenses.TEMPLATES) - 1
    rows = ", ".join(f"({n}, '{t.label}', {str(t.exact).lower()}, {_texts(t.words)}, {len(set(t.words))}, {t.needed}, {_texts(t.required.split())})" for n, t in enumerate(licenses.TEMPLATES))
    return rf"""
WITH templates(template, label, exact, phrase, n, needed, required) AS (VALUES {rows}),
docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(0, len(words), {licenses.STEP})) AS s FROM docs),
blocks AS (SELECT doc_id, s, words[s + 1:s + {licenses.STEP + reach}] AS w FROM starts),
pairs AS (SELECT b.doc_id, b.s, b.w, t.*, len(list_distinct(list_filter(t.phrase, lambda x: list_contains(b.w, x)))) AS common FROM blocks b, templates t),
held AS (SELECT *, common / n AS share,
    CASE WHEN exact THEN list_transform(list_filter(range(0, least({licenses.STEP}, len(w))), lambda p: w[p + 1:p + len(phrase)] = phrase), lambda p: p + s) END AS places
  FROM pairs WHERE common >= needed AND list_has_all(w, required)),
true_ AS (SELECT * FROM held WHERE NOT exact OR len(places) > 0)
SELECT d.doc_id, any_value(len(d.words))::bigint AS n_words, coalesce(sum(len(h.places)), 0)::bigint AS n_base,
  min(list_min(h.places))::bigint AS first_word, max(list_max(h.places))::bigint AS last_word,
  coalesce(array_to_string(list_sort(list(DISTINCT h.label) FILTER (h.exact)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list(DISTINCT h.label) FILTER (h.label IS NOT NULL)), ','), '') AS labels, coalesce(max(h.share), 0.0)::double AS score
FROM docs d LEFT JOIN true_ h ON h.doc_id = d.doc_id GROUP BY d.doc_id"""


def op2() -> str:
    weights = ", ".join(map(str, mixing.WEIGHTS))
    most = mixing.MOST_EPOCHS
    return rf"""
WITH sized AS (SELECT d.doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size,
    CASE q WHEN 1 THEN 2.0::double WHEN 0 THEN 1.0::double ELSE 1.5::double END AS weight
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) USING (doc_id)),
totals AS (SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source),
placed AS (SELECT *, ([{weights}])[place % {len(mixing.WEIGHTS)} + 1] AS w FROM totals),
ranked AS (SELECT *, row_number() OVER r AS k, coalesce(sum(source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_size,
    coalesce(sum(w) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_w, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w
  FROM placed WINDOW r AS (ORDER BY source_size / w, place)),
level AS (SELECT total - {most} * before_size AS rest, all_w - before_w AS left_w FROM ranked
  WHERE {most} * source_size / w::double > (total - {most} * before_size) / (all_w - before_w)::double ORDER BY k LIMIT 1),
goals AS (SELECT source, source_size, CASE WHEN {most} * source_size::double <= w::bigint * rest::bigint / left_w::double THEN ({most} * source_size)::double
    ELSE w::bigint * rest::bigint / left_w::double END AS target FROM placed, level),
drawn AS (SELECT s.*, g.source_size, g.target, floor(g.target / g.source_size)::bigint AS epochs,
    -ln((('0x' || substr(md5('{mixing.SEED}|' || s.doc_id), 1, 12))::bigint + 0.5::double) / 281474976710656::double) / weight AS key
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
summed AS (SELECT *, target - epochs * source_size AS rest, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM drawn)
SELECT doc_id, size, source_size, target, (size * (epochs + (so_far + size / 2.0::double <= rest)::int))::bigint AS taken FROM summed"""


OP3 = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(0, len(words) - 49)) AS s FROM docs WHERE len(words) >= 50),
windows AS (SELECT doc_id, s, sha256(array_to_string(words[s + 1:s + 50], ' ')) AS h FROM starts),
first_ AS (SELECT h, min(doc_id) AS least FROM windows GROUP BY h),
gone AS (SELECT DISTINCT w.doc_id, unnest(range(w.s, w.s + 50)) AS p FROM windows w JOIN first_ USING (h) WHERE least < w.doc_id),
listed AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (SELECT d.doc_id, words, CASE WHEN ps IS NULL THEN words ELSE [words[i + 1] FOR i IN range(0, len(words)) IF NOT list_contains(ps, i)] END AS k FROM docs d LEFT JOIN listed USING (doc_id))
SELECT doc_id, len(words)::bigint AS n_words, (len(words) - len(k))::bigint AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept"""


def op6() -> str:
    k1, b = search.K1, search.B
    return rf"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS n FROM words GROUP BY ALL),
lens AS (SELECT d.doc_id, coalesce(l, 0) AS l FROM documents d LEFT JOIN (SELECT doc_id, sum(n) AS l FROM tf GROUP BY 1) USING (doc_id)),
stat AS (SELECT count(*) AS docs, sum(l) / count(*)::double AS mean FROM lens),
idf AS (SELECT term, ln(1 + (any_value(docs) - count(*) + 0.5::double) / (count(*) + 0.5::double)) AS idf FROM tf, stat GROUP BY term),
scores AS (SELECT q.doc_id AS query_id, t.doc_id, round(sum(q.n * idf * t.n * {k1 + 1}::double / (t.n + {k1}::double * ({1 - b}::double + {b}::double * l / mean))), 6) AS score
  FROM tf q JOIN idf USING (term) JOIN tf t USING (term) JOIN lens ON lens.doc_id = t.doc_id, stat WHERE q.doc_id % 100 = 0 GROUP BY 1, 2)
SELECT query_id, rank::int AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores) WHERE rank <= {TOP_K}"""


def op10() -> str:
    kept = ", ".join(f"'{h}'" for h in revisits.KEPT_HEADERS)
    bare = "regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
    for escaped, plain in revisits.UNRESERVED.items():
        bare = f"regexp_replace({bare}, '{escaped}', '{plain}', 'g')"
    return rf"""
WITH parts AS (SELECT *, {bare} AS bare FROM pages),
cut AS (SELECT *, regexp_extract(bare, '^([^?]*)', 1) AS place, regexp_extract(bare, '\?(.*)$', 1) AS query FROM parts),
keyed AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(place, '^([^/]*)', 1)), '^.*@', ''), '^www\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(place, '^[^/]*(.*)$', 1), '/+$', '')
    || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url_key, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag
  FROM (SELECT *, list_transform(list_sort(list_transform(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{revisits.TRACKING}')),
    lambda p, i: {{'name': regexp_extract(p, '^([^=]*)', 1), 'i': i, 'p': p}})), lambda x: x.p) AS params FROM cut)),
stored AS (SELECT page_id * 2 AS id, url_key, page_id * 10 AS cap, CASE WHEN page_id % 11 <> 0 THEN tag END AS tag, 'day ' || (page_id % 9) AS day,
    MAP {{'cache-control': 'max-age=60', 'content-length': strlen(coalesce(html, ''))::varchar, 'content-type': 'text/html', 'date': (page_id * 10)::varchar}} AS headers
  FROM keyed WHERE page_id % 13 <> 0),
asked AS (SELECT page_id * 2 + 1 AS id, url_key, page_id * 10 + 1 + (page_id % 5) * 1000 AS cap,
    CASE WHEN page_id % 11 <> 0 THEN CASE WHEN page_id % 7 = 0 THEN '"new-' || substr(md5(coalesce(html, '')), 1, 8) || '"' ELSE tag END END AS tag, 'day ' || (page_id % 9) AS day FROM keyed),
best AS (SELECT a.*, s.id AS sid, s.cap AS sat, s.tag AS stag, s.day AS sday, s.headers, row_number() OVER (PARTITION BY a.id ORDER BY s.cap DESC NULLS LAST, s.id DESC) AS n
  FROM asked a LEFT JOIN stored s ON s.url_key = a.url_key AND s.cap < a.cap),
told AS (SELECT *, CASE WHEN sid IS NULL THEN 'no_response' WHEN tag IS NOT NULL AND stag IS NOT NULL THEN CASE WHEN tag = stag THEN 'resolved' ELSE 'validators_differ' END
    WHEN day = sday THEN 'resolved' ELSE 'validators_differ' END AS outcome FROM best WHERE n = 1)
SELECT id AS record_id, url_key, cap AS captured_at, sid AS response_id, sat AS response_at, outcome,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=60; content-length: ' || headers['content-length'] || '; content-type: text/html; date: ' || cap || '; expires: ' || (cap + 60) END AS headers
FROM told -- headers of the revisit other than {kept.replace("'", "")} replace stored ones"""


def op7() -> str:
    d = decontaminate
    spaces = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    split = f"list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '{spaces}', ' ', 'g'), ' '), lambda w: w <> '')"
    return rf"""
WITH items AS (SELECT item_id, words, len(words) AS n, greatest({d.LEAST_PASSAGE}, pow(2, ceil(log2(len(words))) + 1)::bigint) AS size FROM (SELECT DISTINCT item_id, {split} AS words FROM benchmark) WHERE len(words) > 0),
stat AS (SELECT count(*) AS docs, avg(n) AS mean FROM items),
tf AS (SELECT item_id, any_value(n) AS n, any_value(size) AS size, w, count(*) AS tf FROM (SELECT item_id, n, size, unnest(words) AS w FROM items) GROUP BY item_id, w),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
gain AS (SELECT item_id, size, w, ln(1 + (docs - df + 0.5::double) / (df + 0.5::double)) * tf * {d.K1 + 1}::double / (tf + {d.K1}::double * ({1 - d.B}::double + {d.B}::double * n / mean)) AS g FROM tf JOIN df USING (w), stat),
own AS (SELECT item_id, sum(g) AS own FROM gain GROUP BY item_id),
docs AS (SELECT doc_id, {split} AS words FROM documents),
passages AS (SELECT doc_id, size, start, words[start + 1:start + size] AS words FROM (SELECT doc_id, words, size, unnest(range(0, greatest(1, (len(words) + size // 2 - 1) // (size // 2) - 1)::bigint * (size // 2), size // 2)) AS start
  FROM docs, (SELECT DISTINCT size FROM items))),
there AS (SELECT DISTINCT doc_id, size, start, unnest(words) AS w FROM passages),
found AS (SELECT doc_id, size, start, item_id, sum(g) / any_value(own) AS score FROM there JOIN gain USING (w, size) JOIN own USING (item_id) GROUP BY doc_id, size, start, item_id HAVING sum(g) >= {d.RETRIEVE} * any_value(own) - 1e-9),
pairs AS (SELECT f.*, p.words AS pw, i.words AS iw, i.n, least({d.SHINGLE}, i.n) AS g, CASE WHEN i.n > 1 THEN i.n - greatest(1, i.n // {d.ANSWER_PART}) ELSE 1 END AS cut
  FROM found f JOIN passages p USING (doc_id, size, start) JOIN items i USING (item_id)),
sets AS (SELECT *, list_distinct([array_to_string(iw[j + 1:j + g], ' ') FOR j IN range(0, n - g + 1)]) AS ish, [array_to_string(pw[j + 1:j + g], ' ') FOR j IN range(0, len(pw) - g + 1)] AS psh,
    list_distinct(iw[1:cut]) AS question, list_distinct(CASE WHEN n > 1 THEN iw[cut + 1:n] ELSE iw END) AS answer FROM pairs),
shares AS (SELECT *, len(list_filter(ish, lambda x: list_contains(psh, x))) / len(ish)::double AS shingle_share, len(list_filter(question, lambda x: list_contains(pw, x))) / len(question)::double AS question_share,
    len(list_filter(answer, lambda x: list_contains(pw, x))) / len(answer)::double AS answer_share FROM sets)
SELECT doc_id, item_id, count(*)::int AS n_passages, round(max(score), 6) AS score, max(shingle_share) AS shingle_share, max(question_share) AS question_share, max(answer_share) AS answer_share
FROM shares WHERE shingle_share >= {d.SHINGLES} AND question_share >= {d.QUESTION} AND answer_share >= {d.ANSWER} GROUP BY doc_id, item_id"""


def op12() -> str:
    polynomial = 0xEDB88320  # of CRC-32
    return rf"""
WITH steps AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {polynomial}) ELSE c >> 1 END) AS c FROM range(256) r(i))),
told AS (SELECT conv_id, turn, coalesce(role, '') AS role, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS words FROM conversations WHERE conv_id IS NOT NULL),
listed AS (SELECT conv_id, list(x ORDER BY turn NULLS FIRST, role, x) AS xs, list(words ORDER BY turn NULLS FIRST, role, x) AS ws FROM told GROUP BY conv_id),
taken AS (SELECT conv_id, xs, ws, xor(4294967295::bigint, list_reduce(list_concat([4294967295::bigint], list_transform(string_split(conv_id::varchar, ''), lambda d: ascii(d)::bigint)),
    lambda c, d: xor(c >> 8, t[(xor(c, d) & 255) + 1]))) % {MOST_TURNS + 1} AS h FROM listed, steps),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(g.xs[1:h], []), c.xs[h + 1:]) AS xs, list_concat(coalesce(g.ws[1:h], []), c.ws[h + 1:]) AS ws
  FROM taken c LEFT JOIN listed g ON g.conv_id = c.conv_id - c.conv_id % {TURN_GROUP}),
paths AS (SELECT conv_id, xs, ws, unnest(range(0, len(xs) + 1)) AS depth FROM rebuilt),
nodes AS (SELECT array_to_string(xs[1:depth], '') AS k, depth, min(conv_id) AS conv_id, count(*) AS n, coalesce(any_value(ws[depth]), 0) AS words,
    coalesce(array_to_string(list_sort(list(conv_id) FILTER (depth = len(xs))), ','), '') AS ids FROM paths GROUP BY 1, 2),
below AS (SELECT left(k, (64 * (depth - 1))::bigint) AS k, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
whole AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN below USING (k)),
above AS (SELECT left(k, (64 * a)::bigint) AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum((n - 1) * words) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM whole) GROUP BY 1)
SELECT w.conv_id, w.depth::bigint AS depth, p.conv_id AS parent_conv_id, w.n::bigint AS n_convs, w.n_children::bigint AS n_children, n_leaves::bigint AS n_leaves,
  saved::bigint AS saved_tokens, sha256(w.ids) AS ends_sha256
FROM whole w JOIN above USING (k) LEFT JOIN nodes p ON w.depth > 0 AND p.k = left(w.k, (64 * (w.depth - 1))::bigint)"""


OP13 = r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[j + 1:j + 5], ' ') FOR j IN range(0, len(w) - 4)])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::varchar[] END AS s FROM docs),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
both_ AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, b.v FROM reached r JOIN both_ b ON b.u = r.other)
SELECT s.doc_id, any_value(len(s.s))::bigint AS n_shingles, min(r.other) AS component_id, min(r.other) = s.doc_id AS kept
FROM sets s JOIN reached r USING (doc_id) GROUP BY s.doc_id"""


SQL: dict[str, str] = {"op1_license_scan": op1(), "op2_mix_sources": op2(), "op3_substring_dedup": OP3, "op6_topk_search": op6(), "op7_decontamination": op7(), "op10_revisits": op10(),
                       "op12_prefix_trie": op12(), "op13_minhash": OP13}
