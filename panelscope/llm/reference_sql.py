"""Reference SQL (DuckDB) of the corpus operators that plain SQL can express.

Written from their definitions: all pairs where Spark bands, recursion where it
contracts, base expressions as stated where it guards them.
"""

from __future__ import annotations

# shingles of five words with their counts, links, and everything that links reach
NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS x FROM words),
counts AS (SELECT doc_id, x, count(*) AS n FROM shingles GROUP BY doc_id, x),
sizes AS (SELECT doc_id, count(*) AS items, sum(n) AS total FROM counts GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS items, sum(least(a.n, b.n)) AS total
           FROM counts a JOIN counts b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared s JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
          WHERE 5 * s.items >= 4 * (p.items + q.items - s.items) OR 5 * s.total >= 4 * (p.total + q.total - s.total)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS node, doc_id AS seen FROM documents
            UNION SELECT r.node, l.b FROM reached r JOIN ways l ON l.a = r.seen)
SELECT node AS doc_id, min(seen) AS class_id, min(seen) = node AS is_first FROM reached GROUP BY node"""

# ASCII letters in lower case; white space and ASCII punctuation part words; a run of five words, or of as many as a short item has
CONTAINMENT = r"""
WITH texts AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
words AS (
    SELECT kind, id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+'), lambda x: x <> '') AS w FROM texts),
lengths AS (SELECT DISTINCT least(len(w), 5) AS k FROM words WHERE kind = 'i' AND len(w) > 0),
shingles AS (
    SELECT DISTINCT kind, id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS x
    FROM words JOIN lengths ON len(w) >= k AND (kind = 'd' OR k = least(len(w), 5))),
sizes AS (SELECT id, k, count(*) AS n FROM shingles WHERE kind = 'i' GROUP BY id, k)
SELECT d.id AS doc_id, i.id AS item_id, CAST(count(*) AS INTEGER) AS shared, CAST(any_value(n) AS INTEGER) AS item_shingles,
       CAST(count(*) AS DOUBLE) / any_value(n) AS containment
FROM shingles d JOIN shingles i ON d.x = i.x AND d.k = i.k AND d.kind = 'd' AND i.kind = 'i' JOIN sizes s ON s.id = i.id AND s.k = i.k
GROUP BY d.id, i.id HAVING 5 * count(*) >= 4 * any_value(n)"""


# lines that have a word, their distinct runs of seven characters, links, and what they reach
LINE_CLASSES = r"""
WITH RECURSIVE split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
numbered AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM split),
lines AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, l[i] AS line FROM numbered
          WHERE len(list_filter(string_split_regex(l[i], '[\x20\x09-\x0D]+'), lambda x: x <> '')) >= 1),
texts AS (SELECT line, row_number() OVER () AS k FROM (SELECT DISTINCT line FROM lines)),
grams AS (SELECT DISTINCT k, unnest(CASE WHEN length(line) <= 7 THEN [line]
              ELSE list_transform(range(1, length(line) - 5), lambda i: substr(line, i, 7)) END) AS x FROM texts),
sizes AS (SELECT k, count(*) AS n FROM grams GROUP BY k),
shared AS (SELECT a.k AS a, b.k AS b, count(*) AS n FROM grams a JOIN grams b ON a.x = b.x AND a.k < b.k GROUP BY a.k, b.k),
links AS (SELECT a, b FROM shared s JOIN sizes p ON p.k = a JOIN sizes q ON q.k = b WHERE 5 * s.n >= 4 * (p.n + q.n - s.n)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT a AS node, a AS seen FROM ways UNION SELECT r.node, w.b FROM reached r JOIN ways w ON w.a = r.seen),
roots AS (SELECT node, min(seen) AS root FROM reached GROUP BY node),
classed AS (SELECT doc_id, line_no, coalesce(root, k) AS root FROM lines JOIN texts USING (line) LEFT JOIN roots ON node = k)
SELECT doc_id, line_no, first_value(doc_id) OVER w AS class_doc_id, first_value(line_no) OVER w AS class_line_no,
       row_number() OVER w = 1 AS kept
FROM classed WINDOW w AS (PARTITION BY root ORDER BY doc_id, line_no)"""


def _found(kind: str, number: int, pattern: str, group: int = 0, keep: str = "true", around: bool = False) -> str:
    """Tables of all matches from left to right: rid, kind_no, kind, s, e (code points) and v, a group."""
    held = "p[i] AS before, p[i + 1] AS after, " if around else ""
    listed = "before, after, " if around else ""
    return f"""{kind}_m AS (
    SELECT rid, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS f,
           regexp_extract_all(text, '{pattern}', {group}) AS g FROM t WHERE regexp_matches(text, '{pattern}')),
{kind}_s AS (
    SELECT rid, {held}{number} AS kind_no, '{kind}' AS kind, g[i] AS v,
           list_sum(list_transform(p[1:i], lambda x: length(x)))
           + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS s, length(f[i]) AS n
    FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM {kind}_m)),
{kind} AS (SELECT rid, {listed}kind_no, kind, CAST(s AS BIGINT) AS s, CAST(s + n AS BIGINT) AS e, v FROM {kind}_s WHERE {keep})"""


TEXTS = """t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner,
           coalesce(source, '') || '/' || coalesce(lang, '') AS repository FROM documents)"""
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
SECRETS = f"""
WITH {TEXTS},
{_found('assign', 0, ASSIGN, 2, 'length(v) >= 6')},
{_found('access', 1, 'AKIA[A-Z0-9]{16,}')},
{_found('hex', 2, '[0-9a-f]{24,}')},
{_found('bare', 3, '[A-Za-z0-9+/_=-]{20,}', 0, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')")},
base AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex),
apart AS (SELECT * FROM bare b WHERE NOT EXISTS (SELECT 1 FROM base x WHERE x.rid = b.rid AND x.s < b.e AND x.e > b.s)),
held AS (SELECT * FROM base UNION ALL SELECT * FROM apart),
owned AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT repository) AS repositories FROM held JOIN t USING (rid) GROUP BY v),
judged AS (SELECT h.*, owners >= 3 AS example, owners <= 1 AND repositories <= 2 AS live FROM held h JOIN owned USING (v)),
per AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
               count(*) FILTER (kind = 'hex') AS n_hex,
               coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no) FILTER (kind <> 'bare'), '') AS base,
               coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no) FILTER (kind <> 'bare' OR live), '') AS spans,
               count(*) FILTER (kind = 'bare' AND live) AS n_bare_live, count(*) FILTER (live) AS n_live,
               count(*) FILTER (example) AS n_example FROM judged GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('n_assign', 'n_access', 'n_hex', 'n_bare_live', 'n_live', 'n_example'))},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN per USING (rid)"""

DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
DIGIT = f"CAST(substr({DIGITS}, length({DIGITS}) - i + 1, 1) AS INTEGER)"
LUHN = f"""list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {DIGIT}
    ELSE 2 * {DIGIT} - CASE WHEN {DIGIT} > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
OCTETS = """len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3
    OR coalesce(try_cast(ltrim(x, '0') AS INTEGER), 0) > 255)) = 0"""
WHITE = r"\x20\x09-\x0D"


# what lies between whitespace, without its punctuation, in lower case
CLEAN = r"regexp_replace(lower(regexp_extract({}, '{}', 1)), '[^\p{{L}}\p{{N}}]+', '', 'g')"


def _rounds(n: int) -> str:
    """Patterns are worth the mean of what they hold, values the best of their patterns."""
    out = []
    for k in range(1, n + 1):
        source = "(SELECT *, CASE WHEN seeds > 0 THEN 1.0 ELSE 0.0 END AS worth FROM edges)" if k == 1 else f"""(
        SELECT edges.*, coalesce(worth, CASE WHEN seeds > 0 THEN 1.0 ELSE 0.0 END) AS worth FROM edges LEFT JOIN values_{k - 1} USING (v))"""
        out.append(f"""patterns_{k} AS (SELECT pattern, sum(worth * n) / sum(n) AS trust FROM {source}
    GROUP BY pattern HAVING count(*) FILTER (seeds > 0) >= 5)""")
        if k < n:
            out.append(f"""values_{k} AS (SELECT v, CASE WHEN max(seeds) > 0 THEN 1.0 WHEN bool_or(likely) THEN max(trust) ELSE 0.0 END AS worth
    FROM edges JOIN patterns_{k} USING (pattern) GROUP BY v)""")
    return ",\n".join(out)


TOKEN = rf"[^{WHITE}]*[0-9@][^{WHITE}]*"
PERSONAL_DATA = rf"""
WITH {TEXTS},
{_found('email', 0, r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')},
{_found('ip', 1, r'[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)', 0, OCTETS)},
{_found('card', 2, r'[0-9]([\x20-]?[0-9])+', 0, f'length({DIGITS}) BETWEEN 13 AND 19 AND {LUHN}')},
{_found('phone', 3, r'\+[0-9][\x20().0-9-]+[0-9]', 0, f'length({DIGITS}) BETWEEN 9 AND 15')},
{_found('run', 4, rf'{TOKEN}(\x20+{TOKEN})*', around=True)},
base AS (SELECT * FROM email UNION ALL SELECT * FROM ip UNION ALL SELECT * FROM card UNION ALL SELECT * FROM phone),
words AS (SELECT rid, s, e, regexp_replace(v, '^[^\p{{L}}\p{{N}}+(]+', '') AS tail, v,
             {CLEAN.format('right(before, 64)', f'([^{WHITE}]+)[{WHITE}]*$')} AS w1,
             {CLEAN.format('right(before, 64)', f'([^{WHITE}]+)[{WHITE}]+[^{WHITE}]+[{WHITE}]*$')} AS w2,
             {CLEAN.format('left(after, 64)', f'^[{WHITE}]*([^{WHITE}]+)')} AS w3 FROM run),
cores AS (SELECT rid, s + length(words.v) - length(tail) AS s0, w1, w2, w3, regexp_replace(tail, '[^\p{{L}}\p{{N}})]+$', '') AS v,
             EXISTS (SELECT 1 FROM base b WHERE b.rid = words.rid AND b.s < words.e AND b.e > words.s) AS seed FROM words),
slots AS (SELECT rid, s0 AS s, s0 + length(v) AS e, v, w1, w2, w3, seed, CASE WHEN contains(v, '@') THEN '@' ELSE '9' END AS kind,
             length(regexp_replace(v, '[^0-9]', '', 'g')) >= 5 OR regexp_matches(v, '[^@]@[^@]') AS likely,
             left(regexp_replace(regexp_replace(regexp_replace(v, '[0-9]+', '9', 'g'), '\p{{L}}+', 'a', 'g'), '\x20+', ' ', 'g'), 48) AS shape FROM cores),
told AS (SELECT *, '1 ' || w1 || ' ' || shape AS pattern FROM slots WHERE w1 <> ''
         UNION ALL SELECT *, '2 ' || w2 || ' ' || w1 || ' ' || kind FROM slots WHERE w1 <> '' AND w2 <> ''
         UNION ALL SELECT *, '3 ' || w1 || ' ' || w3 || ' ' || kind FROM slots WHERE w1 <> '' AND w3 <> ''),
edges AS (SELECT pattern, v, count(*) AS n, count(*) FILTER (seed) AS seeds, bool_or(likely) AS likely FROM told GROUP BY pattern, v),
{_rounds(3)},
added AS (SELECT DISTINCT rid, 4 AS kind_no, 'found' AS kind, s, e FROM told JOIN patterns_3 USING (pattern) WHERE NOT seed AND likely AND trust >= 0.9),
held AS (SELECT rid, kind_no, kind, s, e FROM base UNION ALL SELECT * FROM added),
per AS (SELECT rid, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
               count(*) FILTER (kind = 'phone') AS n_phone, count(*) FILTER (kind = 'found') AS n_found,
               string_agg(kind || ':' || s || ':' || e, ',' ORDER BY kind_no, s) FILTER (kind <> 'found') AS base,
               string_agg(kind || ':' || s || ':' || e, ',' ORDER BY kind_no, s) AS spans FROM held GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('n_email', 'n_ip', 'n_card', 'n_phone', 'n_found'))},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN per USING (rid)"""


# texts as hexadecimal digits, two a byte: all strings of 400 bytes, and the runs of those that start twice
REPEATS = """
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS MATERIALIZED (SELECT rid, i, md5(substr(x, CAST(2 * i + 1 AS BIGINT), 800)) AS h
      FROM (SELECT rid, x, unnest(range(0, length(x) // 2 - 399)) AS i FROM t WHERE length(x) >= 800)),
hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS n FROM s) WHERE n > 1),
marked AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM hit),
numbered AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS run FROM marked),
runs AS (SELECT rid, run, min(i) AS a, max(i) + 400 AS b FROM numbered GROUP BY rid, run),
gaps AS (SELECT rid, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM runs WINDOW w AS (PARTITION BY rid ORDER BY a)
         UNION ALL SELECT rid, max(b), NULL FROM runs GROUP BY rid),
kept AS (SELECT rid, string_agg(CASE WHEN b IS NULL THEN substr(x, CAST(2 * a + 1 AS BIGINT))
                                     ELSE substr(x, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)) END, '' ORDER BY a) AS x
         FROM gaps JOIN t USING (rid) GROUP BY rid),
per AS (SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY rid)
SELECT doc_id, CAST(length(t.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.x, t.x))) AS kept_sha256
FROM t LEFT JOIN per USING (rid) LEFT JOIN kept USING (rid)"""


def vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Rounds of assignment and integer means, one table each."""
    floor = "(total - ((total % n) + n) % n) // n"
    held = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label,
      list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS MATERIALIZED (SELECT rid, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x
      FROM (SELECT rid, v, unnest(range({parts})) AS p FROM kept)),
seeds AS (SELECT rid, e FROM (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept) WHERE e < {entries}),
book_0 AS MATERIALIZED (SELECT p, e, x FROM seeds JOIN pieces USING (rid))"""
    for k in range(rounds + 1):
        held += f""",
near_{k} AS MATERIALIZED (SELECT rid, a.p, min([list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.e]) AS m
      FROM pieces a JOIN book_{k} b ON a.p = b.p GROUP BY rid, a.p)"""
        if k < rounds:
            held += f""",
means_{k} AS (SELECT p, e, list({floor} ORDER BY j) AS x FROM (
      SELECT p, e, j, count(*) AS n, CAST(sum(y) AS BIGINT) AS total FROM (
          SELECT p, m[2] AS e, unnest(x) AS y, unnest(range(len(x))) AS j FROM near_{k} JOIN pieces USING (rid, p))
      GROUP BY p, e, j) GROUP BY p, e),
book_{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(c.x, b.x) AS x FROM book_{k} b LEFT JOIN means_{k} c ON c.p = b.p AND c.e = b.e)"""
    return held + f""",
coded AS (SELECT rid, string_agg(printf('%02x', m[2]), '' ORDER BY p) AS code, CAST(sum(m[1]) AS BIGINT) AS error FROM near_{rounds} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book_{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (rid)"""
