"""DuckDB SQL that states the results of registered queries."""

from relief.llm.licenses import BASE, COMMON, RARE, TEMPLATES

OP1 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('1|' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents
),
held AS (
  SELECT source, sum(size)::DOUBLE AS s,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS w
  FROM sized GROUP BY source
),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY 3 * s / w, source NULLS LAST) AS r FROM held
),
levels AS (
  SELECT r, (total - coalesce(sum(3 * s) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         3 * s AS cap, w
  FROM ranked, (SELECT sum(s) AS total FROM held)
),
first_free AS (SELECT r, level FROM levels WHERE level * w < cap ORDER BY r LIMIT 1),
targets AS (
  SELECT source, s::BIGINT AS source_size,
         CASE WHEN r < coalesce((SELECT r FROM first_free), 1 << 40) THEN 3 * s ELSE (SELECT level FROM first_free) * w END AS target
  FROM ranked
),
plan AS (
  SELECT *, floor(target + 0.5)::BIGINT // greatest(source_size, 1) AS times,
         floor(target + 0.5)::BIGINT % greatest(source_size, 1) AS rest
  FROM targets
),
placed AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.times, p.rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.k) AS here,
         count(*) OVER (PARTITION BY d.source, d.k) AS peers
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       (times * size + CASE WHEN upto <= rest THEN size
                            WHEN upto - here <= rest THEN least(size, (rest - upto + here)::BIGINT // peers)
                            ELSE 0 END)::BIGINT AS taken
FROM placed
"""

OP4 = r"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS url,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
),
rules(kind, name, start) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
),
keyed AS (SELECT row_number() OVER () AS k, * FROM parts),
fitting AS (
  SELECT k, max_by(kind, length(name) + length(start)) AS kind, max_by(name || start, length(name) + length(start)) AS rule
  FROM keyed JOIN rules ON (host = name OR suffix(host, '.' || name)) AND starts_with(path, start)
  GROUP BY k
),
ruled AS (SELECT keyed.*, kind, rule, substr(md5(url), 1, 1) < '3' AS held_out FROM keyed LEFT JOIN fitting USING (k)),
urls AS (SELECT url, kind, held_out, count(*) AS n FROM ruled GROUP BY ALL),
grams AS (
  SELECT url, kind, held_out, n, substr('^^^' || url, i, 4) AS g
  FROM urls, LATERAL (SELECT unnest(generate_series(1, length(url))) AS i) WHERE length(url) > 0
),
g4 AS (
  SELECT g, sum(CASE WHEN kind = 'allow' AND NOT held_out THEN n ELSE 0 END) AS a,
         sum(CASE WHEN kind = 'block' AND NOT held_out THEN n ELSE 0 END) AS b
  FROM grams GROUP BY g
),
g3 AS (SELECT substr(g, 2, 3) AS g, sum(a) AS a, sum(b) AS b FROM g4 GROUP BY 1),
g2 AS (SELECT substr(g, 2, 2) AS g, sum(a) AS a, sum(b) AS b FROM g3 GROUP BY 1),
g1 AS (SELECT substr(g, 2, 1) AS g, sum(a) AS a, sum(b) AS b FROM g2 GROUP BY 1),
c4 AS (SELECT substr(g, 1, 3) AS c, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b, count_if(a > 0) AS ka, count_if(b > 0) AS kb FROM g4 GROUP BY 1),
c3 AS (SELECT substr(g, 1, 2) AS c, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b, count_if(a > 0) AS ka, count_if(b > 0) AS kb FROM g3 GROUP BY 1),
c2 AS (SELECT substr(g, 1, 1) AS c, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b, count_if(a > 0) AS ka, count_if(b > 0) AS kb FROM g2 GROUP BY 1),
c1 AS (SELECT sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b, count_if(a > 0) AS ka, count_if(b > 0) AS kb FROM g1),
m1 AS (
  SELECT g, CASE WHEN c.a + ka > 0 THEN (g1.a + ka * (1.0::DOUBLE / 256)) / (c.a + ka) ELSE 1.0::DOUBLE / 256 END AS pa,
         CASE WHEN c.b + kb > 0 THEN (g1.b + kb * (1.0::DOUBLE / 256)) / (c.b + kb) ELSE 1.0::DOUBLE / 256 END AS pb
  FROM g1, c1 c
),
m2 AS (
  SELECT x.g, CASE WHEN c.a + ka > 0 THEN (x.a + ka * pa) / (c.a + ka) ELSE pa END AS pa,
         CASE WHEN c.b + kb > 0 THEN (x.b + kb * pb) / (c.b + kb) ELSE pb END AS pb
  FROM g2 x JOIN c2 c ON c.c = substr(x.g, 1, 1) JOIN m1 m ON m.g = substr(x.g, 2, 1)
),
m3 AS (
  SELECT x.g, CASE WHEN c.a + ka > 0 THEN (x.a + ka * pa) / (c.a + ka) ELSE pa END AS pa,
         CASE WHEN c.b + kb > 0 THEN (x.b + kb * pb) / (c.b + kb) ELSE pb END AS pb
  FROM g3 x JOIN c3 c ON c.c = substr(x.g, 1, 2) JOIN m2 m ON m.g = substr(x.g, 2, 2)
),
m4 AS (
  SELECT x.g, CASE WHEN c.a + ka > 0 THEN (x.a + ka * pa) / (c.a + ka) ELSE pa END AS pa,
         CASE WHEN c.b + kb > 0 THEN (x.b + kb * pb) / (c.b + kb) ELSE pb END AS pb
  FROM g4 x JOIN c4 c ON c.c = substr(x.g, 1, 3) JOIN m3 m ON m.g = substr(x.g, 2, 3)
),
scores AS (SELECT url, avg(ln(pa) - ln(pb)) AS score FROM grams JOIN m4 USING (g) GROUP BY url),
bins AS (
  SELECT round(score / 0.01)::BIGINT AS bin, count_if(kind = 'allow') AS a, count_if(kind = 'block') AS b
  FROM urls JOIN scores USING (url) WHERE held_out AND kind IS NOT NULL GROUP BY 1
),
gaps AS (
  SELECT bin, (bin + coalesce(lead(bin) OVER (ORDER BY bin DESC), bin - 1)) / 2 AS middle,
         sum(a) OVER (ORDER BY bin DESC) / sum(a) OVER () - sum(b) OVER (ORDER BY bin DESC) / sum(b) OVER () AS gap
  FROM bins
),
best AS (SELECT middle * 0.01::DOUBLE AS t FROM gaps WHERE gap IS NOT NULL ORDER BY gap DESC, abs(bin), bin DESC LIMIT 1)
SELECT page_id, host, path, rule,
       coalesce(kind, CASE WHEN coalesce(score, 0) >= coalesce((SELECT t FROM best), 0) THEN 'allow' ELSE 'block' END) AS verdict
FROM ruled LEFT JOIN scores USING (url)
"""


def op7() -> str:
    """Templates and phrases are written out as values; the rest is plain SQL."""

    def rows(values) -> str:
        return ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in values)

    notices = [(k, i, w) for k, (_, n, _) in enumerate(TEMPLATES) for i, w in enumerate(n.split()) if w not in COMMON]
    phrases = [(f"{kind}{k}", kind, label, phrase, len(phrase.split()))
               for kind, table in (("b", [(a, b) for a, b in BASE]), ("t", [(a, c) for a, _, c in TEMPLATES]))
               for k, (label, phrase) in enumerate(table)]
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
words AS (SELECT k, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos, w FROM docs),
notices(template, place, word) AS (VALUES {rows(notices)}),
phrases(id, kind, label, phrase, n) AS (VALUES {rows(phrases)}),
labels(template, label) AS (VALUES {rows([(k, t[0]) for k, t in enumerate(TEMPLATES)])}),
found AS (
  SELECT k, id, kind, label, pos FROM words JOIN phrases ON word = split_part(phrase, ' ', 1)
  WHERE array_to_string(w[pos + 1:pos + n], ' ') = phrase
),
seen AS (SELECT word, count(DISTINCT k) AS files FROM words SEMI JOIN notices USING (word) GROUP BY word),
weighed AS (
  SELECT n.*, ln(1 + (SELECT count(*) FROM docs)::DOUBLE / (1 + coalesce(files, 0))) AS weight
  FROM notices n LEFT JOIN seen USING (word)
),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY template ORDER BY weight DESC, word) AS r FROM weighed),
postings AS (
  SELECT template, place, word, weight / sum(weight) OVER (PARTITION BY template) AS share FROM ranked WHERE r <= {RARE}
),
lined AS (
  SELECT k, template, sum(share) AS share FROM words JOIN postings USING (word) GROUP BY k, template, pos - place
),
best AS (
  SELECT k, template, round(least(max(share), 1.0), 6) AS share FROM lined GROUP BY k, template
  HAVING round(least(max(share), 1.0), 6) >= 0.5
),
kept AS (SELECT b.k, label, share FROM best b JOIN labels USING (template) SEMI JOIN found f ON f.k = b.k AND f.id = 't' || b.template),
base AS (
  SELECT k, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM found WHERE kind = 'b' GROUP BY k
),
every AS (
  SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT k, label FROM kept UNION ALL SELECT k, label FROM found WHERE kind = 'b') GROUP BY k
),
score AS (SELECT k, max(share) AS score FROM kept GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0)::DOUBLE AS score
FROM docs LEFT JOIN base USING (k) LEFT JOIN every USING (k) LEFT JOIN score USING (k)
"""

OP10 = r"""
WITH docs AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM docs),
windows AS (
  SELECT doc_id, pos, string_agg(word, ' ') OVER s AS seq, count(*) OVER s AS n
  FROM words WINDOW s AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
),
again AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY md5(seq) ORDER BY doc_id, pos) > 1 AS hit FROM windows WHERE n = 20
),
flagged AS (SELECT w.doc_id, w.word, w.pos, coalesce(a.hit, false) AS hit FROM words w LEFT JOIN again a USING (doc_id, pos)),
gone AS (
  SELECT doc_id, word, pos,
         bool_or(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS removed
  FROM flagged
),
sums AS (
  SELECT doc_id, count_if(removed) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT removed), '') AS kept
  FROM gone GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs d LEFT JOIN sums s USING (doc_id)
"""

OP13 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
),
words AS (SELECT k, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
langs AS (
  SELECT lang, coalesce(v, 0)::HUGEINT AS v, coalesce(n, 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang) USING (lang)
),
held AS (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (
  SELECT lang, source, v, coalesce(n, 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang, source FROM docs) JOIN (SELECT lang, v FROM langs) USING (lang)
  LEFT JOIN (SELECT lang, source, sum(c) AS n FROM held GROUP BY lang, source) USING (lang, source)
),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (g.n + g.v) AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN held h USING (lang, source, term)
),
whole AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (total + 1)) // (n + v) AS q FROM kept JOIN langs USING (lang)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
),
terms AS (
  SELECT s.lang, source, s.term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value
  FROM shares s JOIN whole w ON s.lang = w.lang AND s.term = w.term WHERE c > 0 AND p > q
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
