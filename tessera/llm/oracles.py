"""DuckDB SQL for the queries that SQL can express, from the same rule tables."""

from __future__ import annotations

from . import licenses, quality, secrets
from .merkle import _EMPTY, PIECE_WORDS
from .substrings import WINDOW


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_DOCS = "docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
_SPACE = r"[\x20\x09-\x0D]+"

FINGERPRINTS = rf"""WITH {_DOCS},
ranked AS (SELECT *, row_number() OVER (ORDER BY doc_id DESC) AS r, count(*) OVER () AS n FROM docs),
pairs AS (SELECT a.doc_id, a.text, length(a.text) AS n_chars, b.doc_id AS next_id,
  left(a.text, length(a.text) - length(a.text) // 2) || left(b.text, length(a.text) // 2) AS edited
  FROM ranked a JOIN ranked b ON b.r = a.r % a.n + 1),
every AS (SELECT doc_id, 0 AS kind, text FROM pairs UNION ALL SELECT doc_id, 1, edited FROM pairs),
cut AS (SELECT doc_id, kind, list_transform(string_split(text, chr(10)), lambda p: list_transform(string_split(
  regexp_replace(regexp_replace(p, '([.!?] +)', '\1' || chr(1), 'g'), '((?:[^ \x01]+ +){{{PIECE_WORDS}}})', '\1' || chr(1), 'g'), chr(1)), lambda x: md5(x))) AS t FROM every),
joined AS (SELECT *, array_to_string(list_transform(t, lambda l: ',' || md5(array_to_string(l, '')) || '.'), '') AS s FROM cut),
parts AS (SELECT *, list_filter(string_split(regexp_replace(s, '(,[0-3][0-9a-f]{{31}}[.]|,{_EMPTY}[.])', '\1;', 'g'), ';'), lambda x: x <> '') AS c FROM joined),
cut_trees AS (SELECT doc_id, kind, sha256(array_to_string(list_transform(c, lambda x: md5(x)), '')) AS root,
  array_to_string(list_transform(c, lambda x: left(md5(x), 16) || ':' || (length(x) - length(replace(x, ',', '')))), ',') AS sections,
  array_to_string(list_transform(t, lambda l: array_to_string(list_transform(l, lambda x: left(x, 8)), '')), ',') AS paragraphs,
  list_transform(list_filter(flatten(t), lambda x: x <> '{_EMPTY}'), lambda x: left(x, 8)) AS every_leaf FROM parts),
each AS (SELECT doc_id, kind, unnest(every_leaf) AS leaf FROM cut_trees),
numbered AS (SELECT doc_id, kind, leaf || ':' || row_number() OVER (PARTITION BY doc_id, kind, leaf) AS leaf FROM each),
gathered AS (SELECT doc_id, kind, list(leaf) AS leaves FROM numbered GROUP BY 1, 2),
trees AS (SELECT c.*, coalesce(g.leaves, []) AS leaves FROM cut_trees c LEFT JOIN gathered g ON g.doc_id = c.doc_id AND g.kind = c.kind),
secs AS (SELECT doc_id, kind, unnest(string_split(sections, ',')) AS x, unnest(range(1, len(string_split(sections, ',')) + 1)) AS i FROM cut_trees),
ends AS (SELECT doc_id, kind, x, CAST(split_part(x, ':', 2) AS BIGINT) AS n, CAST(sum(CAST(split_part(x, ':', 2) AS BIGINT)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS e FROM secs),
odd AS (SELECT * FROM ends s WHERE NOT EXISTS (SELECT 1 FROM ends o WHERE o.doc_id = s.doc_id AND o.kind = 1 - s.kind AND o.x = s.x)),
spread AS (SELECT doc_id, kind, unnest(range(e - n + 1, e + 1)) AS j FROM odd),
pars AS (SELECT s.doc_id, s.kind, string_split(t.paragraphs, ',')[s.j] AS p FROM spread s JOIN cut_trees t ON t.doc_id = s.doc_id AND t.kind = s.kind),
in_sections AS (SELECT doc_id, count(*) AS n FROM odd WHERE kind = 0 GROUP BY 1),
in_paragraphs AS (SELECT doc_id, count(*) AS n FROM pars a WHERE kind = 0 AND NOT EXISTS (SELECT 1 FROM pars b WHERE b.doc_id = a.doc_id AND b.kind = 1 AND b.p = a.p) GROUP BY 1),
near AS (SELECT p.doc_id, p.n_chars, sha256(p.edited) AS edited_sha256, a.root || '|' || a.sections || '|' || a.paragraphs AS fingerprint,
  e.root || '|' || e.sections || '|' || e.paragraphs AS edited_fingerprint, a.root AS ra, e.root AS re, x.root AS rx, a.leaves AS la, e.leaves AS le, x.leaves AS lx
  FROM pairs p JOIN trees a ON a.doc_id = p.doc_id AND a.kind = 0 JOIN trees e ON e.doc_id = p.doc_id AND e.kind = 1 JOIN trees x ON x.doc_id = p.next_id AND x.kind = 0)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN ra = re THEN 1.0 WHEN len(la) + len(le) = 0 THEN 0.0 ELSE 2.0::DOUBLE * len(list_intersect(la, le)) / (len(la) + len(le)) END::DOUBLE AS near_edited,
  CASE WHEN ra = rx THEN 1.0 WHEN len(la) + len(lx) = 0 THEN 0.0 ELSE 2.0::DOUBLE * len(list_intersect(la, lx)) / (len(la) + len(lx)) END::DOUBLE AS near_next,
  coalesce(s.n, 0) AS changed_sections, coalesce(q.n, 0) AS changed_paragraphs
FROM near LEFT JOIN in_sections s USING (doc_id) LEFT JOIN in_paragraphs q USING (doc_id)"""


def _secret_rule(order: int, rule: secrets.Rule) -> str:
    regex = _quoted(("(?i)" if rule.any_case else "") + rule.regex)
    return f"""SELECT doc_id, {order} AS o, '{rule.kind}' AS kind, m, g, p FROM (SELECT doc_id, regexp_extract_all(text, {regex}, 0) AS m,
  regexp_extract_all(text, {regex}, {rule.group}) AS g, string_split_regex(text, {regex}) AS p FROM docs) WHERE len(m) > 0"""


_LEAST = ", ".join(f"({i}, {r.least})" for i, r in enumerate(secrets.RULES))
SECRETS = f"""WITH {_DOCS},
found AS ({' UNION ALL '.join(_secret_rule(i, r) for i, r in enumerate(secrets.RULES))}),
least(o, least) AS (VALUES {_LEAST}),
each AS (SELECT doc_id, o, kind, m, g, p, unnest(range(1, len(m) + 1)) AS i FROM found),
spans AS (SELECT doc_id, e.o, kind, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s,
  length(m[i]) AS n FROM each e JOIN least l ON l.o = e.o WHERE length(g[i]) >= l.least),
texts AS (SELECT doc_id, o, kind, s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT) AS t FROM spans)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(t, ',' ORDER BY s, o) FILTER (o < {len(secrets.BASE_RULES)}), '')) AS base_sha256, coalesce(string_agg(t, ',' ORDER BY s, o), '') AS spans
FROM docs d LEFT JOIN texts USING (doc_id) GROUP BY d.doc_id"""


def _quality_rule(rule: quality.Rule) -> str:
    above, below = quality._MEASURES[rule.measure]
    value = f"CAST({above} AS DOUBLE) / {below}"
    bounds = [f"{value} {op} {x}" for op, x in ((">=", rule.low), ("<=", rule.high)) if x is not None]
    return f"(n_words < {rule.min_words} OR ({' AND '.join(bounds)}))"


_STOP = ", ".join(_quoted(w) for w in quality.STOP_FORMS)
QUALITY = rf"""WITH {_DOCS},
cut AS (SELECT doc_id, text, list_filter(string_split_regex(text, '{_SPACE}'), lambda w: w <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - {quality.WINDOW - 2})) AS i FROM cut WHERE len(words) > {quality.WINDOW}),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i + {quality.WINDOW - 1}], ' ')) AS n FROM starts),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, range({quality.WINDOW}) t(k) WHERE windows.n > 1 GROUP BY doc_id),
counts AS (SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, (length(text) - length(replace(text, '!', '')))::BIGINT AS n_exclaims,
  len(list_filter(words, lambda w: w IN ({_STOP})))::BIGINT AS n_stop FROM cut LEFT JOIN covered USING (doc_id)),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {' AND '.join(_quality_rule(r) for r in quality.RULES)} AS kept, n_lines, n_exclaims, n_stop FROM failed"""

_RULES = ", ".join(f"({r.priority}, {_quoted(r.label)}, {_quoted(f' {licenses.doubled(r.regex)} ')}, {r.score}::DOUBLE)" for r in licenses.rules())
_BASE = " UNION ALL ".join(
    f"SELECT doc_id, 0 AS priority, '{label}' AS label, i AS s, i + {len(p.split())} AS e, 1.0::DOUBLE AS score FROM (SELECT doc_id, words, unnest(range(len(words))) AS i FROM cut) "
    f"WHERE array_to_string(words[i + 1:i + {len(p.split())}], ' ') = '{p}'"
    for p, label in licenses.BASE
)
LICENSES = rf"""WITH {_DOCS},
cut AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM docs),
norm AS (SELECT doc_id, ' ' || array_to_string(words, '  ') || ' ' AS norm FROM cut WHERE len(words) > 0),
rules(priority, label, regex, score) AS (VALUES {_RULES}),
met AS (SELECT doc_id, priority, label, score, regexp_extract_all(norm, regex, 0) AS m, string_split_regex(norm, regex) AS p FROM norm JOIN rules ON regexp_matches(norm, regex)),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM met),
placed AS (SELECT doc_id, priority, label, score, (length(t) - length(replace(t, ' ', ''))) // 2 AS s, (length(m[i]) - length(replace(m[i], ' ', ''))) // 2 AS n
  FROM (SELECT *, array_to_string(p[1:i], '') || array_to_string(m[1:i - 1], '') AS t FROM each)),
base AS ({_BASE}),
every AS (SELECT DISTINCT doc_id, priority, label, s, s + n AS e, score FROM placed UNION ALL SELECT * FROM base),
kept AS (SELECT * FROM every d WHERE priority = 0 OR NOT EXISTS (SELECT 1 FROM every o WHERE o.doc_id = d.doc_id AND o.s <= d.s AND o.e >= d.e
  AND (o.priority < d.priority OR (o.priority = d.priority AND o.e - o.s > d.e - d.s)))),
of_base AS (SELECT doc_id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY 1),
of_kept AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM kept GROUP BY 1)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0.0)::DOUBLE AS score FROM cut LEFT JOIN of_base USING (doc_id) LEFT JOIN of_kept USING (doc_id)"""

SUBSTRINGS = f"""WITH {_DOCS},
cut AS (SELECT doc_id, list_filter(string_split_regex(text, '{_SPACE}'), lambda w: w <> '') AS words FROM docs),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM cut WHERE len(words) >= {WINDOW}),
windows AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(words[i:i + {WINDOW - 1}], ' ') ORDER BY doc_id, i) AS r FROM starts),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM windows, range({WINDOW}) t(k) WHERE r > 1),
each AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM cut),
left_over AS (SELECT e.doc_id, string_agg(e.words[e.i], ' ' ORDER BY e.i) AS t, count(*) AS n FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i WHERE g.i IS NULL GROUP BY 1)
SELECT c.doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM cut c LEFT JOIN left_over l ON l.doc_id = c.doc_id"""

ORACLE_SQL: dict[str, str] = {
    "op1_document_fingerprints": FINGERPRINTS,
    "op2_secret_scan": SECRETS,
    "op3_quality_rules": QUALITY,
    "op4_license_scan": LICENSES,
    "op10_substring_dedup": SUBSTRINGS,
}
