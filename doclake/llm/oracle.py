"""SQL of the check engine for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from doclake.llm import licenses, url_filters

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows: list[list[str]]) -> str:
    return ", ".join("(" + ", ".join(r) + ")" for r in rows)


# --- op3: every block against every template, every position against every phrase ---

_TEMPLATE_ROWS = _values([[_quoted(t), _quoted(label)] for t, label in licenses.TEMPLATES.items()])
_PHRASE_ROWS = _values([[_quoted(p), _quoted(label)] for p, label in licenses.PHRASES.items()])
_PARTS = r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

LICENSES = f"""
WITH templates AS (SELECT list_distinct(string_split(t, ' ')) AS tw, label FROM (VALUES {_TEMPLATE_ROWS}) v(t, label)),
phrases AS (SELECT string_split(p, ' ') AS pw, label FROM (VALUES {_PHRASE_ROWS}) v(p, label)),
docs AS (SELECT doc_id, coalesce(text, '') AS text,
                list_filter(string_split_regex(lower(coalesce(text, '')), {_PARTS}), lambda x: x <> '') AS w FROM documents),
places AS (SELECT doc_id, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + len(pw)] = pw)) AS place
           FROM docs, phrases WHERE list_contains(w, pw[1])),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
                string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
blocks AS (SELECT doc_id, unnest(string_split_regex(text, '[.!?]\\s+|\\n\\s*\\n')) AS block FROM docs),
block_words AS (SELECT doc_id, list_distinct(string_split_regex(lower(block), {_PARTS})) AS bw FROM blocks
                WHERE lower(block) SIMILAR TO '(?s).*(licen|reserved|permi|compliance|domain|charge|redistribut|software).*'),
shares AS (SELECT doc_id, label, len(list_intersect(bw, tw)) / len(tw) AS share FROM block_words, templates),
method AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM shares
           WHERE share >= {licenses.TENTHS} / 10 GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_filter(list_concat(
           string_split(coalesce(base_labels, ''), ','), coalesce(labels, [])), lambda x: x <> ''))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM docs d LEFT JOIN base USING (doc_id) LEFT JOIN method USING (doc_id)
"""

# --- op7: every url against every rule ---


def _like(pattern: str) -> str:
    """A pattern rule as a regular expression of the check engine."""
    head = ""
    if pattern.startswith("||"):
        head, pattern = "^[^:/?#]*://([^/?#]*[.])?", pattern[2:]
    out = ""
    for c in pattern:
        out += {"*": ".*", "^": "([^0-9a-z_.%-]|$)"}.get(c) or (c if c.isalnum() else f"[{c}]")
    return head + out


_PLACES = _values([[_quoted(r.pattern), _quoted(r.pattern.split("/")[0]), _quoted("/" + r.pattern.split("/", 1)[1]),
                    _quoted(r.action)] for r in url_filters.PLACE_RULES])
_PATTERNS = _values([[_quoted(r.pattern), _quoted(_like(r.pattern)), _quoted(r.action)] for r in url_filters.PATTERN_RULES])

URLS = f"""
WITH parts AS (
  SELECT page_id, url, translate(url, '{_UPPER}', '{_LOWER}') AS low,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
                 regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM parts),
rules AS (SELECT * FROM (VALUES {_PLACES}) v(pattern, rule_host, rule_path, action)),
patterns AS (SELECT * FROM (VALUES {_PATTERNS}) v(pattern, regex, action)),
fits AS (
  SELECT page_id, pattern, action, 1 AS level FROM split, rules
  WHERE (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path)
  UNION ALL
  SELECT page_id, pattern, action, 0 FROM split, patterns WHERE strpos(url, '://') > 0 AND regexp_matches(low, regex)),
best AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY level DESC, length(pattern) DESC,
                                      (action = 'allow') DESC, pattern DESC) AS r FROM fits)
SELECT s.page_id, s.host, s.path, CASE WHEN level = 1 THEN pattern END AS rule,
       coalesce(action, 'allow') AS verdict, pattern
FROM split s LEFT JOIN (SELECT * FROM best WHERE r = 1) b USING (page_id)
"""

# --- op11: all pairs of an anchor and a row ---

HARD_NEGATIVES = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM vectors a JOIN vectors r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

# --- op12: runs of a level by windows, level after level ---

_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _row_digest(text: str) -> str:
    field = lambda f: f"coalesce(strlen({f}::VARCHAR) || ':' || ({f}::VARCHAR), '-')"
    return "sha256(" + " || ".join(field(text if f == "text" else f) for f in _FIELDS) + ")"


def _tree(name: str, leaves: str) -> str:
    """All levels of the trees of ``leaves`` (k, idx, d); a level whose node is alone has no more above it."""
    return f"""{name} AS (
  SELECT k, 0 AS level, idx, d, count(*) OVER (PARTITION BY k) AS n FROM {leaves}
  UNION ALL
  SELECT k, level + 1, up, sha256(run), count(*) OVER (PARTITION BY k)
  FROM (SELECT k, level, idx // 16 AS up, string_agg(d, '' ORDER BY idx) AS run FROM {name} WHERE n > 1 GROUP BY ALL))"""


_CRC = """(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)))))"""
_LOWERED = f"translate(text, '{_UPPER}', '{_LOWER}')"

MERKLE = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce('=' || source, '') AS k, {_row_digest('text')} AS d,
         CASE WHEN xor({_CRC}, 4294967295) % 5 = 0 THEN {_row_digest(_LOWERED)} ELSE {_row_digest('text')} END AS start
  FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, d) - 1 AS idx FROM rows),
{_tree('low', 'leaves')},
subroots AS (SELECT k AS grp, d AS subroot FROM low WHERE n = 1),
named AS (SELECT '' AS k, grp, subroot AS d, row_number() OVER (ORDER BY encode(grp)) - 1 AS idx FROM subroots),
{_tree('high', 'named')},
runs AS (
  SELECT k, level, idx // 16 AS up, list(d ORDER BY idx) AS run, 'low' AS part FROM low WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT k, level, idx // 16 AS up, list(d ORDER BY idx), 'high' FROM high WHERE n > 1 GROUP BY ALL),
steps AS (
  SELECT l.doc_id, l.k, l.idx AS leaf_idx, 0 AS part_no, r.level, l.idx // (16 ** r.level)::BIGINT % 16 AS slot, r.run
  FROM leaves l JOIN runs r ON r.part = 'low' AND r.k = l.k AND r.up = l.idx // (16 ** (r.level + 1))::BIGINT
  UNION ALL
  SELECT l.doc_id, l.k, l.idx, 1, r.level, n.idx // (16 ** r.level)::BIGINT % 16, r.run
  FROM leaves l JOIN named n ON n.grp = l.k JOIN runs r ON r.part = 'high' AND r.up = n.idx // (16 ** (r.level + 1))::BIGINT),
paths AS (
  SELECT k, leaf_idx, list({{'l': array_to_string(run[:slot], ''), 'r': array_to_string(run[slot + 2:], '')}}
                           ORDER BY part_no, level) AS path
  FROM steps GROUP BY k, leaf_idx),
folded AS (
  SELECT l.doc_id, l.k, l.d, p.path, list_reduce(list_prepend({{'l': l.start, 'r': ''}}, coalesce(p.path, [])),
         lambda acc, s: {{'l': sha256(s.l || acc.l || s.r), 'r': ''}}).l AS f
  FROM leaves l LEFT JOIN paths p ON p.k = l.k AND p.leaf_idx = l.idx)
SELECT doc_id, f.d AS leaf, s.subroot, h.d AS root,
       sha256(array_to_string(list_transform(coalesce(path, []), lambda s: s.l || s.r), '')) AS proof_sha256,
       f AS folded_root, f = h.d AS verified
FROM folded f JOIN subroots s ON s.grp = f.k, (SELECT d FROM high WHERE n = 1) h
"""

ORACLES: dict[str, str] = {"op3_license_scans": LICENSES, "op7_url_filters": URLS, "op11_hard_negatives": HARD_NEGATIVES,
                           "op12_merkle_manifest": MERKLE}
