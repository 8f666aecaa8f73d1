"""DuckDB SQL of the pipeline queries that SQL can express: the definitions, without the operators' shortcuts."""

from __future__ import annotations

from . import quality_rules, ranked_search, secret_scan

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 18, 1))) AS r(i)),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, unnest(range(0, 20)) AS r(k)),
placed AS (SELECT doc_id, w[i] AS word, i FROM d, unnest(range(1, len(w) + 1)) AS r(i)),
kept AS (
  SELECT p.doc_id, count(*) AS n, string_agg(p.word, ' ' ORDER BY p.i) AS t
  FROM placed p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

QUALITY_RULES = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 1))) AS r(i)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, unnest(range(0, 5)) AS r(k) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(lines) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits
  FROM d LEFT JOIN covered USING (doc_id)
),
f AS (SELECT *, ({" + ".join(f"CASE WHEN {rule} THEN {quality_rules.BITS[name]} ELSE 0 END" for name, rule in quality_rules.RULES.items())})::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  failed_bits & {quality_rules.policy_mask("base")} != 0 AS base_failed,
  failed_bits & {quality_rules.policy_mask("base") | quality_rules.policy_mask("v2")} = 0 AS kept, failed_bits FROM f
"""


def matches(name: str, pattern: str, group: int = 0) -> str:
    """Rows (doc_id, nth, start, size, value) of a pattern; starts from the lengths of what lies between the matches."""
    p = pattern.replace("'", "''")
    return f"""{name} AS (
  SELECT doc_id, i AS nth, (list_sum(list_transform(s[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0))::BIGINT AS start,
    length(m[i]) AS size, m[i] AS value, g[i] AS part
  FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS g, string_split_regex(t, '{p}') AS s FROM d WHERE regexp_matches(t, '{p}')),
  unnest(range(1, len(m) + 1)) AS r(i)
)"""


def entropy(kind: str) -> str:
    import math

    alphabet, least = secret_scan.CLASSES[kind]
    limit = (math.floor(math.log2(secret_scan.WINDOW) * 1_000_000) - least) * secret_scan.WINDOW
    w = secret_scan.WINDOW
    own = kind.split("_")[1]
    inside = "[" + alphabet.replace("-", "") + ("-" if "-" in alphabet else "") + "]"
    return f"""win_{own} AS (
  SELECT doc_id, nth, start + i - 1 AS start, substr(value, i, {w}) AS v FROM suspect, unnest(range(1, length(value) - {w} + 2)) AS r(i)
  WHERE regexp_full_match(substr(value, i, {w}), '{inside}+')
),
hot_{own} AS (
  SELECT doc_id, nth, start FROM (
    SELECT doc_id, nth, start, ch, count(*) AS n FROM win_{own}, unnest(string_split(v, '')) AS r(ch) GROUP BY ALL
  ) GROUP BY doc_id, nth, start HAVING sum({secret_scan.MICRO}[n + 1]) <= {limit}
),
span_{own} AS (
  SELECT doc_id, {secret_scan.KINDS.index(kind)} AS kind, min(start) AS start, max(start) + {w} AS stop FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY doc_id, nth ORDER BY start) AS island FROM (
      SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY doc_id, nth ORDER BY start) <= {w} THEN 0 ELSE 1 END AS fresh FROM hot_{own}
    )
  ) GROUP BY doc_id, nth, island
)"""



LISTED = "string_agg(['" + "', '".join(secret_scan.KINDS) + "'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop)"

SECRET_SCAN = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{matches("assigned", secret_scan.ASSIGN, 2)},
{matches("accessed", "AKIA[A-Z0-9]+")},
{matches("hexed", "[0-9a-f]{16,}")},
{matches("candidate", secret_scan.CANDIDATE)},
suspect AS (
  SELECT * REPLACE (array_to_string(list_transform(list_zip(string_split_regex(value, '{secret_scan.ALLOWED}'), regexp_extract_all(value, '{secret_scan.ALLOWED}')),
    lambda x: x[1] || repeat(' ', coalesce(length(x[2]), 0))), '') AS value) FROM candidate WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
    AND (regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') OR regexp_matches(value, '([0-9][^0-9]*){{4}}'))
),
{entropy("entropy_hex")},
{entropy("entropy_key")},
base AS (
  SELECT doc_id, 0 AS kind, start, start + size AS stop FROM assigned WHERE length(part) >= 12
  UNION ALL SELECT doc_id, 1, start, start + size FROM accessed WHERE size >= 18
  UNION ALL SELECT doc_id, 2, start, start + size FROM hexed
),
every AS (SELECT * FROM base UNION ALL SELECT * FROM span_hex UNION ALL SELECT * FROM span_key),
b AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, {LISTED} AS listed FROM base GROUP BY doc_id),
e AS (SELECT doc_id, {LISTED} AS spans FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(listed, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN e USING (doc_id)
"""

JACCARD_JOIN = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 2, 1))) AS r(i)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM both_ways UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON r.other = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce((SELECT min(other) FROM reach WHERE reach.doc_id = d.doc_id), d.doc_id)::BIGINT AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""

RANKED_SEARCH = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ranked_search.UPPER}', '{ranked_search.LOWER}'), '{ranked_search.TERM}') AS w FROM documents),
total AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
tf AS (SELECT r, doc_id, len(w)::BIGINT AS n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, w, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{ranked_search.UPPER}', '{ranked_search.LOWER}'), '{ranked_search.TERM}')) AS term FROM benchmark),
weighed AS (SELECT item_id, term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM q JOIN df USING (term), total WHERE item_id IS NOT NULL),
scored AS (
  SELECT item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms)))))::BIGINT AS score
  FROM weighed JOIN tf USING (term), total WHERE doc_id IS NOT NULL GROUP BY ALL
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0
) WHERE rank <= 50
"""

ORACLES: dict[str, str] = {
    "op1_substring_dedup": SUBSTRING_DEDUP,
    "op5_quality_rules": QUALITY_RULES,
    "op7_secret_scan": SECRET_SCAN,
    "op8_jaccard_join": JACCARD_JOIN,
    "op11_ranked_search": RANKED_SEARCH,
}
