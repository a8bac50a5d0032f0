"""SQL that says what the queries of the training-data operators give, by other means: recursion, windows and plain joins."""

from __future__ import annotations

_TIES = r"""
k AS (SELECT ids.capsule_id AS r, ids.claim_family_id AS f, unnest(CASE WHEN len(provenance_sources) > 0 THEN list_transform(provenance_sources, lambda x: x.source_id) ELSE [NULL] END) AS s FROM capsules WHERE ids.capsule_id IS NOT NULL),
w AS (SELECT DISTINCT source_id AS s, lower(upper(trim(regexp_replace(a, '[\s\x{A0}\x{2009}\x{3000}]+', ' ', 'g')))) AS a FROM (SELECT source_id, unnest(authors) AS a FROM source_documents) WHERE source_id IS NOT NULL AND a IS NOT NULL),
ties AS (SELECT 'r:' || r AS a, 'f:' || f AS b FROM k WHERE f IS NOT NULL UNION SELECT 'r:' || r, 's:' || s FROM k WHERE s IS NOT NULL UNION SELECT 'r:' || r, 'r:' || r FROM k
 UNION SELECT 's:' || s, 'a:' || a FROM w WHERE a NOT IN ('', 'unknown', 'anonymous', 'n/a', 'staff')),
edges AS (SELECT a, b FROM ties UNION SELECT b, a FROM ties),
reach AS (SELECT a AS x, a AS y FROM edges UNION SELECT reach.x, edges.b FROM reach JOIN edges ON reach.y = edges.a)
"""

P1_FOUND = "WITH RECURSIVE " + _TIES + "SELECT min(substr(y, 3)) AS group_id, substr(x, 3) AS capsule_id FROM reach WHERE x LIKE 'r:%' AND y LIKE 's:%' GROUP BY x"

P1_COMPONENTS = "WITH RECURSIVE " + _TIES + """, c AS (SELECT x, min(y) AS root FROM reach GROUP BY x), n AS (SELECT root, count(*) AS n_records FROM c WHERE x LIKE 'r:%' GROUP BY root)
SELECT n_records, count(*) AS n_components FROM n GROUP BY 1"""

P5_FOUND = r"""WITH RECURSIVE k AS (SELECT DISTINCT claim_id FROM extracted_claims),
p AS (SELECT DISTINCT source_claim AS a, target_claim AS b FROM extracted_relations WHERE lower(regexp_replace(relation_type, '^\s+|\s+$', '', 'g')) = 'same_claim_family_as' AND source_claim <> target_claim
 AND source_claim IN (SELECT claim_id FROM k) AND target_claim IN (SELECT claim_id FROM k)),
edges AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
reach AS (SELECT a AS x, a AS y FROM edges UNION SELECT reach.x, edges.b FROM reach JOIN edges ON reach.y = edges.a)
SELECT min(y) AS group_id, x AS claim_id FROM reach GROUP BY x"""



_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_PLAIN = "".join(chr(i - 0xFEE0) for i in range(0xFF01, 0xFF5F))
_MINUS, _POINT = "", ""


def words(x: str) -> str:
    """The words of a text: blanks put wherever no word can go on, then split there. SQL has no NFKC, so wide letters and ligatures are named."""
    c = f"translate({x}, '{_WIDE.replace(chr(39), chr(39) * 2)}', '{_PLAIN.replace(chr(39), chr(39) * 2)}')"
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ß", "ss"), (" ", " ")):
        c = f"replace({c}, '{a}', '{b}')"
    c = rf"regexp_replace(' ' || lower(nfc_normalize({c})) || ' ', '([^\p{{L}}\p{{N}}])-(\p{{N}})', '\1{_MINUS}\2', 'g')"
    for _ in range(2):  # matches share a digit
        c = rf"regexp_replace({c}, '(\p{{N}})\.(\p{{N}})', '\1{_POINT}\2', 'g')"
    c = rf"regexp_replace({c}, '[^\p{{L}}\p{{N}}{_MINUS}{_POINT}]+', ' ', 'g')"
    return f"list_filter(string_split(replace(replace({c}, '{_MINUS}', '-'), '{_POINT}', '.'), ' '), lambda w: w <> '')"


def _slide(i: str, j: str) -> str:
    """How many words in a row are the same from a[i] and b[j] on."""
    n = f"least(len(a) - {i}, len(b) - {j})"
    return f"coalesce(nullif(list_position(list_transform(range({n}), lambda k: a[{i} + k + 1] <> b[{j} + k + 1]), true), 0) - 1, {n})"


# Pairs of texts within two word edits: from the furthest place reached with e edits on, each kind of edit and then all that is the same.
_NEAR = f"""
l AS (SELECT DISTINCT split_name AS split, capsule_id AS id FROM split_members WHERE split_name IS NOT NULL AND capsule_id IS NOT NULL),
r AS (SELECT DISTINCT ids.capsule_id AS id, ids.claim_family_id AS f, {words("claim.canonical_text")} AS w FROM capsules WHERE ids.capsule_id IN (SELECT id FROM l)),
x AS (SELECT split, l.id, f, w FROM l JOIN r ON l.id = r.id),
p AS (SELECT row_number() OVER () AS n, a, b FROM (SELECT DISTINCT e.w AS a, t.w AS b FROM (SELECT DISTINCT w FROM x WHERE split <> 'train' AND w IS NOT NULL) e JOIN (SELECT DISTINCT w FROM x WHERE split = 'train' AND w IS NOT NULL) t ON abs(len(e.w) - len(t.w)) <= 2)),
s AS (SELECT n, a, b, 0 AS e, {_slide("0", "0")} AS i, {_slide("0", "0")} AS j FROM p
 UNION ALL SELECT n, a, b, e + 1, i + di + {_slide("(i + di)", "(j + dj)")}, j + dj + {_slide("(i + di)", "(j + dj)")} FROM s, (VALUES (1, 1), (0, 1), (1, 0)) v(di, dj) WHERE e < 2 AND i + di <= len(a) AND j + dj <= len(b)),
near AS (SELECT DISTINCT a, b FROM s WHERE greatest(len(a) - i, len(b) - j) <= 2 - e),
pairs AS (SELECT e.split, e.id AS a, t.id AS b FROM x e JOIN x t ON t.split = 'train' AND e.split <> 'train' AND (e.f = t.f OR e.id = t.id)
 UNION SELECT e.split, e.id, t.id FROM x e JOIN near ON e.w = near.a JOIN x t ON t.w = near.b WHERE e.split <> 'train' AND t.split = 'train'),
found AS (SELECT DISTINCT split AS eval_split, least(a, b) AS capsule_a, greatest(a, b) AS capsule_b FROM pairs)
"""

P2_FOUND = "WITH RECURSIVE " + _NEAR + "SELECT eval_split, capsule_a, capsule_b FROM found"

P2_BY_SOURCE = "WITH RECURSIVE " + _NEAR + """, o AS (SELECT DISTINCT id, s FROM (SELECT ids.capsule_id AS id, unnest(list_transform(provenance_sources, lambda q: q.source_id)) AS s FROM capsules) WHERE s IS NOT NULL),
h AS (SELECT eval_split, capsule_a, capsule_b, s FROM found JOIN o ON id = capsule_a OR id = capsule_b)
SELECT eval_split, s AS source_id, count(*)::BIGINT AS n_pairs FROM (SELECT DISTINCT * FROM h) GROUP BY ALL
UNION ALL SELECT eval_split, NULL, count(*)::BIGINT FROM found WHERE capsule_a NOT IN (SELECT id FROM o) AND capsule_b NOT IN (SELECT id FROM o) GROUP BY ALL"""

# Leaves of a payload by their paths: the order of fields does not matter, that of lists is in the path, nulls are absent.
_KEYS = f"""
raw AS (SELECT DISTINCT raw_id AS rid, payload::JSON AS p FROM raw_claims WHERE raw_id IS NOT NULL AND json_valid(payload)),
tree AS (SELECT rid AS id, t.fullkey AS k, t.type AS y, t.atom AS v FROM raw, json_tree(raw.p) AS t WHERE t.type <> 'NULL' AND (t.type NOT IN ('OBJECT', 'ARRAY') OR json_array_length(t.value) = 0 AND t.type = 'ARRAY' OR t.value::VARCHAR = '{{}}')),
leaf AS (SELECT id, k, CASE WHEN y = 'VARCHAR' THEN 'w ' || array_to_string({words("v->>'$'")}, ' ') WHEN y IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN 'n ' || v::DOUBLE ELSE y || ' ' || coalesce(v::VARCHAR, '') END AS v FROM tree),
keys AS (SELECT 'extracted_claims' AS record_set, claim_id AS id, array_to_string({words("text")}, ' ') AS k FROM extracted_claims WHERE text IS NOT NULL AND claim_id IS NOT NULL
 UNION SELECT 'capsules', ids.capsule_id, array_to_string({words("claim.canonical_text")}, ' ') FROM capsules WHERE claim.canonical_text IS NOT NULL AND ids.capsule_id IS NOT NULL
 UNION SELECT 'raw_claims', id, string_agg(k || '=' || v, chr(10) ORDER BY k) FROM leaf GROUP BY id),
firsts AS (SELECT record_set, id, min(id) OVER (PARTITION BY record_set, k) AS first_id FROM keys)
"""

P3_FOUND = "WITH " + _KEYS + "SELECT record_set, first_id, id AS copy_id FROM firsts WHERE id <> first_id"

P3_RECORDS = "WITH " + _KEYS + "SELECT record_set, first_id, count(*) AS n_copies FROM firsts GROUP BY ALL"

_GRAMS = "SELECT DISTINCT {key}, array_to_string(w[i + 1 : i + 12], ' ') AS g FROM (SELECT {key}, w, unnest(range(len(w) - 11)) AS i FROM (SELECT {key}, {words} AS w FROM {table} WHERE {text} IS NOT NULL))"
_LEAKS = f"""d AS ({_GRAMS.format(key="doc_id", words=words("text"), table="documents", text="text")}), i AS ({_GRAMS.format(key="item_id", words=words("item_text"), table="eval_items", text="item_text")})
"""

P7_FOUND = "WITH " + _LEAKS + "SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (g)"

P2_CLASSES = "WITH RECURSIVE " + _NEAR + """, k AS (SELECT DISTINCT split, id, 'family' AS kind, f AS c FROM x WHERE f IS NOT NULL UNION SELECT split, id, 'text', array_to_string(w, ' ') FROM x WHERE w IS NOT NULL UNION SELECT split, id, 'record', id FROM x),
n AS (SELECT split, kind, c, count(*) AS n FROM k GROUP BY ALL), links AS (SELECT 'text' AS kind, array_to_string(a, ' ') AS a, array_to_string(b, ' ') AS b FROM near UNION SELECT DISTINCT kind, c, c FROM k WHERE kind <> 'text')
SELECT e.split AS eval_split, e.kind AS kind, e.c AS eval_class, t.c AS train_class, e.n AS n_eval, t.n AS n_train FROM n e JOIN links l ON l.kind = e.kind AND l.a = e.c JOIN n t ON t.kind = l.kind AND t.c = l.b WHERE e.split <> 'train' AND t.split = 'train'"""

# How natural a cut is before each place of an oversized text, told from what stands just before and after it; then cut after cut.
P4_CUTS = r"""WITH RECURSIVE c AS (SELECT chunk_id AS id, min(text) AS t FROM document_chunks WHERE chunk_id IS NOT NULL AND length(text) > 1200 GROUP BY 1),
p AS (SELECT id, t, unnest(range(1, length(t) + 1)) AS i FROM c),
o AS (SELECT id, i, substr(t, greatest(1, i - 199), least(i, 200)) AS b, substr(t, i + 1, 1) AS n, substr(t, i, 1) AS l, substr(t, i + 1, 200) AS a FROM p),
s AS (SELECT id, i, CASE
 WHEN l = chr(13) AND n = chr(10) THEN -1 WHEN regexp_matches(n, '\p{M}') THEN -1
 WHEN (i = 0 OR l = chr(10)) AND regexp_matches(a, '^[ 	]{0,3}#{1,6}[ 	]+[^
]*') THEN 6
 WHEN NOT regexp_matches(n, '^\s') AND regexp_matches(b, '(
|
|)[ 	]*(
|
|)\s*$') THEN 5
 WHEN l = chr(10) OR l = chr(13) THEN 4
 WHEN NOT regexp_matches(n, '^\s') AND regexp_matches(b, '[.!?…。！？]["''”»)\]]*\s+$') OR regexp_matches(b, '[。！？]$') AND NOT regexp_matches(a, '^[.!?…。！？"''”»)\]]*\s') THEN 3
 WHEN NOT regexp_matches(n, '^\s') AND regexp_matches(b, '[,;:|)\]}、，；：]\s*$') THEN 2
 WHEN NOT regexp_matches(n, '^\s') AND regexp_matches(b, '\s$') THEN 1 ELSE 0 END AS v FROM o),
cuts AS (SELECT id, 0 AS k, 0 AS a, length(t)::BIGINT AS n, CASE WHEN length(t) > 1200 THEN (SELECT CASE WHEN max(v) FILTER (i >= 600) > 0 THEN arg_max(i, (v, i)) FILTER (i >= 600) WHEN max(v) > 0 THEN arg_max(i, (v, i)) ELSE 1200 END FROM s WHERE s.id = c.id AND i BETWEEN 121 AND 1200) ELSE length(t) END AS b FROM c
 UNION ALL SELECT id, k + 1, (b - 120)::INTEGER, n, CASE WHEN n - b + 120 > 1200 THEN (SELECT CASE WHEN max(v) FILTER (i >= b - 120 + 600) > 0 THEN arg_max(i, (v, i)) FILTER (i >= b - 120 + 600) WHEN max(v) > 0 THEN arg_max(i, (v, i)) ELSE b - 120 + 1200 END FROM s WHERE s.id = cuts.id AND i BETWEEN b - 120 + 121 AND b - 120 + 1200) ELSE n END FROM cuts WHERE b < n)
SELECT id AS chunk_id, k AS piece_index, a AS from_char, b AS to_char FROM cuts"""
