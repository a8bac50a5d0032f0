"""SQL that several queries share."""

from __future__ import annotations

from claimloom.functions.text import STOPWORDS
from claimloom.operators.claims import ASSERTIVE, BOILERPLATE, OTHERWISE, RULES


def quoted(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def fold(x: str) -> str:
    return f"lower(replace({x}, 'ß', 'ss'))"


def tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all({fold(x)}, '[a-z0-9]+'), lambda t: t NOT IN ({quoted(STOPWORDS)}))"


def fingerprint(x: str) -> str:
    return f"coalesce(array_to_string({tokens(x)}, ' '), '')"


def digest(*parts: str, length: int = 24) -> str:
    return f"substr(sha256(concat_ws(chr(31), {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)})), 1, {length})"


def _any(x: str, cues: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{c}')" for c in cues) + ")"


def _rule(x: str, which: int) -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN {_any(x, r[0])} THEN {q(r[which])}" for r in RULES) + f" ELSE {q(OTHERWISE[which - 1])} END"


SQUEEZE = r"trim(regexp_replace({x}, '[\s\x{{A0}}\x{{2009}}\x{{3000}}]+', ' ', 'g'))"


def claims(source: str, doc: str, chunk: str, text: str) -> str:
    """CTEs ending in `claims`, as extract_claims gives them."""
    low = "' ' || " + fold("s") + " || ' '"
    return f"""
WITH raw AS (SELECT {doc} AS document_id, {chunk} AS chunk_id, unnest(regexp_extract_all(regexp_replace({text}, '\\n\\z', ''), '[^.!?\\n]+(?:[.!?]|\\z)')) AS r FROM {source}),
sent AS (SELECT document_id, chunk_id, {SQUEEZE.format(x="r")} AS s FROM raw),
cand AS (
  SELECT *, {low} AS padded FROM sent
  WHERE length(s) BETWEEN 32 AND 480 AND NOT ends_with(s, '?') AND NOT {_any(fold("s"), BOILERPLATE)} AND {_any(low, ASSERTIVE)}),
claims AS (
  SELECT document_id, chunk_id, s AS text, {fingerprint("s")} AS normalized_text, {_rule("padded", 1)} AS claim_type, {_rule("padded", 2)} AS cue_category,
    round(least(0.86::DOUBLE, 0.45::DOUBLE + {_rule("padded", 3)}::DOUBLE + least(length({fingerprint("s")}) / 500.0::DOUBLE, 0.12::DOUBLE)), 3) AS confidence
  FROM cand WHERE {fingerprint("s")} <> '')
"""


def placed_claims(source: str, doc: str, chunk: str, text: str, start: str) -> str:
    """CTEs ending in `placed`: the claims with the number and the places of their sentences, told from running lengths of all pieces of a text."""
    low = "' ' || " + fold("s") + " || ' '"
    pieces = f"regexp_extract_all(regexp_replace({text}, '\\n\\z', ''), '[^.!?\\n]+(?:[.!?]|\\z)|[\\s\\S]')"
    return f"""
WITH pieces AS (SELECT {doc} AS document_id, {chunk} AS chunk_id, {start} AS start, unnest({pieces}) AS r, unnest(range(len({pieces}))) AS k FROM {source}),
runs AS (SELECT *, sum(length(r)) OVER w - length(r) AS p, length(r) > 1 OR (k = max(k) OVER (PARTITION BY document_id, chunk_id, start) AND NOT regexp_matches(r, '[.!?\\n]')) AS is_sentence FROM pieces WINDOW w AS (PARTITION BY document_id, chunk_id, start ORDER BY k)),
sent AS (SELECT *, row_number() OVER (PARTITION BY document_id, chunk_id, start ORDER BY k) - 1 AS i, {SQUEEZE.format(x="r")} AS s FROM runs WHERE is_sentence),
placed AS (
  SELECT document_id, chunk_id, i::INTEGER AS sentence_index, {fingerprint("s")} AS normalized_text, (start + p)::INTEGER AS source_start_char, (start + p + length(regexp_replace(r, '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g')))::INTEGER AS source_end_char FROM sent
  WHERE length(s) BETWEEN 32 AND 480 AND NOT ends_with(s, '?') AND NOT {_any(fold("s"), BOILERPLATE)} AND {_any(low, ASSERTIVE)} AND {fingerprint("s")} <> '')
"""


def mean_rounded(x: str, digits_in: int, digits_out: int) -> str:
    return f"floor((sum(CAST(round({x} * {10**digits_in}) AS BIGINT)) * {2 * 10 ** (digits_out - digits_in)} + count({x})) / (count({x}) * 2)) / {float(10**digits_out)}"


def strip(x: str, sides: str = "both") -> str:
    blanks = r"[\s\x0b\x{A0}\x{2009}\x{3000}]+"
    return f"regexp_replace({x}, '{'^' + blanks if sides == 'left' else f'^{blanks}|{blanks}$'}', '', 'g')"


def chunks(most: int = 1200) -> str:
    """CTEs ending in `chunks`, as chunk_documents gives them for source documents whose lines end in line feeds: lines to runs, headings to paths, sentences to packed pieces."""
    return rf"""
WITH RECURSIVE d AS (SELECT DISTINCT document_id, text FROM source_documents WHERE document_id IS NOT NULL AND text IS NOT NULL),
l0 AS (SELECT document_id, length(text) AS n, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
l1 AS (SELECT *, {strip('line')} AS body, sum(length(line) + 1) OVER (PARTITION BY document_id ORDER BY i) - length(line) - 1 AS a FROM l0),
l2 AS (SELECT *, CASE WHEN regexp_matches(body, '^#{{1,6}}\s+\S') THEN 2 WHEN body <> '' THEN 1 ELSE 0 END AS kind FROM l1),
l3 AS (SELECT *, coalesce(sum((kind = 2)::INT) OVER (PARTITION BY document_id ORDER BY i), 0) AS sec, i - row_number() OVER (PARTITION BY document_id, kind ORDER BY i) AS run FROM l2),
h AS (SELECT document_id, sec AS rn, length(regexp_extract(body, '^(#+)', 1)) AS lvl, {strip("regexp_extract(body, '^#{1,6}(.*)$', 1)")} AS title FROM l3 WHERE kind = 2),
hp AS (SELECT document_id, rn, [title] AS path FROM h WHERE rn = 1 UNION ALL SELECT h.document_id, h.rn, list_concat(list_slice(hp.path, 1, h.lvl - 1), [h.title]) FROM hp JOIN h ON h.document_id = hp.document_id AND h.rn = hp.rn + 1),
b0 AS (SELECT document_id, min(i) AS f, string_agg(body, chr(10) ORDER BY i) AS t, arg_min(a + length(line) - length({strip('line', 'left')}), i)::BIGINT AS s, least(max(a + length(line) + 1), max(n))::BIGINT AS e, min(sec) AS sec FROM l3 WHERE kind = 1 GROUP BY document_id, run),
b AS (SELECT * FROM b0 UNION ALL SELECT document_id, 0, {strip('text')}, instr(text, left({strip('text')}, 1)) - 1, length(text), 0 FROM d WHERE {strip('text')} <> '' AND document_id NOT IN (SELECT document_id FROM b0)),
x0 AS (SELECT document_id, f, unnest(string_split(regexp_replace(t, '([.!?])(\s+)', '\1' || chr(1) || '\2' || chr(2), 'g'), chr(2))) AS piece, unnest(range(len(string_split(regexp_replace(t, '([.!?])(\s+)', '\1' || chr(1) || '\2' || chr(2), 'g'), chr(2))))) AS k FROM b WHERE length(t) > {most}),
x1 AS (SELECT document_id, f, k, split_part(piece, chr(1), 1) AS s, sum(length(replace(piece, chr(1), ''))) OVER w - length(replace(piece, chr(1), '')) AS off FROM x0 WINDOW w AS (PARTITION BY document_id, f ORDER BY k)),
x2 AS (SELECT document_id, f, row_number() OVER (PARTITION BY document_id, f ORDER BY k) - 1 AS k, s, off, sum(length(s) + 1) OVER (PARTITION BY document_id, f ORDER BY k) AS upto FROM x1 WHERE s <> ''),
g AS (SELECT document_id, f, 0::BIGINT AS k, (SELECT greatest(1, count(*)) FROM x2 y WHERE y.document_id = x.document_id AND y.f = x.f AND y.upto - 1 <= {most}) AS m FROM x2 x WHERE k = 0
 UNION ALL SELECT g.document_id, g.f, g.m, (SELECT greatest(g.m + 1, g.m + count(*)) FROM x2 y WHERE y.document_id = g.document_id AND y.f = g.f AND y.k >= g.m AND y.upto - z.upto - 1 <= {most}) FROM g JOIN x2 z ON z.document_id = g.document_id AND z.f = g.f AND z.k = g.m - 1 JOIN x2 v ON v.document_id = g.document_id AND v.f = g.f AND v.k = g.m),
q0 AS (SELECT g.document_id, g.f, g.k, string_agg(s, ' ' ORDER BY x2.k) AS piece, min(off) AS off FROM g JOIN x2 ON x2.document_id = g.document_id AND x2.f = g.f AND x2.k >= g.k AND x2.k < g.m GROUP BY ALL),
q AS (SELECT document_id, f, k, c, {strip(f"substr(piece, c * {most} + 1, {most})")} AS piece, off + c * {most} AS off FROM (SELECT *, unnest(range((length(piece) + {most} - 1) // {most})) AS c FROM q0)),
r AS (SELECT b.document_id, b.f, coalesce(q.k, 0) AS k, coalesce(q.c, 0) AS c, coalesce(q.piece, b.t) AS piece, (b.s + coalesce(q.off, 0))::INTEGER AS a, (CASE WHEN q.piece IS NULL THEN b.e ELSE b.s + q.off + length(q.piece) END)::INTEGER AS z, b.sec FROM b LEFT JOIN q ON q.document_id = b.document_id AND q.f = b.f),
chunks AS (SELECT r.document_id, row_number() OVER (PARTITION BY r.document_id ORDER BY r.f, r.k, r.c) - 1 AS chunk_index, piece, a, z, coalesce(hp.path, []) AS path FROM r LEFT JOIN hp ON hp.document_id = r.document_id AND hp.rn = r.sec)
"""
