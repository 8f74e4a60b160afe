"""DuckDB SQL of the operators on sequences: conversation structure and periodic runs."""

from __future__ import annotations

from loomstar.llm.periodic_runs import LEAST, PERIODS
from loomstar.llm.turn_repair import DELETE, INSERT, REROLE, TRUNCATED

#: The table t of CRC-32, as a common table expression.
CRC = """crc AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce([CAST(n AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, x: CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END) AS v FROM range(256) r(n)))"""


def crc32(text: str) -> str:
    """CRC-32 of a text of ASCII characters, with crc's table t at hand."""
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))), lambda v, x: xor(v >> 8, t[CAST(xor(v, x) & 255 AS INTEGER) + 1])))"


PERIODIC_RUNS = f"""
WITH {CRC},
doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, CAST(doc_id AS VARCHAR) AS id FROM documents),
hashed AS (SELECT r, doc_id, w, CAST(len(w) AS BIGINT) AS n, {crc32("id")} AS h FROM doc, crc),
begun AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM hashed),
own AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END + 1]) END AS w FROM begun),
word AS (SELECT r, i, w[i + 1] AS x, n FROM (SELECT r, w, n, unnest(range(n)) AS i FROM own WHERE n >= {LEAST})),
often AS (SELECT * FROM word QUALIFY count(*) OVER (PARTITION BY r, x) >= {PERIODS}),
same AS (SELECT a.r, a.i, b.i - a.i AS q FROM often a JOIN often b ON a.r = b.r AND a.x = b.x AND b.i > a.i AND (b.i - a.i) * {PERIODS} <= a.n),
stretch AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM same) GROUP BY r, q, island HAVING count(*) + q >= greatest({LEAST}, {PERIODS} * q)),
run AS (SELECT * FROM stretch x WHERE NOT EXISTS (SELECT 1 FROM stretch y WHERE y.r = x.r AND y.q < x.q AND x.q % y.q = 0 AND y.s <= x.s AND y.s + y.l >= x.s + x.l)),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY r ORDER BY l::DOUBLE / q DESC, s, q) = 1),
listed AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM run GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM run),
left_over AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS words FROM (SELECT r, w[i + 1] AS x, i FROM (SELECT r, w, unnest(range(n)) AS i FROM own SEMI JOIN run USING (r))) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, 1000 * l // q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, array_to_string(w, ' '))) AS collapsed_sha256, n AS n_words
FROM own LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN left_over USING (r)"""

SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

TURN_REPAIR = f"""
WITH RECURSIVE {CRC},
turns AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("key")} % 20 AS harm FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations), crc),
harmed AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN harm = 3 THEN 2 ELSE 1 END)) AS copy FROM turns WHERE harm <> 0),
conv AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
placed AS (SELECT c, turn, role, text, substr(role, 1, 1) AS initial, trim(text, {SPACES}) AS core, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM harmed h JOIN conv v ON h.conv_id IS NOT DISTINCT FROM v.conv_id),
faulted AS MATERIALIZED (SELECT *, CASE WHEN core = '' THEN 1 WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 2 WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(initial) OVER (PARTITION BY c ORDER BY i) AS before FROM placed),
fits AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) f(s, initial, e)),
one AS (SELECT * FROM (VALUES (0, 2), (1, 2), (2, 3), (3, 2)) o(s, e)),
pre AS (SELECT s, s AS mid, 0 AS cost, '' AS audit FROM one UNION ALL SELECT s, e, {INSERT}, 'I' FROM one UNION ALL SELECT a.s, b.e, {2 * INSERT}, 'II' FROM one a JOIN one b ON a.e = b.s),
move AS (SELECT s, initial, fault, e, min({{'cost': cost, 'audit': audit}}) AS m FROM (
    SELECT p.s, x.initial, x.fault, p.mid AS e, p.cost + {DELETE} AS cost, p.audit || 'D' AS audit FROM pre p, (SELECT DISTINCT initial, fault FROM faulted) x
    UNION ALL SELECT p.s, x.initial, x.fault, o.e, p.cost + {REROLE} + CASE WHEN fault = 3 THEN {TRUNCATED} ELSE 0 END, p.audit || 'R' FROM pre p JOIN one o ON o.s = p.mid, (SELECT DISTINCT initial, fault FROM faulted) x WHERE fault NOT IN (1, 2)
    UNION ALL SELECT p.s, x.initial, x.fault, f.e, p.cost + CASE WHEN fault = 3 THEN {TRUNCATED} ELSE 0 END, p.audit || 'K' FROM pre p JOIN fits f ON f.s = p.mid JOIN (SELECT DISTINCT initial, fault FROM faulted) x ON x.initial = f.initial WHERE fault NOT IN (1, 2)) GROUP BY ALL),
walk AS (SELECT c, CAST(0 AS BIGINT) AS i, 0 AS s, {{'cost': 0, 'audit': ''}} AS m FROM conv
    UNION ALL SELECT w.c, f.i, v.e, min({{'cost': w.m.cost + v.m.cost, 'audit': w.m.audit || v.m.audit}}) FROM walk w JOIN faulted f ON f.c = w.c AND f.i = w.i + 1 JOIN move v ON v.s = w.s AND v.initial = f.initial AND v.fault = f.fault GROUP BY w.c, f.i, v.e),
told AS (SELECT c, CAST(max(turn) - min(turn) + 1 - count(DISTINCT turn) AS BIGINT) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM faulted GROUP BY c),
final AS (SELECT c, min({{'cost': m.cost + CASE s WHEN 1 THEN {2 * INSERT} WHEN 2 THEN {INSERT} ELSE 0 END, 'audit': m.audit || CASE s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END}}) AS m FROM walk JOIN told USING (c) WHERE i = n GROUP BY c),
edit AS (SELECT c, k, substr(m.audit, k, 1) AS e, k - len(replace(substr(m.audit, 1, k), 'I', '')) AS inserted FROM (SELECT c, m, unnest(range(1, len(m.audit) + 1)) AS k FROM final)),
kept AS (SELECT x.c, k, e, role, text, initial, row_number() OVER (PARTITION BY x.c ORDER BY k) - 1 AS nth FROM edit x LEFT JOIN faulted f ON f.c = x.c AND f.i = k - inserted AND e <> 'I' WHERE e <> 'D'),
line AS (SELECT *, CASE WHEN e = 'K' THEN role WHEN (nth - coalesce(max(CASE WHEN nth = 0 AND e = 'K' AND initial = 's' THEN 1 END) OVER (PARTITION BY c), 0)) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END AS words FROM kept),
repaired AS (SELECT c, string_agg(words, chr(10) ORDER BY k) AS words FROM line GROUP BY c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(m.cost, 0) AS BIGINT) AS cost, coalesce(m.audit, '') AS audit, sha256(coalesce(words, '')) AS repaired_sha256
FROM conv LEFT JOIN told USING (c) LEFT JOIN final USING (c) LEFT JOIN repaired USING (c)"""
