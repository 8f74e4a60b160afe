"""DuckDB SQL for the queries that SQL can express, each over whole tables. The others are tested against brute force."""

from __future__ import annotations

from loomstar.llm import licences, packing, sharding, trie_join, url_graph
from loomstar.llm.common import LOWER, UPPER
from loomstar.llm.decontamination import N
from loomstar.llm.neardup import WORDS
from loomstar.llm.sql_sequences import PERIODIC_RUNS, TURN_REPAIR

ASCII_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

DECONTAMINATION = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({ASCII_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
gram AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS words FROM (SELECT item, w, least(len(w), {N}) AS k, unnest(range(1, len(w) - least(len(w), {N}) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
win AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS words FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM gram) WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, k, item FROM win JOIN gram USING (k, words)),
place AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN place USING (doc_id) LEFT JOIN named USING (doc_id)"""

def linked_sql(words: int, percent: int, more: str = "") -> str:
    """Documents, their shingles and the least id that links reach; more: further columns."""
    return f"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {words - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {words - 1}) + 1)) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM doc UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id{more} FROM doc LEFT JOIN size USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)"""


NEARDUP = linked_sql(WORDS, 80, ", doc_id = component_id AS kept")
TRIE_JOIN = linked_sql(trie_join.WORDS, 90)



def packing_sql(longest: int = packing.LONGEST, buckets: int = packing.BUCKETS, budget: int = packing.BUDGET, slots: int = packing.SLOTS) -> str:
    """The dynamic program, step by step: at step k, the least padding of the first j lengths in k buckets."""
    steps = ["b1 AS (SELECT j, len * n - t AS cost, CAST(0 AS BIGINT) AS cut FROM p WHERE j > 0)"]
    for k in range(2, buckets + 1):
        steps.append(f"b{k} AS (SELECT j, cost, cut FROM (SELECT p.j, b.cost + p.len * (p.n - q.n) - (p.t - q.t) AS cost, q.j AS cut, row_number() OVER (PARTITION BY p.j ORDER BY b.cost + p.len * (p.n - q.n) - (p.t - q.t), q.j) AS nth FROM p JOIN p q ON q.j < p.j JOIN b{k - 1} b ON b.j = q.j) WHERE nth = 1)")
    back = [f"c{buckets} AS (SELECT max(j) AS j FROM p)"]
    for k in range(buckets, 1, -1):
        back.append(f"c{k - 1} AS (SELECT cut AS j FROM b{k} WHERE j = (SELECT j FROM c{k}))")
    bounds = " UNION ALL ".join(f"SELECT j FROM c{k}" for k in range(1, buckets + 1))
    return f"""
WITH long AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS total FROM documents),
cut AS (SELECT doc_id, CAST(piece AS INTEGER) AS piece, CAST(least({longest}, total - piece * {longest}) AS INTEGER) AS n_tokens FROM (SELECT doc_id, total, unnest(range(0, greatest(1, CAST(ceil(total / CAST({longest} AS DOUBLE)) AS BIGINT)))) AS piece FROM long)),
h AS (SELECT CAST(n_tokens AS BIGINT) AS len, count(*) AS c FROM cut GROUP BY 1),
p AS (SELECT CAST(row_number() OVER (ORDER BY len) AS BIGINT) AS j, len, CAST(sum(c) OVER (ORDER BY len) AS BIGINT) AS n, CAST(sum(c * len) OVER (ORDER BY len) AS BIGINT) AS t FROM h UNION ALL SELECT 0, 0, 0, 0),
{", ".join(steps)}, {", ".join(back)},
bound AS (SELECT DISTINCT CAST(len AS INTEGER) AS bucket FROM p JOIN ({bounds}) USING (j)),
dealt AS (SELECT doc_id, piece, n_tokens, (SELECT min(bucket) FROM bound WHERE bucket >= n_tokens) AS bucket, CAST('0x' || substr(md5(doc_id || '/' || piece), 1, 8) AS BIGINT) % {slots} AS slot FROM cut),
numbered AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY slot, doc_id, piece, n_tokens) - 1 AS number, greatest(1, {budget} // greatest(1, bucket)) AS size FROM dealt)
SELECT doc_id, piece, n_tokens, bucket, CAST(number // size AS BIGINT) AS batch, CAST(number % size AS BIGINT) AS place, bucket - n_tokens AS padding FROM numbered"""


TEMPLATES = ", ".join(f"('{k}', '{v}')" for k, v in licences.TEMPLATES.items())
BODIES = ", ".join("({}, '{}', {}, '{}')".format(i, name, body, text.replace("'", "''")) for i, (name, body, text) in enumerate(licences.block_templates()))
SPDX_NAMES = ", ".join(f"'{n}'" for n in sorted({*licences.TEMPLATES, *(n for n, _, _ in licences.block_templates())} - {"Proprietary"}))
TOKENS = lambda text: f"regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '{licences.TOKEN}')"
#: Every line and sentence is weighed here, without anchors; then blocks of runs, SPDX identifiers, and directories.
LICENCES = f"""
WITH file AS MATERIALIZED (SELECT doc_id, text, source || CASE WHEN doc_id % 100 = 0 THEN '' WHEN doc_id % 10 = 0 THEN '/' || lang ELSE '/' || lang || '/d' || (doc_id % 97) END AS directory FROM documents),
template AS (SELECT licence, token, count(*) AS tf FROM (SELECT licence, unnest({TOKENS("line")}) AS token FROM (VALUES {TEMPLATES}) AS v(licence, line)) GROUP BY ALL),
idf AS (SELECT token, ln({len(licences.TEMPLATES) + 1}.0::DOUBLE / (count(*) + 1.0::DOUBLE)) + 1.0::DOUBLE AS idf FROM template GROUP BY token),
vec AS (SELECT licence, token, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY licence)) AS t FROM template JOIN idf USING (token)),
line AS (SELECT doc_id, line, string_split(regexp_replace(line, '([.!?])\\s+(\\p{{Lu}})', '\\1' || chr(30) || '\\2', 'g'), chr(30)) AS parts FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM file)),
piece AS MATERIALIZED (SELECT doc_id, line, TRUE AS whole, len(parts) = 1 AS part FROM line UNION ALL SELECT doc_id, unnest(parts), FALSE, TRUE FROM line WHERE len(parts) > 1),
term AS (SELECT line, token, count(*) AS tf FROM (SELECT line, unnest({TOKENS("line")}) AS token FROM (SELECT DISTINCT line FROM piece)) GROUP BY ALL),
w AS (SELECT line, token, tf * coalesce(idf, ln({len(licences.TEMPLATES) + 1}.0::DOUBLE) + 1.0::DOUBLE) AS w FROM term LEFT JOIN idf USING (token)),
norm AS (SELECT line, sqrt(sum(w * w)) AS norm FROM w GROUP BY line),
cosine AS (SELECT line, licence, round(sum(w * t) / any_value(norm), 9) AS similarity FROM w JOIN vec USING (token) JOIN norm USING (line) GROUP BY line, licence),
best AS (SELECT line, arg_min(licence, (-similarity, licence)) AS licence, max(similarity) AS similarity FROM cosine WHERE similarity >= {licences.THRESHOLD} GROUP BY line),
body AS (SELECT t, licence, is_body, list_transform(range(1, len(w) - {licences.RUN - 2}), lambda i: array_to_string(w[i:i + {licences.RUN - 1}], ' ')) AS runs FROM (SELECT t, licence, is_body, {TOKENS("text")} AS w FROM (VALUES {BODIES}) AS v(t, licence, is_body, text))),
brun AS (SELECT t, run, count(*) AS tf FROM (SELECT t, unnest(runs) AS run FROM body) GROUP BY ALL),
ridf AS (SELECT run, ln(((SELECT count(*) FROM body) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) + 1.0::DOUBLE AS idf FROM brun GROUP BY run),
rvec AS (SELECT t, run, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY t)) AS share FROM brun JOIN ridf USING (run)),
drun AS (SELECT doc_id, pos, array_to_string(w[pos:pos + {licences.RUN - 1}], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - {licences.RUN - 2})) AS pos FROM (SELECT doc_id, {TOKENS("text")} AS w FROM file))),
hit AS (SELECT doc_id, pos, run FROM (SELECT doc_id, pos, run, lag(pos) OVER o AS b, lead(pos) OVER o AS a FROM drun SEMI JOIN ridf USING (run) WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) WHERE b = pos - 1 OR a = pos + 1),
block AS (SELECT doc_id, pos, run, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= {licences.GAP} THEN 0 ELSE 1 END AS fresh FROM hit)),
bterm AS (SELECT doc_id, block, run, count(*) AS tf, min(pos) AS first, max(pos) AS last FROM block GROUP BY ALL),
bsum AS (SELECT doc_id, block, sum(tf) AS runs, max(last) - min(first) + 1 AS span, sum(tf * idf * tf * idf) AS square FROM bterm JOIN ridf USING (run) GROUP BY ALL HAVING sum(tf) >= {licences.LEAST_RUNS}),
bdot AS (SELECT doc_id, block, t, sum(tf * idf * share) AS dot FROM bterm JOIN ridf USING (run) JOIN rvec USING (run) GROUP BY ALL),
bcos AS (SELECT doc_id, block, span, licence, is_body, round(dot / sqrt(square + (span - bsum.runs) * power(ln((SELECT count(*) FROM body) + 1.0::DOUBLE) + 1.0::DOUBLE, 2)), 9) AS similarity FROM bdot JOIN bsum USING (doc_id, block) JOIN body USING (t)),
bbest AS (SELECT doc_id, span + {licences.RUN - 1} AS words, b.licence AS licence, b.similarity AS similarity, b.is_body AS is_body FROM (SELECT doc_id, block, any_value(span) AS span, arg_min({{'licence': licence, 'similarity': similarity, 'is_body': is_body}}, (-similarity, licence, is_body)) AS b FROM bcos GROUP BY doc_id, block) WHERE b.similarity >= {licences.THRESHOLD}),
expression AS (SELECT doc_id, regexp_replace(regexp_replace(unnest(regexp_extract_all(text, '{licences.SPDX}', 1)), '(?i)\\bWITH +\\S+', '', 'g'), '[()]', ' ', 'g') AS e FROM file),
tag AS (SELECT doc_id, regexp_replace(unnest(list_distinct(list_concat([regexp_extract(e, '^\\s*(\\S+)', 1)], regexp_extract_all(e, '(?i)\\b(?:AND|OR)\\s+(\\S+)', 1)))), '(?i)(?:-only|-or-later|\\+)$|[.\\-]+$', '') AS licence FROM expression),
named AS (SELECT doc_id, coalesce(list_filter([{SPDX_NAMES}], lambda n: lower(n) = lower(licence))[1], licence) AS licence FROM tag WHERE regexp_matches(licence, '^[A-Za-z0-9]') AND upper(licence) NOT IN ('NONE', 'NOASSERTION') AND NOT starts_with(upper(licence), 'LICENSEREF')),
found AS (SELECT doc_id, CASE WHEN licence = 'Proprietary' THEN 3 ELSE 2 END AS place, licence, similarity, CASE WHEN whole THEN words ELSE 0 END AS whole, CASE WHEN part THEN words ELSE 0 END AS parts, 0 AS body FROM (SELECT *, len(regexp_split_to_array(line, '\\s+')) AS words FROM piece JOIN best USING (line))
    UNION ALL SELECT doc_id, 1, licence, similarity, 0, 0, CASE WHEN is_body THEN words ELSE 0 END FROM bbest UNION ALL SELECT doc_id, 0, licence, 1.0, 0, 0, 0 FROM named),
own AS (SELECT doc_id, arg_min(licence, (place, -similarity, licence)) AS own_licence, arg_min(similarity, (place, -similarity, licence)) AS similarity, greatest(sum(whole), sum(parts)) AS words, sum(body) AS body FROM found GROUP BY doc_id),
f AS (SELECT doc_id, directory, own_licence, similarity, coalesce(words > 0 AND words >= n * CAST({licences.FILE_SHARE} AS DOUBLE) OR body > 0 AND body >= n * CAST({licences.BODY_SHARE} AS DOUBLE), FALSE) AS is_file FROM (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM file LEFT JOIN own USING (doc_id))),
given AS (SELECT directory AS ancestor, arg_min(own_licence, (-similarity, own_licence)) AS given FROM f WHERE is_file GROUP BY 1),
near AS (SELECT directory, arg_max(ancestor, length(ancestor)) AS from_directory, arg_max(given, length(ancestor)) AS given FROM (SELECT DISTINCT directory FROM f WHERE own_licence IS NULL) JOIN given ON directory = ancestor OR starts_with(directory, ancestor || '/') GROUP BY 1)
SELECT doc_id, f.directory || '/' || doc_id || '.txt' AS path, own_licence, similarity, coalesce(own_licence, given) AS licence,
CASE WHEN own_licence IS NOT NULL AND is_file THEN 'file' WHEN own_licence IS NOT NULL THEN 'header' WHEN given IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis, CASE WHEN own_licence IS NULL THEN from_directory END AS from_directory
FROM f LEFT JOIN near ON f.directory = near.directory"""

REVISITS = """
WITH url AS (SELECT page_id, html, md5(coalesce(html, '')) AS tag, regexp_replace(url, '#.*$', '') AS bare, lower(regexp_extract(regexp_replace(url, '#.*$', ''), '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)', 1)) AS head FROM pages),
part AS (SELECT *, regexp_extract(substr(bare, length(head) + 1), '^([^?]*)', 1) AS path, regexp_extract(substr(bare, length(head) + 1), '^[^?]*\\?(.*)$', 1) AS query FROM url),
page AS (SELECT page_id, html, tag, regexp_replace(regexp_replace(regexp_replace(head, '^(?:(http://.*):80|(https://.*):443)$', '\\1\\2'), '^http://', 'https://'), '^https://www\\.', 'https://') || regexp_replace(path, '/+$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canonical_url
    FROM (SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_[^=&]*|ref|fbclid|gclid|sessionid)=[^&]*$'))), '&') AS kept FROM part)),
response AS (SELECT page_id * 4 AS response_id, canonical_url, page_id * 60 AS response_ts, tag, strlen(coalesce(html, '')) AS size FROM page),
revisit AS (SELECT page_id * 4 + v AS record_id, v, canonical_url, page_id * 60 + v * 18000 AS ts, CASE WHEN (page_id + v) % 5 = 0 THEN 'other' ELSE tag END AS tag, CASE WHEN (page_id + v) % 5 = 0 THEN '"other"' ELSE 'W/"' || tag || '"' END AS etag FROM page, (SELECT unnest(range(1, 4)) AS v)),
found AS (SELECT r.*, s.response_id, s.response_ts, s.tag AS old, s.size FROM revisit r ASOF LEFT JOIN response s ON r.canonical_url = s.canonical_url AND r.ts >= s.response_ts)
SELECT record_id, canonical_url, ts, response_id, response_ts, CASE WHEN response_id IS NULL THEN 'unresolved' WHEN tag = old THEN 'match' ELSE 'mismatch' END AS status, CASE WHEN tag = old THEN 6 ELSE 0 END AS n_headers,
CASE WHEN tag = old THEN md5('age: ' || (v * 7) || chr(10) || 'cache-control: max-age=' || (v * 600) || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || etag || chr(10) || 'server: origin') END AS headers_md5 FROM found"""

URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def url_sql(steps: int = 90) -> str:
    """The rules, and the two walks step by step; after 90 steps the ranks of the given tables no longer change in the digits shown."""
    fits = lambda r: f"(host = '{r.split('/')[0]}' OR ends_with(host, '.{r.split('/')[0]}')) AND starts_with(path, '{r[r.index('/') :]}')"
    rules = sorted(URL_RULES, key=lambda r: (-len(r), r))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for r in rules) + " END"
    given = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{URL_RULES[r]}'" for r in rules) + " END"
    host = lambda url: f"translate(coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}')"
    walk = [f"r{k} AS (SELECT kind, host, sum(rank) AS rank FROM (SELECT kind, \"to\" AS host, rank * share * {url_graph.DAMPING}::DOUBLE AS rank FROM r{k - 1} JOIN step USING (kind, host) UNION ALL SELECT kind, host, (1 - {url_graph.DAMPING}::DOUBLE) * seed FROM seed) GROUP BY ALL)" for k in range(1, steps + 1)]
    href, margin = url_graph.HREF.replace("'", "''"), 1 + url_graph.MARGIN
    return f"""
WITH page AS MATERIALIZED (SELECT page_id, url, html, {host("url")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT page_id, host, path, {rule} AS rule, {given} AS given FROM page),
known AS (SELECT host, given, count(*) AS n FROM ruled WHERE rule IS NOT NULL AND host <> '' GROUP BY ALL),
seed AS MATERIALIZED (SELECT CASE WHEN given = 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, n / CAST(sum(n) OVER (PARTITION BY given) AS DOUBLE) AS seed FROM known),
href AS (SELECT src, CASE WHEN regexp_matches(x, '(?i)^(?:https?:)?//') THEN {host("'x:' || regexp_replace(x, '(?i)^https?:', '')")} WHEN starts_with(x, '/') THEN regexp_extract(x, '^([^?#]*)', 1) END AS dst FROM (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{href}', 1)) AS x FROM page)),
link AS MATERIALIZED (SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM href WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
hosts AS MATERIALIZED (SELECT greatest(1, count(*)) AS n FROM (SELECT host FROM page WHERE host <> '' UNION SELECT dst FROM link WHERE NOT starts_with(dst, '/'))),
shared AS (SELECT src, dst, n, ln((SELECT n FROM hosts) / CAST(n AS DOUBLE)) AS rare FROM (SELECT *, count(*) OVER (PARTITION BY dst) AS n FROM link WHERE starts_with(dst, '/')) WHERE n > 1 AND n < (SELECT n FROM hosts)),
both_ways AS (SELECT src, dst, {url_graph.PATH_WEIGHT}::DOUBLE * rare / sum(rare) OVER (PARTITION BY src) AS w FROM shared UNION ALL SELECT dst, src, 1.0::DOUBLE / n FROM shared),
weighed AS (SELECT 'trust' AS kind, src AS host, dst AS "to", w FROM link WHERE NOT starts_with(dst, '/') UNION ALL SELECT 'distrust', dst, src, w FROM link WHERE NOT starts_with(dst, '/') UNION ALL SELECT unnest(['trust', 'distrust']), src, dst, w FROM both_ways),
step AS MATERIALIZED (SELECT kind, host, "to", w / greatest(1, sum(w) OVER (PARTITION BY kind, host)) AS share FROM weighed),
r0 AS (SELECT kind, host, seed AS rank FROM seed), {", ".join(walk)},
mark AS (SELECT host, coalesce(sum(rank) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(rank) FILTER (kind = 'distrust'), 0) AS distrust FROM (SELECT kind, host, rank / sum(rank) OVER (PARTITION BY kind) * (SELECT n FROM hosts) AS rank FROM r{steps} WHERE NOT starts_with(host, '/')) GROUP BY host)
SELECT page_id, host, path, rule, coalesce(given, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) * {margin}::DOUBLE AND coalesce(distrust, 0) > {url_graph.EVEN_SHARES * margin}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, round(coalesce(trust, 0), 4) AS trust, round(coalesce(distrust, 0), 4) AS distrust
FROM ruled LEFT JOIN mark USING (host)"""


SHARDS = 24
#: CRC-32 by its table, from a step for each bit; then the map of slots, slot by slot in the order of rebalance().
SHARDING = f"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(range(9), lambda v, k: CASE WHEN k = 0 THEN v WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, n) AS v FROM (SELECT unnest(range(256)) AS n))),
bytes AS (SELECT doc_id, strlen(coalesce(text, '')) + {sharding.RECORD_BYTES} AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents),
summed AS (SELECT doc_id, CAST(size AS BIGINT) AS size, xor(4294967295, list_reduce(b, lambda v, x: xor(v >> 8, t[CAST(xor(v, x) & 255 AS INTEGER) + 1]), 4294967295)) AS text_crc32 FROM bytes, crc),
record AS (SELECT doc_id, size, text_crc32, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || size || CASE WHEN copy > 0 THEN '/' || copy ELSE '' END), 1, 8) AS BIGINT) % {sharding.SLOTS} AS INTEGER) AS virtual_slot
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1 AS copy FROM summed)),
size AS (SELECT CAST(s AS INTEGER) AS virtual_slot, CAST(s % {SHARDS} AS INTEGER) AS shard, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM (SELECT unnest(range({sharding.SLOTS})) AS s) LEFT JOIN record ON s = virtual_slot GROUP BY s),
held AS (SELECT *, sum(bytes) OVER (PARTITION BY shard ORDER BY bytes DESC, virtual_slot ROWS UNBOUNDED PRECEDING) <= CAST(sum(bytes) OVER () AS DOUBLE) / {SHARDS} AS kept FROM size),
queue AS (SELECT *, row_number() OVER (ORDER BY kept DESC, bytes DESC, virtual_slot) AS nth FROM held),
placed AS (SELECT CAST(0 AS BIGINT) AS nth, list_transform(range({SHARDS}), lambda x: CAST(0 AS BIGINT)) AS loads, CAST(NULL AS INTEGER) AS goes UNION ALL
    SELECT nth, list_transform(loads, lambda x, i: CASE WHEN i = goes + 1 THEN x + bytes ELSE x END), goes FROM (SELECT q.nth, q.bytes, p.loads, CASE WHEN q.kept THEN q.shard ELSE CAST(list_position(p.loads, list_min(p.loads)) - 1 AS INTEGER) END AS goes FROM placed p JOIN queue q ON q.nth = p.nth + 1))
SELECT doc_id, record.size, text_crc32, 'bytes' AS law, goes AS shard, row_number() OVER (PARTITION BY goes ORDER BY virtual_slot, doc_id, record.size, text_crc32) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard, virtual_slot
FROM record JOIN queue USING (virtual_slot) JOIN placed USING (nth)"""

ORACLE_SQL: dict[str, str] = {"op2_url_graph": url_sql(), "op3_packing": packing_sql(), "op4_decontamination": DECONTAMINATION, "op7_licences": LICENCES, "op8_sharding": SHARDING, "op9_warc_revisits": REVISITS, "op10_neardup": NEARDUP, "op11_turn_repair": TURN_REPAIR, "op12_periodic_runs": PERIODIC_RUNS, "op13_trie_join": TRIE_JOIN}
