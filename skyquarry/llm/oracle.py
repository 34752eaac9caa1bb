"""SQL for DuckDB that says the same as those operators that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

DECONTAMINATION = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
windows AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0) t),
mine AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) k WHERE len(w) >= n) t),
hit AS MATERIALIZED (SELECT doc_id, i, n, item_id FROM mine JOIN windows USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) t GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) t GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, least(len(w), 4) AS n, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM d WHERE len(w) > 0) t),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM met JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * common >= 80 * (p.n + q.n - common)),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id"""


_RENDER = "array_to_string([concat('<|', t.role, '|>', chr(10), t.text, '<|end|>', chr(10)) for t in {0}], '')"
_MASK = "array_to_string([concat(CAST(p.at AS VARCHAR), ':', CAST(p.at + length(p.text) AS VARCHAR)) for p in {0} if p.role = 'assistant'], ',')"
#: Where the text of each turn of a rendered list begins.
_PLACES = "[{{'role': t.role, 'text': t.text, 'at': CAST(coalesce(list_sum([length(u.role) + length(u.text) + 13 for u, j in {0} if j < i]), 0) + length(t.role) + 5 AS BIGINT)}} for t, i in {0}]"

CHAT = f"""
WITH t AS (SELECT DISTINCT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS MATERIALIZED (SELECT conv_id, list({{'turn': turn, 'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, md5(text), text) AS turns FROM t GROUP BY conv_id),
o AS MATERIALIZED (SELECT *, [concat(md5(t.text), t.role) for t in turns] AS digests, CAST(coalesce(list_sum([len(regexp_extract_all(t.text, '[^\x20\x09-\x0D]+')) for t in turns if t.role = 'assistant']), 0) AS BIGINT) AS spoken,
    list_max([i for t, i in turns if t.role = 'assistant']) AS last FROM c),
p AS (SELECT *, digests[1] AS first, row_number() OVER (PARTITION BY digests[1] ORDER BY digests, conv_id) - 1 AS place FROM o WHERE conv_id IS NOT NULL),
met AS MATERIALIZED (SELECT CASE WHEN b.spoken > a.spoken THEN b.conv_id ELSE a.conv_id END AS chosen_id, CASE WHEN b.spoken > a.spoken THEN a.conv_id ELSE b.conv_id END AS rejected_id,
    CASE WHEN b.spoken > a.spoken THEN b.turns ELSE a.turns END AS chosen, CASE WHEN b.spoken > a.spoken THEN a.turns ELSE b.turns END AS rejected, FALSE AS made
    FROM p a JOIN p b ON a.first = b.first AND b.place = a.place + 1 WHERE a.place % 2 = 0),
replies AS (SELECT text, row_number() OVER (ORDER BY words, md5(text)) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT turns[last].text AS text, len(regexp_extract_all(turns[last].text, '[^\x20\x09-\x0D]+')) AS words FROM o WHERE last IS NOT NULL) r),
others AS (SELECT a.text, b.text AS other FROM replies a JOIN replies b ON b.place = a.place % a.n + 1 WHERE a.text <> b.text),
lone AS (SELECT o.conv_id, turns, last, other FROM o LEFT JOIN others ON text = turns[last].text WHERE NOT EXISTS (SELECT 1 FROM met WHERE o.conv_id IN (chosen_id, rejected_id))),
pairs AS (SELECT * FROM met UNION ALL SELECT conv_id, NULL, turns, CASE WHEN other IS NOT NULL THEN list_append(turns[1:last - 1], {{'turn': turns[last].turn, 'role': 'assistant', 'text': other}}) END, other IS NOT NULL FROM lone),
cut AS (SELECT *, CASE WHEN rejected IS NULL THEN len(chosen) - 1 ELSE least(coalesce(list_min([i - 1 for t, i in chosen if i > len(rejected) OR t.role <> rejected[i].role OR t.text <> rejected[i].text]), len(chosen)), least(len(chosen), len(rejected)) - 1) END AS n FROM pairs),
parts AS (SELECT chosen_id, rejected_id, made, n, chosen[1:n] AS prompt, chosen[n + 1:] AS chosen, rejected[n + 1:] AS rejected FROM cut),
spread AS (SELECT *, {_PLACES.format("chosen")} AS chosen_at, {_PLACES.format("rejected")} AS rejected_at FROM parts)
SELECT chosen_id, rejected_id, CAST(n AS BIGINT) AS prompt_turns, {_RENDER.format("prompt")} AS prompt, {_RENDER.format("chosen")} AS chosen, {_MASK.format("chosen_at")} AS chosen_mask,
    CASE WHEN rejected IS NOT NULL THEN {_RENDER.format("rejected")} END AS rejected, CASE WHEN rejected IS NOT NULL THEN {_MASK.format("rejected_at")} END AS rejected_mask,
    coalesce([t.text for t in chosen if t.role = 'assistant'] <> [t.text for t in rejected if t.role = 'assistant'], FALSE) AS usable, made FROM spread"""


# Operator 2. Patterns as the contract has them, without look-behind; an IBAN's match begins with the character before it.
_PII = (
    ("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", 0.9, "", ""),
    ("ip", "[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)", 0.7, "", ""),
    ("card", "[0-9](?:[\\x20-]?[0-9])+", 0.8, "", ""),
    ("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", 0.6, "", ""),
    ("iban", "(?:^|[^A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]){11,30}", 0.7, "iban|account|konto|bank", "example|dummy"),
    ("national_id", "[0-9-]{11,}", 0.3, "ssn|social|security|national id|tax id", "order|part|serial"),
    ("secret", "[A-Za-z0-9_+/=-]{20,}", 0.3, "token|secret|key|apikey|api_key|password|passwd|bearer|credential", "checksum|commit|digest"),
)
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum([CASE WHEN j % 2 = 1 THEN CAST(c AS INT) WHEN c > '4' THEN 2 * CAST(c AS INT) - 9 ELSE 2 * CAST(c AS INT) END for c, j in string_split(reverse({_DIGITS}), '')]) % 10 = 0"
_MOVED = "concat(substr(replace(m, ' ', ''), 5), left(replace(m, ' ', ''), 4))"
_MOD97 = f"list_reduce(list_prepend(0, [CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END for c in string_split({_MOVED}, '')]), lambda a, v: CASE WHEN v >= 10 THEN (a * 100 + v) % 97 ELSE (a * 10 + v) % 97 END) = 1"
_SPREAD = "list_sum([len(list_filter(string_split(m, ''), lambda x: x = c)) ** 2 for c in list_distinct(string_split(m, ''))]) * 6 <= length(m) ** 2"


def _near(words: str) -> str:
    return f"regexp_matches(translate(near, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:^|[^a-z0-9])(?:{words})(?:[^a-z0-9]|$)')"


def _matches(at: int, pattern: str) -> str:
    return f"SELECT r, {at} AS kind, unnest(regexp_extract_all(text, '{pattern}')) AS m, unnest(list_slice(string_split_regex(text, '{pattern}'), 1, len(regexp_extract_all(text, '{pattern}')))) AS piece, generate_subscripts(regexp_extract_all(text, '{pattern}'), 1) AS i FROM d"


_SCORE = " ".join(f"WHEN {i} THEN {score}" + (f" + CASE WHEN {_near(up)} THEN 0.3 ELSE 0 END" if up else "") + (f" - CASE WHEN {_near(down)} THEN 0.3 ELSE 0 END" if down else "") for i, (_, _, score, up, down) in enumerate(_PII))
_NAMES = "[" + ", ".join(f"'{k[0]}'" for k in _PII) + "]"

PII = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(_matches(i, k[1]) for i, k in enumerate(_PII))}),
placed AS (SELECT r, kind, m, piece, sum(length(piece) + length(m)) OVER (PARTITION BY r, kind ORDER BY i) - length(m) AS start, kind = 4 AND NOT regexp_matches(m, '^[A-Z]') AS led FROM found),
cut AS (SELECT r, kind, CASE WHEN led THEN substr(m, 2) ELSE m END AS m, right(CASE WHEN led THEN concat(piece, left(m, 1)) ELSE piece END, 40) AS near, start + led::INT AS start FROM placed),
good AS MATERIALIZED (SELECT r, kind, start, start + length(m) AS stop FROM cut WHERE CASE kind
    WHEN 1 THEN list_bool_and([length(ltrim(p, '0')) < 4 AND CAST(concat('0', right(p, 3)) AS INT) <= 255 for p in string_split(m, '.')])
    WHEN 2 THEN length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN} WHEN 3 THEN length({_DIGITS}) BETWEEN 9 AND 15 WHEN 4 THEN {_MOD97} WHEN 5 THEN regexp_matches(m, '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$')
    WHEN 6 THEN regexp_matches(m, '[0-9].*[0-9]') AND regexp_matches(m, '[A-Za-z].*[A-Za-z]') AND {_SPREAD} ELSE TRUE END
    AND CAST(CASE kind {_SCORE} END AS DOUBLE) >= 0.499999),
said AS (SELECT *, concat({_NAMES}[kind + 1], ':', CAST(start AS BIGINT), ':', CAST(stop AS BIGINT)) AS s FROM good),
told AS (SELECT r, {", ".join(f"count(*) FILTER (kind = {i}) AS n_{k[0]}" for i, k in enumerate(_PII))}, coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 4), '') AS base, string_agg(s, ',' ORDER BY start, kind) AS spans, count(*) AS n_spans FROM said GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k[0]}, 0) AS n_{k[0]}" for k in _PII)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans FROM d LEFT JOIN told USING (r)"""


# Operator 4. A schedule's time by which a share of its integral has passed: rising or falling lines solved by hand.
_FALLS = "0.0 + CASE WHEN share <= 0 THEN 0.0 ELSE share * 2 / (sqrt(greatest(2.25 + share * -2.0, 0.0)) + 1.5) END"
_LEVEL = "0.0 + CASE WHEN share <= 0 THEN 0.0 ELSE share * 2 / (sqrt(greatest(1.0 + share * 0.0, 0.0)) + 1.0) END"
_RISES = "CASE WHEN share >= 0.375 THEN 0.5 + CASE WHEN share - 0.375 <= 0 THEN 0.0 ELSE (share - 0.375) * 2 / (sqrt(greatest(1.0 + (share - 0.375) * 2.0, 0.0)) + 1.0) END ELSE 0.0 + CASE WHEN share <= 0 THEN 0.0 ELSE share * 2 / (sqrt(greatest(0.25 + share * 2.0, 0.0)) + 0.5) END END"

MIXING = f"""
WITH d AS MATERIALIZED (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][rank % 3 + 1] AS weight, source_size * 3 AS cap FROM s),
l AS (SELECT *, (SELECT CAST(sum(source_size) AS DOUBLE) FROM s) AS total, CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS capped,
    CAST(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS weights FROM w),
level AS (SELECT (total - capped) / weights AS level FROM l WHERE (total - capped) / weights * weight <= cap ORDER BY cap / weight, rank LIMIT 1),
t AS (SELECT source, source_size, rank, least(CAST(cap AS DOUBLE), coalesce((SELECT level FROM level) * weight, 0.0)) AS target FROM w),
laid AS (SELECT doc_id, size, source_size, rank, target, CAST(round(target) AS BIGINT) AS wanted, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS BIGINT) AS start
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
shared AS (SELECT *, least(start / greatest(wanted, 1), 1.0) AS share FROM laid)
SELECT doc_id, size, source_size, target, greatest(least(wanted - start, size), 0) + greatest(least(wanted - start - source_size, size), 0) + greatest(least(wanted - start - 2 * source_size, size), 0) AS taken,
    CASE WHEN least(wanted - start, size) > 0 THEN least(CASE rank % 3 WHEN 0 THEN {_FALLS} WHEN 1 THEN {_LEVEL} ELSE {_RISES} END, 1.0) END AS first_position FROM shared"""

# Operator 9: every 50-byte string of every text, the least id that has it, and the bytes that a smaller one covers.
REPEATS = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT r, doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100),
windows AS MATERIALIZED (SELECT r, doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) AS w FROM starts),
firsts AS (SELECT w, min(doc_id) AS least, max(doc_id) AS most FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT r, i FROM windows JOIN firsts USING (w) WHERE doc_id > least),
runs AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hit) t),
spans AS (SELECT r, run, min(i) AS start, max(i) + 50 AS stop FROM runs GROUP BY r, run),
kept AS (SELECT r, sum(stop - start) AS n_removed, count(*) AS n_spans, list([start, stop] ORDER BY start) AS spans FROM spans GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(CASE WHEN spans IS NULL THEN h ELSE concat(array_to_string([substr(h, 2 * CASE WHEN j = 1 THEN 0 ELSE spans[j - 1][2] END + 1, 2 * (s[1] - CASE WHEN j = 1 THEN 0 ELSE spans[j - 1][2] END)) for s, j in spans], ''), substr(h, 2 * spans[len(spans)][2] + 1)) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""
