"""DuckDB SQL for the contract queries that SQL can express, each by a plain definition and not by the operator's method."""

from __future__ import annotations

from docspark.llm.chat import CLOSE, CONTROL, OPEN

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in "|[]/<>" and c in "|[]" else c for c in s)


_REST = "|".join(_quoted(x[1:]) for x in CONTROL)
_ESCAPED = "regexp_replace({0}, '([<\\[])(\\\\*(?:" + _REST + "))', '\\1\\\\\\2', 'g')"
_SAID = "'</s>[INST] ok [/INST]'"

OP1 = f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', {_SAID}), (-1, 1, 'assistant', {_SAID}))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(OPEN) + len(CLOSE) + 1} + length({_ESCAPED.format("replace(replace(role, chr(92), chr(92) || 'b'), chr(10), chr(92) || 'n')")}) + length({_ESCAPED.format('text')})) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id"""

# The published generator modulo 2**64, and the usual reflected CRC-32 half a byte at a time.
_JUMP = "list_reduce(range(0, 64), lambda s, i: CASE WHEN s.j >= {n} THEN s ELSE {{'k': (s.k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT, 'b': s.j, 'j': CAST(floor((s.j + 1) * (2147483648::DOUBLE / CAST((((s.k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT) // 8589934592::HUGEINT) + 1 AS DOUBLE))) AS BIGINT)}} END, {{'k': CAST(doc_id AS HUGEINT), 'b': CAST(-1 AS BIGINT), 'j': CAST(0 AS BIGINT)}}).b"

OP5 = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array({_LOW}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS g FROM w),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
links AS (SELECT a.r AS u, b.r AS v FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r JOIN n x ON x.r = a.r JOIN n y ON y.r = b.r AND 10 * x.n >= 8 * y.n AND 10 * y.n >= 8 * x.n GROUP BY a.r, b.r, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT r AS u, r AS v FROM w UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u),
least AS (SELECT reach.u AS r, min(w.doc_id) AS component_id FROM reach JOIN w ON w.r = reach.v GROUP BY reach.u)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM w JOIN least USING (r) LEFT JOIN n USING (r)"""

OP9 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT r, i, hash(substr(h, 2 * i + 1, 400)) AS g FROM (SELECT r, h, unnest(range(greatest(len(h) // 2 - 199, 0))) AS i FROM d)),
again AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
hit AS (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 1 ELSE 0 END AS new FROM win WHERE g IN (SELECT g FROM again)),
run AS (SELECT r, k, min(i) AS a, max(i) + 200 AS b FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM hit) GROUP BY r, k),
gap AS (SELECT r, a, substr(h, 2 * coalesce(lag(b) OVER w, 0) + 1, 2 * (a - coalesce(lag(b) OVER w, 0))) AS kept, b - a AS n FROM run JOIN d USING (r) WINDOW w AS (PARTITION BY r ORDER BY a)),
all_of AS (SELECT r, string_agg(kept, '' ORDER BY a) AS kept, sum(n) AS n, count(*) AS spans FROM gap GROUP BY r),
last AS (SELECT r, max(b) AS b FROM run GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(b, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN all_of USING (r) LEFT JOIN last USING (r)"""

_TABLE = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
_NIBBLE = f"xor(c >> 4, list_extract({_TABLE}, CAST((xor(c, x) & 15) AS INTEGER) + 1)::BIGINT)"
OP4 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, {_JUMP.format(n=24)} AS shard, {_JUMP.format(n=25)} AS grown FROM documents),
h AS (SELECT DISTINCT t, list_transform(string_split(hex(encode(t)), ''), lambda c: CAST(strpos('0123456789ABCDEF', c) - 1 AS BIGINT)) AS x FROM d WHERE t <> ''),
crc AS (SELECT t, xor(list_reduce(flatten(list_transform(range(1, len(x), 2), lambda i: [x[i + 1], x[i]])), lambda c, x: {_NIBBLE}, 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM h)
SELECT doc_id, size, coalesce(crc, 0) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, crc) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard FROM d LEFT JOIN crc USING (t)"""

_TERMS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
sizes AS (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
stats AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words FROM sizes),
b AS (SELECT row_number() OVER () AS q, item_id, list_distinct({_TERMS}) AS t FROM benchmark),
asked AS (SELECT q, item_id, unnest(t) AS term FROM b),
post AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM post, stats GROUP BY term, n_docs),
scored AS (
  SELECT q, item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_words)))) AS BIGINT) AS score
  FROM post JOIN w USING (term) JOIN asked USING (term) JOIN sizes USING (r), stats GROUP BY q, item_id, r, doc_id),
best AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM best WHERE rank <= 10"""

_NEAREST = "{a} AS MATERIALIZED (SELECT r, p, any_value(v.x) AS x, min({{'d': list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'k': k}}) AS m FROM v JOIN {c} c USING (p) GROUP BY r, p)"
_MEANS = """{new} AS MATERIALIZED (
  SELECT p, c.k, coalesce(g.x, c.x) AS x FROM {c} c LEFT JOIN (
    SELECT p, k, list(y ORDER BY i) AS x FROM (SELECT p, m.k AS k, i, CAST(floor(sum(x[i]) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS y FROM (SELECT p, m, x, unnest(range(1, len(x) + 1)) AS i FROM {a}) GROUP BY p, m.k, i) GROUP BY p, k) g USING (p, k))"""
_ROUNDS = ",\n".join(f"{_NEAREST.format(a=f'a{j}', c=f'c{j}')},\n{_MEANS.format(new=f'c{j + 1}', c=f'c{j}', a=f'a{j}')}" for j in range(4))
OP12 = f"""
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT r, vec_id, p, q[p * len(q) // 4 + 1:(p + 1) * len(q) // 4] AS x FROM e, (SELECT unnest(range(4)) AS p)),
c0 AS (SELECT p, k, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k FROM v) WHERE k < 256),
{_ROUNDS},
{_NEAREST.format(a="a4", c="c4")},
found AS (SELECT r, string_agg(lower(lpad(to_hex(m.k), 2, '0')), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a4 GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM found JOIN e USING (r), books"""

OP13 = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
fit AS (SELECT r, x FROM e WHERE len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
links AS (SELECT a.r AS u, b.r AS v FROM fit a JOIN fit b ON a.r <> b.r WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
reach AS (SELECT r AS u, r AS v FROM e UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u),
least AS (SELECT u AS r, min(vec_id) AS component_id FROM reach JOIN e ON e.r = reach.v GROUP BY u),
n AS (SELECT u AS r, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM e JOIN least USING (r) LEFT JOIN n USING (r)"""
