"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .licenses import PHRASES

LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Words of letters and digits, and words between white space, of a column.
ALNUM = "regexp_extract_all(" + LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SOLID = "regexp_extract_all(" + LOW + r", '[^\x20\x09-\x0D]+')"


def crc32(numbers: str) -> str:
    """Of a list of byte values, bit by bit."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {numbers}), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"


def of_text(c: str) -> str:
    """Byte values of an ASCII text."""
    return f"list_transform(range(1, length({c}) + 1), lambda i: ord(substr({c}, i, 1))::BIGINT)"


HELD = f"coalesce({crc32(of_text('doc_id::VARCHAR'))} % {{}} = 1, false)"

DECONTAMINATION = f"""WITH d AS (SELECT doc_id, coalesce({ALNUM.format("text")}, []) AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS k FROM (SELECT item_id, coalesce({ALNUM.format("text")}, []) AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
spots AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM b)),
hit AS (SELECT doc_id, i, spots.k, item_id FROM spots JOIN windows ON spots.k = windows.k AND array_to_string(spots.w[i : i + spots.k - 1], ' ') = win),
places AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(places.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(places.n, 0) > 0 AND 20 * coalesce(places.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places ON d.doc_id = places.doc_id LEFT JOIN items ON d.doc_id = items.doc_id"""

CHAT = """WITH x AS (SELECT *, row_number() OVER () AS rowid_ FROM conversations),
c AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce("text", '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce("text", ''))) AS l FROM x GROUP BY conv_id, CASE WHEN conv_id IS NULL THEN rowid_ END),
one AS (SELECT l, min(conv_id) AS conv_id, count(*) AS n_same FROM c GROUP BY 1)
SELECT conv_id, len(l)::BIGINT AS n_turns, n_same, array_to_string(list_transform(l, lambda x: '<|im_start|>' || x.r || chr(10) || x.t || '<|im_end|>'), chr(10)) AS rendered
FROM one WHERE NOT EXISTS (SELECT 1 FROM one o WHERE o.l[1] = one.l[1] AND len(o.l) > len(one.l) AND o.l[1 : len(one.l)] = one.l)"""

_PLACES = " UNION ALL ".join(
    f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) - {len(p.split()) - 2})) AS i FROM d) WHERE {' AND '.join(f'w[i + {k}] = {chr(39)}{word}{chr(39)}' for k, word in enumerate(p.split()))}"
    for p, label in PHRASES.items()
)
LICENCE_BASE = f"""WITH d AS (SELECT doc_id, coalesce({ALNUM.format("text")}, []) AS w FROM documents), places AS ({_PLACES})
SELECT d.doc_id, any_value(len(w))::BIGINT AS n_words, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels FROM d LEFT JOIN places ON d.doc_id = places.doc_id GROUP BY d.doc_id"""

_LE32 = "printf('%02x%02x%02x%02x', ({0}) & 255, (({0}) >> 8) & 255, (({0}) >> 16) & 255, (({0}) >> 24) & 255)"
MEDIA_PAYLOAD = f"""WITH p AS (SELECT doc_id, strlen(coalesce("text", ''))::BIGINT AS n, lower(hex(encode(coalesce("text", '')))) AS h FROM documents),
q AS (SELECT doc_id, n, greatest(64, (n + 63) // 64 * 64) AS m, h || repeat('00', greatest(64, (n + 63) // 64 * 64) - n) AS h FROM p),
r AS (SELECT *, substr(h, length(h) - 127) AS tail, '52494646' || {_LE32.format("36 + m")} || '57415645666d742010000000' || '01000100401f0000401f000001000800' || '64617461' || {_LE32.format("m")} AS head FROM q)
SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(unhex(h)) AS payload_sha256, {crc32("list_transform(range(64), lambda i: ((instr('0123456789abcdef', substr(tail, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789abcdef', substr(tail, 2 * i + 2, 1)) - 1)::BIGINT)")} AS tail_crc32, m + 44 AS media_bytes, sha256(unhex(head || h)) AS media_sha256 FROM r"""

MIXING_TARGETS = f"""WITH d AS (SELECT doc_id, source, coalesce(len({SOLID.format("text")}), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY 1),
o AS (SELECT *, 3.0 * source_size / weight AS full_at, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM s),
r AS (SELECT *, coalesce(sum(source_size) OVER w, 0) AS before_size, coalesce(sum(weight) OVER w, 0) AS before_weight FROM o WINDOW w AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT first((total - 3 * before_size) / (weights - before_weight) ORDER BY full_at, source NULLS LAST) FILTER (full_at >= (total - 3 * before_size) / (weights - before_weight)) AS rate FROM r)
SELECT doc_id, d.source, size, source_size, round(least(3.0 * source_size, weight * rate), 3) AS target FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, level"""

NEAR_DUPLICATES = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce({SOLID.format("text")}, []) AS w FROM documents),
s AS (SELECT doc_id, CASE len(w) WHEN 0 THEN [] WHEN 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS l FROM d),
one AS (SELECT list_sort(l) AS l, min(doc_id) AS doc_id, len(l) AS n FROM s WHERE len(l) > 0 GROUP BY list_sort(l), len(l)),
x AS (SELECT doc_id, n, unnest(l) AS g FROM one),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM one UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least_of AS (SELECT a, min(b) AS c FROM reach GROUP BY 1)
SELECT s.doc_id, len(s.l)::BIGINT AS n_shingles, coalesce(c, s.doc_id) AS component_id, coalesce(c, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN one ON list_sort(s.l) = one.l LEFT JOIN least_of ON one.doc_id = a"""

SCORING_BASE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {HELD.format(5)} AS held_out, list_append(coalesce({SOLID.format("text")}, []), chr(10)) AS w FROM documents),
x AS (SELECT r, held_out, unnest(w) AS g FROM d),
c AS (SELECT g, count(*) AS c FROM x WHERE NOT held_out GROUP BY 1),
t AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c),
per AS (SELECT r, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))) AS base FROM x LEFT JOIN c USING (g), t GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(base, 4) AS base_score FROM d JOIN per USING (r), t"""

LANGUAGE_SPLIT = f"""SELECT doc_id, {HELD.format(3)} AS held_out, coalesce(NOT regexp_matches("text", '\\p{{L}}'), true) AS no_letter FROM documents"""

SHARD_LAWS = """SELECT 8 AS n_shards, count(*) AS n_rows, sum(strlen(coalesce("text", '')) + 1)::BIGINT AS total_size, true AS near_equal, true AS gapless, true AS together FROM documents"""
