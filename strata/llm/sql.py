"""DuckDB SQL for the operators that SQL can express: repair and trie of conversations, and similarity joins of documents."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a text of ASCII characters: byte by byte, eight shifts each."""
    shifts = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {shifts}), 4294967295)"


#: Damage, faults, then a shortest path over rows by (cost, audit): each state of a row is reached after none, one or two
#: inserts by deleting, keeping or re-roling it.
OP11_SQL = f"""WITH RECURSIVE named AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
drawn AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("name")} % 20 AS lot FROM named),
once AS (SELECT conv_id, turn, CASE lot WHEN 4 THEN 'user' ELSE role END AS role, CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, lot FROM drawn WHERE lot <> 0),
hurt AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE lot = 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS copy, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN copy > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM seen),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM judged GROUP BY conv_id),
ins AS (SELECT * FROM (VALUES (0, 0, '', 0, ''), (0, 2, 'I', 5, 'user:' || chr(10)), (0, 3, 'II', 10, 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 1, '', 0, ''), (1, 2, 'I', 5, 'user:' || chr(10)), (1, 3, 'II', 10, 'user:' || chr(10) || 'assistant:' || chr(10)),
  (2, 2, '', 0, ''), (2, 3, 'I', 5, 'assistant:' || chr(10)), (2, 2, 'II', 10, 'assistant:' || chr(10) || 'user:' || chr(10)), (3, 3, '', 0, ''), (3, 2, 'I', 5, 'user:' || chr(10)), (3, 3, 'II', 10, 'user:' || chr(10) || 'assistant:' || chr(10))) t(s, s1, letters, more, texts)),
edits AS (SELECT unnest(['D', 'K', 'R']) AS letter),
way AS (SELECT conv_id, 0::BIGINT AS i, 0 AS s, {{'cost': 0, 'audit': '', 'kept': ''}} AS best FROM counts
  UNION ALL SELECT conv_id, i, s2, min({{'cost': cost, 'audit': audit, 'kept': kept}}) FROM (
    SELECT w.conv_id, j.i, CASE letter WHEN 'D' THEN s1 WHEN 'K' THEN CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE s1 WHEN 2 THEN 3 ELSE 2 END END AS s2,
      best.cost + more + CASE letter WHEN 'D' THEN 2 WHEN 'K' THEN 0 ELSE 1 END + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END AS cost, best.audit || letters || letter AS audit,
      best.kept || texts || CASE letter WHEN 'D' THEN '' WHEN 'K' THEN role || ':' || text || chr(10) ELSE CASE s1 WHEN 2 THEN 'assistant' ELSE 'user' END || ':' || text || chr(10) END AS kept
    FROM way w JOIN judged j ON w.conv_id IS NOT DISTINCT FROM j.conv_id AND j.i = w.i + 1 JOIN ins ON ins.s = w.s, edits
    WHERE letter = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (letter = 'R' OR (initial = 's' AND s1 = 0) OR (initial = 'u' AND s1 <> 2) OR (initial = 'a' AND s1 = 2)))) GROUP BY conv_id, i, s2),
ended AS (SELECT w.conv_id, min({{'cost': best.cost + more, 'audit': best.audit || letters, 'kept': best.kept || texts}}) AS best FROM way w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN ins ON ins.s = w.s WHERE s1 IN (0, 3) GROUP BY w.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit,
  sha256(coalesce(left(best.kept, length(best.kept) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""

#: Prefixes are named by the digests of their turns in a row; a node's ancestors are the prefixes of its first member.
OP12_SQL = f"""WITH base AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, CAST(c AS VARCHAR) AS name, count(*) AS own FROM base GROUP BY c), lent AS (SELECT c, own, {_crc32("name")} % 9 AS h, c - c % 5 AS b FROM ids),
plan AS (SELECT p.c, p.h, p.b, least(p.h, coalesce(q.own, 0)) AS m, least(p.h, coalesce(q.own, 0)) + greatest(p.own - p.h, 0) AS total FROM lent p LEFT JOIN lent q ON q.c = p.b),
turns AS (SELECT c, m + place - h + 1 AS d, role, text, total FROM base JOIN plan USING (c) WHERE place >= h UNION ALL SELECT plan.c, place + 1, role, text, total FROM base JOIN plan ON base.c = plan.b WHERE place < h),
path AS (SELECT c, d, total, strlen(text) AS bytes, string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS name FROM turns UNION ALL SELECT c, 0, total, 0, '' FROM plan),
nodes AS (SELECT name, d, min(c) AS conv, count(*) AS n, any_value(bytes) AS bytes, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = total) AS ends FROM path GROUP BY name, d),
kids AS (SELECT left(name, CAST(32 * (d - 1) AS BIGINT)) AS name, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY 1),
stats AS (SELECT nodes.*, coalesce(kids, 0) AS kids FROM nodes LEFT JOIN kids USING (name)),
sums AS (SELECT a.name, count(*) FILTER (kids = 0) AS leaves, sum((n - 1) * stats.bytes)::BIGINT AS saved FROM stats JOIN path a ON a.c = stats.conv AND a.d <= stats.d GROUP BY a.name)
SELECT s.conv AS conv_id, s.d AS depth, p.conv AS parent_conv_id, s.n AS n_convs, s.kids AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(coalesce(s.ends, '')) AS ends_sha256
FROM stats s JOIN sums USING (name) LEFT JOIN nodes p ON s.d > 0 AND p.name = left(s.name, CAST(32 * (s.d - 1) AS BIGINT))"""


def _components(width: int, percent: int, more: str = "") -> str:
    """Sets of shingles, links between different sets, and the least document that links lead to; equal sets are one class."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {width} THEN [array_to_string(words, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(words) - {width - 2}), lambda i: array_to_string(words[i : i + {width - 1}], ' ')))) END AS shingles FROM w),
named AS (SELECT doc_id, len(shingles) AS n, md5(array_to_string(shingles, chr(10))) AS class, shingles FROM sets), classes AS (SELECT class, min(doc_id) AS least, any_value(n) AS n, any_value(shingles) AS shingles FROM named WHERE n > 0 GROUP BY class),
each AS (SELECT class, n, unnest(shingles) AS x FROM classes), pairs AS (SELECT a.class AS u, b.class AS v FROM each a JOIN each b ON a.x = b.x AND a.class < b.class AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
links AS (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs), reach AS (SELECT class AS u, class AS v FROM classes UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
label AS (SELECT r.u AS class, min(c.least) AS component_id FROM reach r JOIN classes c ON c.class = r.v GROUP BY r.u)
SELECT doc_id, n AS n_shingles, coalesce(component_id, doc_id) AS component_id{more} FROM named LEFT JOIN label ON n > 0 AND named.class = label.class"""


OP5_SQL = _components(5, 75)
OP13_SQL = _components(4, 80, ", coalesce(component_id, doc_id) = doc_id AS kept")
