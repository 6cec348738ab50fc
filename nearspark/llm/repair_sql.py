"""DuckDB oracle of the conversation repair: one recursion step per row, brute force over edits."""

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_CRC = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
  list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda v, k: xor(v >> 1, 3988292384::BIGINT * (v & 1)))))"""

REPAIR_SQL = f"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations),
c AS (SELECT *, {_CRC} % 20 AS k FROM o),
d AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE k <> 0)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         rtrim(text, {_SPACE}) AS shown, left(role, 1) AS initial
  FROM d),
f AS (
  SELECT *, CASE WHEN shown = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM r),
stat AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id),
follows(q, initial, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
asked(q, role, q2) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
chain(q, q2, ins, cost, lines) AS (
  SELECT q, q, '', 0, ''::VARCHAR FROM asked
  UNION ALL SELECT q, q2, 'I', 3, chr(10) || role || ':' FROM asked
  UNION ALL SELECT a.q, b.q2, 'II', 6, chr(10) || a.role || ':' || chr(10) || b.role || ':'
            FROM asked a JOIN asked b ON a.q2 = b.q),
edit AS (
  SELECT conv_id, i, q, q AS q2, 'D' AS letter, 4 AS cost, '' AS line FROM f, (SELECT DISTINCT q FROM asked)
  UNION ALL
  SELECT conv_id, i, q, q2, 'K', CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END,
         chr(10) || f.role || ':' || text
  FROM f JOIN follows USING (initial) WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT conv_id, i, q, q2, 'R', CASE WHEN fault = 'truncated' THEN 6 ELSE 3 END,
         chr(10) || asked.role || ':' || text
  FROM f, asked WHERE fault NOT IN ('blank', 'duplicate')),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, {{'cost': 0, 'audit': ''::VARCHAR, 'out': ''::VARCHAR}} AS best FROM stat
  UNION ALL
  SELECT w.conv_id, w.i + 1, e.q2, min({{'cost': w.best.cost + h.cost + e.cost,
                                        'audit': w.best.audit || h.ins || e.letter,
                                        'out': w.best.out || h.lines || e.line}})
  FROM walk w JOIN chain h ON w.q = h.q
  JOIN edit e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.q = h.q2
  GROUP BY w.conv_id, w.i, e.q2),
done AS (
  SELECT w.conv_id, min({{'cost': w.best.cost + h.cost, 'audit': w.best.audit || h.ins,
                         'out': w.best.out || h.lines}}) AS best
  FROM walk w JOIN stat s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.i
  JOIN chain h ON w.q = h.q WHERE h.q2 IN (0, 3) GROUP BY w.conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(best.out[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN stat s ON s.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM a.conv_id"""
