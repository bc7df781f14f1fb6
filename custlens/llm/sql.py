"""DuckDB SQL for the operators that SQL can express, by plainer ways than theirs."""

from __future__ import annotations

#: The unsigned crc32 of a text's UTF-8 bytes.  Its table is made from the polynomial.
_CRC = """
crc_bits(b, k, v) AS (
  SELECT b, 0, b FROM range(256) r(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY b) AS t FROM crc_bits WHERE k = 8)"""


def _crc32(text: str) -> str:
    """An expression; ``t`` of crc_table must be in scope."""
    raw = f"hex(encode({text}))"
    bytes_ = f"list_transform(range(length({raw}) // 2), lambda i: CAST('0x' || substr({raw}, 2 * i + 1, 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce({bytes_}, lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), CAST(4294967295 AS BIGINT)))"


def _moves() -> str:
    """(kind, before, after, cost, letters) of every edit of a row with the insertions
    before it, on the automaton of (s?(ua)+)?: 0 nothing, 1 s, 2 u, 3 ua."""
    to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    rows = []
    for before in range(4):
        reach, todo = {before: 0}, [before]
        for old in todo:
            for x in "ua":
                new = to.get((old, x))
                if new is not None and new not in reach:
                    reach[new] = reach[old] + 1
                    todo.append(new)
        for mid, k in reach.items():
            for kind in range(9):
                own, cut = "?sua"[max(kind - 1, 0) // 2], 3 * ((kind + 1) % 2)
                rows.append((kind, before, mid, 3 * k + 4, "I" * k + "D"))
                if kind:
                    rows += [(kind, before, to[mid, x], 3 * k + c + cut, "I" * k + e) for x, c, e in ((own, 0, "K"), ("u", 3, "R"), ("a", 3, "R")) if (mid, x) in to]
            rows.append((-1, before, mid, 3 * k, "I" * k))
    return ", ".join(f"({kind}, {before}, {after}, {cost}, '{letters}')" for kind, before, after, cost, letters in rows)


_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP11 = f"""
WITH RECURSIVE {_CRC},
moves(kind, before, after, cost, letters) AS (VALUES {_moves()}),
coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS code
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN code = 1 THEN '' WHEN code = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM coded)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, rtrim(text, {_SPACE}) AS ended
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || ':' || text)) AS pos FROM damaged)),
judged AS (
  SELECT *, CASE WHEN ended = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS two
  FROM placed),
kinds AS (
  SELECT conv_id, pos, role, text, CASE WHEN fault IN ('blank', 'duplicate') THEN 0
         ELSE 1 + 2 * CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END + CAST(fault = 'truncated' AS INT) END AS kind
  FROM judged),
ways AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit FROM conversations
  UNION ALL
  SELECT conv_id, pos, state, best.cost, best.audit FROM (
    SELECT w.conv_id, w.pos + 1 AS pos, m.after AS state, min({{'cost': CAST(w.cost + m.cost AS BIGINT), 'audit': w.audit || m.letters}}) AS best
    FROM ways w JOIN kinds k ON k.conv_id IS NOT DISTINCT FROM w.conv_id AND k.pos = w.pos + 1 JOIN moves m ON m.kind = k.kind AND m.before = w.state
    GROUP BY w.conv_id, w.pos, m.after)),
ends AS (
  SELECT conv_id, best.cost, best.audit FROM (
    SELECT w.conv_id, min({{'cost': w.cost + m.cost, 'audit': w.audit || m.letters}}) AS best
    FROM ways w JOIN moves m ON m.kind = -1 AND m.before = w.state AND m.after IN (0, 3)
    WHERE w.pos = (SELECT count(*) FROM kinds k WHERE k.conv_id IS NOT DISTINCT FROM w.conv_id) GROUP BY w.conv_id)),
letters AS (
  SELECT conv_id, audit, i, substr(audit, i, 1) AS letter, length(replace(audit, 'D', '')) % 2 AS odd FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS i FROM ends)),
lines AS (
  SELECT *, sum(CAST(letter <> 'I' AS INT)) OVER (PARTITION BY conv_id ORDER BY i) AS pos, sum(CAST(letter <> 'D' AS INT)) OVER (PARTITION BY conv_id ORDER BY i) - 1 - odd AS place FROM letters),
texts AS (
  SELECT l.conv_id, string_agg((CASE WHEN letter = 'K' THEN k.role WHEN place % 2 = 0 THEN 'user' ELSE 'assistant' END) || ':' || (CASE WHEN letter = 'I' THEN '' ELSE k.text END), chr(10) ORDER BY i) AS whole
  FROM lines l LEFT JOIN kinds k ON k.conv_id IS NOT DISTINCT FROM l.conv_id AND k.pos = l.pos WHERE letter <> 'D' GROUP BY l.conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id)
SELECT e.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
       coalesce(c.illegal, 0) AS illegal, e.cost, e.audit, sha256(coalesce(x.whole, '')) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN texts x ON x.conv_id IS NOT DISTINCT FROM e.conv_id
"""

#: Words with a letter cut out meet by hash join; the counted letters stand between \x01s.
OP13 = f"""
WITH RECURSIVE {_CRC},
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), ' ') AS id, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  GROUP BY ALL),
hashed AS (SELECT run, n, {_crc32("id || ':' || run")} AS h FROM runs, crc_table),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.head || a.tail = b.word
  UNION
  SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.head || a.tail = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS form_n, arg_min(other, {{'n': -n, 'w': other}}) AS form FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 10 * w.n THEN b.form END AS form, CASE WHEN b.form_n >= 10 * w.n THEN b.form_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
chains AS (
  SELECT word, word AS last FROM forms
  UNION ALL
  SELECT c.word, f.form FROM chains c JOIN forms f ON f.word = c.last WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.last AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chains c USING (word) JOIN forms e ON e.word = c.last AND e.form IS NULL
"""
