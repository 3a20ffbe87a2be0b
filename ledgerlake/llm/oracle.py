"""DuckDB twins of the corpus queries that SQL expresses."""

from __future__ import annotations

import string

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

# fixed values: control strings of chat formats, as in chat_template
_CONTROL = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\")


def _escaped_length(col: str) -> str:
    """Code points of an escaped text: one more for every control string and backslash."""
    more = " + ".join(f"(length({col}) - length(replace({col}, '{c}', ''))) // {len(c)}" for c in _CONTROL)
    return f"length({col}) + {more}"


CHAT = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({_escaped_length('role')} + {_escaped_length('text')} + length('<|start|><|message|><|end|>') + 1) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

LEAKS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
  i AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM benchmark),
  starts AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0),
  win AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM starts),
  pos AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
  hit AS (SELECT a.doc_id, a.p, a.k, win.item_id FROM (SELECT doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM pos) a
          JOIN win ON win.k = a.k AND win.s = a.s),
  words AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
  items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
  starts AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS p FROM d WHERE len(w) > 0),
  sh AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS s FROM starts),
  size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
  both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  link AS (SELECT x, y FROM both_ JOIN size a ON a.doc_id = x JOIN size b ON b.doc_id = y
           WHERE 100 * both_.n >= 85 * (a.n + b.n - both_.n)),
  reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y),
  comp AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM comp LEFT JOIN size USING (doc_id)"""


def _nibble_step(i: int) -> int:
    for _ in range(4):
        i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
    return i


_STEPS = "[" + ", ".join(f"{_nibble_step(i)}::BIGINT" for i in range(16)) + "]"


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, half a byte at a time (the lower half first)."""
    digits = f"hex(encode({text}))"
    nibbles = f"list_transform(range(len({digits})), lambda k: CAST(instr('0123456789ABCDEF', substr({digits}, k + 2 - 2 * (k % 2), 1)) - 1 AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {nibbles}), lambda a, x: xor(a >> 4, {_STEPS}[(xor(a, x) & 15) + 1])), 4294967295::BIGINT)"


RESAMPLE = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
  g AS (SELECT regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM benchmark),
  feat AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS f FROM w),
  goal AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS f FROM g),
  names AS (SELECT f, {_crc32('f')} % 10000 AS b FROM (SELECT f FROM feat UNION SELECT f FROM goal)),
  c AS (SELECT b, count(*) AS s FROM feat JOIN names USING (f) GROUP BY b),
  t AS (SELECT b, count(*) AS t FROM goal JOIN names USING (f) GROUP BY b),
  n AS (SELECT (SELECT count(*) FROM feat) AS s_all, (SELECT count(*) FROM goal) AS t_all),
  gain AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000)))) AS BIGINT) AS x
           FROM (SELECT b FROM c UNION SELECT b FROM t) LEFT JOIN c USING (b) LEFT JOIN t USING (b), n),
  m AS (SELECT doc_id, count(*) AS n_features, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS weight FROM feat JOIN names USING (f) JOIN gain USING (b) GROUP BY doc_id),
  d AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
          ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT::DOUBLE AS h FROM w LEFT JOIN m USING (doc_id)),
  sc AS (SELECT *, weight + CAST(floor(-1000.0 * ln(-ln((h + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM d),
  r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank
FROM sc LEFT JOIN r USING (doc_id)"""

# states of a repair: 0 nothing written, 1 a system, 2 a user, 3 an assistant turn written last
_MOVES = "(VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)) AS mv(initial, p, p2)"
_NAME = "CASE mv.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END"
_X = "struct_pack(cost := {cost}, audit := {audit}, repaired := {repaired})"


def _inserted(items: str) -> str:
    """Items with up to two more turns inserted."""
    x = _X.format(cost="x.cost + 5", audit="x.audit || 'I'", repaired=f"x.repaired || {_NAME} || chr(10)")
    more = lambda of: f"SELECT conv_id, i, mv.p2 AS q, {x} AS x FROM ({of}) JOIN {_MOVES} ON mv.p = q AND mv.initial <> 's'"
    base = f"SELECT conv_id, i, q, x FROM {items}"
    return f"({base} UNION ALL {more(base)} UNION ALL {more(more(base))})"


#: of equal cost the least audit; an audit determines what is repaired. Repaired turns end in a newline inside
REPAIR = f"""
WITH RECURSIVE base AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      {_crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS k FROM conversations),
  hurt AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
      CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM base WHERE k <> 0),
  seq AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
      lag(substr(role, 1, 1)) OVER w AS before, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
    FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
  r AS (SELECT conv_id, turn, i, role, text, substr(role, 1, 1) AS initial,
      before IS NOT NULL AND before || substr(role, 1, 1) NOT IN ('su', 'ua', 'au') AS wrong,
      CASE WHEN bare = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM seq),
  seen AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
      count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
      count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE wrong) AS illegal FROM r GROUP BY conv_id),
  dp AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, {_X.format(cost="0", audit="''", repaired="''")} AS x FROM seen
    UNION ALL
    SELECT conv_id, i, q, min(x) AS x FROM (
      SELECT h.conv_id, r.i, h.q, {_X.format(cost="x.cost + 2", audit="x.audit || 'D'", repaired="x.repaired")} AS x
        FROM {_inserted('dp')} h JOIN r ON r.conv_id IS NOT DISTINCT FROM h.conv_id AND r.i = h.i + 1
      UNION ALL
      SELECT h.conv_id, r.i, mv.p2, {_X.format(
          cost="x.cost + CASE WHEN mv.initial = r.initial THEN 0 ELSE 1 END + CASE WHEN fault = 3 THEN 5 ELSE 0 END",
          audit="x.audit || CASE WHEN mv.initial = r.initial THEN 'K' ELSE 'R' END",
          repaired=f"x.repaired || CASE WHEN mv.initial = r.initial THEN role || ':' ELSE {_NAME} END || text || chr(10)")}
        FROM {_inserted('dp')} h JOIN r ON r.conv_id IS NOT DISTINCT FROM h.conv_id AND r.i = h.i + 1
        JOIN {_MOVES} ON mv.p = h.q AND (mv.initial = r.initial OR mv.initial <> 's') WHERE fault IN (0, 3)
    ) GROUP BY conv_id, i, q),
  best AS (SELECT h.conv_id, min(x) AS x FROM {_inserted('dp')} h JOIN seen ON seen.conv_id IS NOT DISTINCT FROM h.conv_id AND h.i = n
    WHERE q IN (0, 3) GROUP BY h.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(x.cost, 0) AS BIGINT) AS cost, coalesce(x.audit, '') AS audit,
  sha256(coalesce(CASE WHEN x.repaired = '' THEN '' ELSE left(x.repaired, length(x.repaired) - 1) END, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN seen ON seen.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id"""

SQL = {
    "op3_chat_format": CHAT, "op6_decontamination": LEAKS, "op10_near_duplicates": NEAR,
    "op11_conversation_repair": REPAIR, "op12_importance_resampling": RESAMPLE,
}
