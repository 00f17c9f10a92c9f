"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from riskloom.llm import fill_in_middle, sharding
from riskloom.llm.line_dedup import FIXED_SHARE, FIXED_WORDS, LEADING, MIN_DOCS, MIN_WORDS, OWN_LINES, OWN_SURROUNDINGS

_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all(coalesce({_FOLD}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT item, least(13, len(w)) AS width, unnest(range(0, greatest(1, len(w) - 12))) AS s, w FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, width, list_aggregate(w[s + 1:s + width], 'string_agg', ' ') AS gram FROM iw),
widths AS (SELECT DISTINCT width FROM windows),
dw AS (SELECT doc_id, width, unnest(range(0, len(w) - width + 1)) AS s, w FROM d, widths WHERE len(w) >= width),
grams AS (SELECT doc_id, width, s, list_aggregate(w[s + 1:s + width], 'string_agg', ' ') AS gram FROM dw),
met AS (SELECT doc_id, g.width, s, item FROM grams g JOIN windows x ON g.gram = x.gram AND g.width = x.width),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + width)) AS p FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM met GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_SHARD_ROWS = ", ".join(f"({i}, '{s}')" for i, s in enumerate(sharding.SHARDS))
_M, _N = sharding.TABLE_SIZE, len(sharding.SHARDS)

OP2 = f"""
WITH RECURSIVE shards(shard_no, shard) AS (VALUES {_SHARD_ROWS}),
orders AS (
  SELECT list(CAST('0x' || substr(md5(shard), 1, 8) AS BIGINT) % {_M} ORDER BY shard_no) AS first_slot,
    list(CAST('0x' || substr(md5(shard), 9, 8) AS BIGINT) % {_M - 1} + 1 ORDER BY shard_no) AS step
  FROM shards
),
turns(turn, slot, taken) AS (
  SELECT -1, -1::BIGINT, [false FOR x IN range({_M})]
  UNION ALL
  SELECT turn + 1, pick, list_transform(taken, lambda t, i: t OR i = pick + 1)
  FROM (
    SELECT turn, taken, list_filter(
      list_transform(range({_M}), lambda j: (first_slot[(turn + 1) % {_N} + 1] + j * step[(turn + 1) % {_N} + 1]) % {_M}),
      lambda c: NOT taken[c + 1])[1] AS pick
    FROM turns, orders WHERE turn < {_M - 1}
  )
),
placed AS (SELECT slot, shard FROM turns JOIN shards ON turn % {_N} = shard_no WHERE turn >= 0)
SELECT doc_id, slot, shard FROM (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {_M} AS slot FROM documents
) JOIN placed USING (slot)
"""

_MASKED = r"list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END)"

OP10 = f"""
WITH texts AS (
  SELECT DISTINCT md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || text) AS doc, md5(text) AS copy, list_distinct(string_split(text, chr(10))) AS lines
  FROM documents WHERE text IS NOT NULL
),
line_rows AS (SELECT doc, copy, unnest(lines) AS line FROM texts),
common AS (SELECT line, true AS recurs FROM line_rows GROUP BY line HAVING count(DISTINCT copy) >= {MIN_DOCS}),
own AS (
  SELECT doc, min(substr(md5(line), 1, 15)) FILTER (recurs IS NULL) AS low, max(substr(md5(line), 1, 15)) FILTER (recurs IS NULL) AS high
  FROM line_rows LEFT JOIN common USING (line) GROUP BY doc HAVING count(*) FILTER (recurs IS NULL) >= {OWN_LINES} * count(*)
),
tree AS (
  SELECT doc, copy, line, w, len(w) AS n, w[1:{LEADING}] AS lead, len(list_filter(w, lambda x: x != '<*>')) AS plain
  FROM (SELECT doc, copy, line, {_MASKED} AS w FROM line_rows) WHERE len(w) >= {MIN_WORDS}
),
different AS (SELECT line, any_value(w) AS w, any_value(n) AS n, any_value(lead) AS lead, any_value(plain) AS plain, count(*) AS docs FROM tree GROUP BY line),
placed AS (SELECT line, n, lead, plain, docs, unnest(range(n)) AS pos, unnest(w) AS word FROM different),
fixed AS (SELECT n, lead, pos, word FROM placed WHERE word != '<*>' GROUP BY n, lead, pos, word HAVING sum(docs) >= {MIN_DOCS}),
template AS (
  SELECT line, CAST((n, lead, list((pos, word) ORDER BY pos)) AS VARCHAR) AS template FROM placed JOIN fixed USING (n, lead, pos, word)
  GROUP BY line, n, lead, plain HAVING count(*) >= {FIXED_SHARE} * plain AND count(*) >= {FIXED_WORDS}
  UNION ALL SELECT line, line FROM different WHERE plain < {FIXED_WORDS} AND docs >= {MIN_DOCS}
),
held AS (
  SELECT template, copy, CASE WHEN low != substr(md5(line), 1, 15) THEN low WHEN high != substr(md5(line), 1, 15) THEN high END AS around
  FROM template JOIN tree USING (line) JOIN own USING (doc)
),
recurring AS (
  SELECT template FROM held WHERE around IS NOT NULL GROUP BY template
  HAVING count(DISTINCT copy) >= {MIN_DOCS} AND count(DISTINCT around) >= {MIN_DOCS} AND count(DISTINCT around) >= {OWN_SURROUNDINGS} * count(DISTINCT copy)
),
bad AS (SELECT list(line) AS bad FROM template JOIN recurring USING (template))
SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(bad, []), x)), chr(10)) END AS text,
  CASE WHEN text IS NULL THEN 0 ELSE len(list_filter(string_split(text, chr(10)), lambda x: list_contains(coalesce(bad, []), x))) END AS n_dropped
FROM documents, bad
"""


def _draw(at: int) -> str:
    return f"CAST('0x' || substr(h, {8 * at + 1}, 8) AS BIGINT)"


OP12 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('{fill_in_middle.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
),
drawn AS (
  SELECT *, len(u) AS n, least({_draw(0)} % (len(u) + 1), {_draw(1)} % (len(u) + 1)) AS low, greatest({_draw(0)} % (len(u) + 1), {_draw(1)} % (len(u) + 1)) AS high,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_draw(2)} % 100 >= {fill_in_middle.FIM_PERCENT} THEN 'plain'
      WHEN {_draw(3)} % 100 < {fill_in_middle.SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM d
),
parts AS (
  SELECT *, array_to_string(u[1:low], '') AS prefix, array_to_string(u[low + 1:high], '') AS middle, array_to_string(u[high + 1:], '') AS suffix FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form != 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(prefix || middle || suffix) AS restored_sha256
FROM parts
"""

ORACLE = {"op1_decontamination": OP1, "op2_sharding": OP2, "op10_line_dedup": OP10, "op12_fill_in_middle": OP12}
