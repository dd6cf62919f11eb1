"""Oracle SQL of the catalog, matching and labelling queries.

Slots are captured by one anchored regex a slot, matching walks the prefix tree
in a recursion over token paths, and similarity searches compare all pairs: the
statements share no plan with the Spark side.
"""

from __future__ import annotations

from ..operators.labelling import INSTRUCTION
from ..sources.fixtures import branches_sql, examples_sql
from . import duck as d
from .oracles import DICT, LOGS, SEP, TEXTS, first_fit


def _repaired(src: str, msg: str, resp: str) -> str:
    """CTE ``rep(system, seq, msg, resp)`` over ``src``."""
    return f"""r0 AS (SELECT system, seq, {msg} AS msg, {resp} AS resp FROM {src}),
r1 AS (SELECT system, seq, msg, {d.words(d.rule_chain("CASE WHEN contains(resp, msg) THEN msg ELSE resp END"))} AS ws FROM r0),
r2 AS (SELECT system, seq, msg, {d.rule_tokens('ws')} AS lab FROM r1),
r3 AS (SELECT system, seq, msg, lab, {d.words('lab')} AS t, {d.words('msg')}[1] AS first FROM r2),
rep AS (SELECT system, seq, msg, CASE WHEN len(t) > 0 AND len(list_filter(t, lambda x_: NOT regexp_matches(x_, '\\{{.*\\}}'))) = 0
  AND first IS NOT NULL AND NOT regexp_matches(first, '\\p{{Nd}}')
  THEN array_to_string(list_prepend(first, t[2:]), ' ') ELSE lab END AS resp FROM r3)"""


REPAIRED = f"b AS ({branches_sql()}), {_repaired('b', d.correct_message('Content'), 'Labelled')}"


def _captures(src: str) -> str:
    """E1 as one anchored regex a slot: CTE ``caps(system, seq, k, label, value, start)`` of ``src(system, seq, msg, resp)``."""
    any_ = "'[\\s\\S]*'"
    esc = "lambda x_: regexp_escape(x_)"
    return f"""c0 AS (SELECT system, seq, msg, regexp_extract_all(resp, '\\{{(.*?)\\}}', 1) AS labels,
  list_transform(regexp_split_to_array(resp, '\\{{.*?\\}}'), {esc}) AS lits FROM {src}),
c1 AS (SELECT * FROM c0 WHERE len(labels) BETWEEN 1 AND 30
       AND regexp_matches(msg, '^' || array_to_string(lits, {any_}))),
c2 AS (SELECT system, seq, msg, k, labels[k] AS label, '^(' || array_to_string(lits[:k], {any_}) || ')([\\s\\S]*)'
  || array_to_string(lits[k + 1:], {any_}) AS pat FROM c1, generate_series(1, 30) g(k) WHERE k <= len(labels)),
caps AS (SELECT system, seq, msg, CAST(k - 1 AS BIGINT) AS k, label, regexp_extract(msg, pat, 2) AS value,
  CAST(length(regexp_extract(msg, pat, 1)) AS BIGINT) AS start FROM c2)"""


def _corrected() -> str:
    """CTEs ``slots`` (first value of each label, with ``err``) and ``fixed(system, seq, corrected, labels)``."""
    return f"""{_captures('rep')},
firsts AS (SELECT system, seq, label, min(k) AS k, arg_min(value, k) AS value FROM caps GROUP BY system, seq, label),
vals AS (SELECT DISTINCT value, {d.remove_punctuation('value')} AS s FROM firsts),
common AS (SELECT value FROM vals WHERE NOT (s = upper(s) AND s <> lower(s)) AND (lower(s) IN (SELECT word FROM dict)
  OR (ends_with(lower(s), 'ed') AND left(lower(s), length(s) - 2) IN (SELECT word FROM dict)))),
slots AS (SELECT *, lower(label) = lower(value) OR lower(label) = 'label' OR {d.remove_punctuation('label')} = ''
  OR {d.remove_punctuation('value')} = '' OR len({d.words('value')}) >= 9
  OR value IN (SELECT value FROM common) AS err FROM firsts),
per AS (SELECT system, seq, list({{'l': label, 'v': value}} ORDER BY k) FILTER (WHERE err) AS bad,
  list(label ORDER BY k) FILTER (WHERE NOT err) AS good FROM slots GROUP BY system, seq),
fixed AS (SELECT rep.system, rep.seq, coalesce(good, []) AS good, CASE WHEN per.seq IS NULL THEN msg
  ELSE list_reduce(list_prepend({{'l': '', 'v': resp}}, coalesce(bad, [])),
    lambda a_, x_: {{'l': '', 'v': replace(a_.v, '{{' || x_.l || '}}', x_.v)}}).v END AS corrected
  FROM rep LEFT JOIN per ON rep.system = per.system AND rep.seq = per.seq)"""


def _slots() -> dict[str, str]:
    o: dict[str, str] = {}
    raw = f"b AS ({branches_sql()}), raw AS (SELECT system, seq, {d.correct_message('Content')} AS msg, Labelled AS resp FROM b)"
    o["slot_capture"] = f"""WITH {raw}, {_captures('raw')},
w AS (SELECT system, seq, {d.words('msg')} AS ws FROM raw),
tk AS (SELECT system, seq, i - 1 AS i, list_sum(list_transform(ws[:i - 1], lambda x_: length(x_) + 1)) AS ts, length(ws[i]) AS n
  FROM w, LATERAL (SELECT unnest(generate_series(1, len(ws))) AS i)),
spans AS (SELECT system, seq, i, coalesce(ts, 0) AS ts, coalesce(ts, 0) + n AS te FROM tk),
hit AS (SELECT DISTINCT c.system, c.seq, l.label, spans.i FROM caps c JOIN spans ON c.system = spans.system AND c.seq = spans.seq
  AND c.start <= spans.te AND c.start + length(c.value) >= spans.ts
  JOIN caps l ON l.system = c.system AND l.seq = c.seq AND l.value = c.value),
pos AS (SELECT system, seq, label, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS positions FROM hit GROUP BY system, seq, label)
SELECT caps.system, caps.seq, caps.k, caps.label, caps.value, caps.start, pos.positions FROM caps
LEFT JOIN pos ON caps.system = pos.system AND caps.seq = pos.seq AND caps.label = pos.label"""
    o["slot_correction"] = f"""WITH {LOGS}, {DICT}, {REPAIRED}, {_corrected()},
f1 AS (SELECT *, {d.words(d.rule_chain('corrected'))} AS ws FROM fixed),
f2 AS (SELECT *, {d.rule_tokens('ws')} AS ruled FROM f1)
SELECT system, seq, corrected AS labelled, {d.canonical_template('ruled')} AS template,
  array_to_string(good, ',') AS labels FROM f2"""
    chars = d.characters("value")
    o["variable_units"] = f"""WITH {LOGS}, {DICT}, {REPAIRED}, {_corrected()},
units AS (SELECT c.system, c.seq, c.label, c.value, row_number() OVER (PARTITION BY c.system, c.seq, c.label ORDER BY c.k) - 1 AS pos
  FROM caps c JOIN slots s ON c.system = s.system AND c.seq = s.seq AND c.label = s.label WHERE NOT s.err),
fst AS (SELECT system, label, min(seq) AS seq FROM units GROUP BY system, label),
cand AS (SELECT u.system, u.label, u.value, min({{'seq': u.seq, 'pos': u.pos}}) AS pl FROM units u
  JOIN fst ON u.system = fst.system AND u.label = fst.label WHERE u.seq <> fst.seq OR u.pos = 0 GROUP BY u.system, u.label, u.value),
sets AS (SELECT system, label, value, pl, list_sort(list_distinct({chars})) AS cs FROM cand),
one AS (SELECT system, label, arg_min(value, {{'pl': pl, 'value': value}}) AS value, min({{'pl': pl, 'value': value}}) AS o
  FROM sets GROUP BY system, label, cs),
seqs AS (SELECT system, label, list([value] ORDER BY o) AS vs FROM one GROUP BY system, label),
led AS (SELECT system, label, {first_fit("vs")} AS symbols FROM seqs),
n AS (SELECT system, label, count(DISTINCT lower(value)) AS n_values FROM units GROUP BY system, label)
SELECT n.system, n.label, n.n_values::BIGINT AS n_values, array_to_string(led.symbols, {SEP}) AS symbols
FROM n LEFT JOIN led ON n.system = led.system AND n.label = led.label"""
    return o


def _positions(src: str) -> str:
    """CTE ``pos(system, seq, label, i)`` of the captures ``caps`` of ``src(system, seq, msg)``."""
    return f"""w AS (SELECT system, seq, {d.words('msg')} AS ws FROM {src}),
tk0 AS (SELECT system, seq, i - 1 AS i, list_sum(list_transform(ws[:i - 1], lambda x_: length(x_) + 1)) AS ts, length(ws[i]) AS n
  FROM w, LATERAL (SELECT unnest(generate_series(1, len(ws))) AS i)),
spans AS (SELECT system, seq, i, coalesce(ts, 0) AS ts, coalesce(ts, 0) + n AS te FROM tk0),
pos AS (SELECT DISTINCT c.system, c.seq, l.label, spans.i FROM caps c JOIN spans ON c.system = spans.system AND c.seq = spans.seq
  AND c.start <= spans.te AND c.start + length(c.value) >= spans.ts
  JOIN caps l ON l.system = c.system AND l.seq = c.seq AND l.value = c.value)"""


# The catalog of the labelled examples, and the distinct masked keys of logs and texts.
CATALOG = f"""{DICT}, ex AS ({examples_sql()}), {_repaired('ex', 'Content', 'EventTemplate')}, {_corrected()}, {_positions('rep')},
f1 AS (SELECT *, {d.words(d.rule_chain('corrected'))} AS ws FROM fixed),
f2 AS (SELECT *, {d.rule_tokens('ws')} AS ruled FROM f1),
f3 AS (SELECT f2.system, f2.seq, corrected, {d.canonical_template('ruled')} AS template, rep.msg AS example
  FROM f2 JOIN rep ON f2.system = rep.system AND f2.seq = rep.seq),
f4 AS (SELECT system, template, min(seq) AS seq, arg_min(example, seq) AS example, arg_min(corrected, seq) AS labelled
  FROM f3 GROUP BY system, template),
cat AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY seq, template) - 1 AS template_id,
  {d.match_tokens('template')} AS tt FROM f4)"""
KEYS = f"""{TEXTS},
src AS (SELECT system, seq, {d.correct_message('Content')} AS c FROM
  (SELECT system, seq, Content FROM logs UNION ALL SELECT system, seq, Content FROM texts) a),
m1 AS (SELECT system, seq, c, string_split(trim({d.mask_chain('c')}), ' ') AS mk FROM src),
m2 AS (SELECT system, seq, c, trim(array_to_string({d.dedup_adjacent('mk')}, ' ')) AS masked FROM m1),
m3 AS (SELECT system, masked, min(seq) AS seq, arg_min(c, seq) AS msg FROM m2 GROUP BY system, masked),
keys AS (SELECT *, {d.tokens('msg')} AS tk FROM m3)"""
# The prefix tree, a node being its token path; all walks take a step in each recursion.
WALK = f"""RECURSIVE {LOGS}, {CATALOG}, {KEYS},
ix AS (SELECT system, template_id, tt FROM cat WHERE template <> '<*>'),
pf AS (SELECT system, template_id, k, array_to_string(tt[:k], {SEP}) AS node, tt[k + 1] AS tok, array_to_string(tt[:k + 1], {SEP}) AS child
  FROM ix, LATERAL (SELECT unnest(generate_series(0, len(tt))) AS k)),
ed AS (SELECT DISTINCT system, node, tok, child FROM pf WHERE tok IS NOT NULL),
em AS (SELECT system, node, list({{'tok': tok, 'child': child}}) AS es, max(child) FILTER (WHERE tok = '<*>') AS star FROM ed GROUP BY system, node),
term AS (SELECT system, array_to_string(tt, {SEP}) AS node, max(template_id) AS tid FROM ix GROUP BY system, array_to_string(tt, {SEP})),
info AS (SELECT p.system, p.node, coalesce(e.es, []) AS es, e.star, coalesce(se.es, []) AS ses, t.tid AS term, st.tid AS sterm,
    CASE WHEN p.node = '' THEN 2 ELSE 7 END AS reach
  FROM (SELECT DISTINCT system, node FROM pf) p LEFT JOIN em e ON p.system = e.system AND p.node = e.node
  LEFT JOIN em se ON p.system = se.system AND se.node = e.star LEFT JOIN term t ON p.system = t.system AND p.node = t.node
  LEFT JOIN term st ON p.system = st.system AND st.node = e.star),
walk AS (
  SELECT k.system, k.masked, k.tk, '' AS node, 0::BIGINT AS i, false AS done, NULL::BIGINT AS tid
  FROM keys k WHERE k.system IN (SELECT system FROM ix)
  UNION ALL
  SELECT system, masked, tk, CASE WHEN ended THEN node WHEN lit IS NOT NULL THEN lit WHEN hop IS NOT NULL THEN hop.child ELSE node END,
    CASE WHEN ended THEN i WHEN lit IS NOT NULL THEN i + 1 WHEN hop IS NOT NULL THEN i + hop.k + 1 ELSE i END,
    ended OR (lit IS NULL AND hop IS NULL),
    CASE WHEN ended THEN term WHEN lit IS NULL AND hop IS NULL AND star IS NOT NULL AND len(tk) - i < reach THEN sterm END
  FROM (SELECT w.*, n.term, n.sterm, n.star, n.reach, w.i >= len(w.tk) AS ended,
      list_filter(n.es, lambda e_: e_.tok = w.tk[w.i + 1])[1].child AS lit,
      list_filter(list_transform(range(0, least(n.reach, len(w.tk) - w.i)), lambda k_: {{'k': k_,
        'child': list_filter(n.ses, lambda e_: e_.tok = w.tk[w.i + k_ + 1])[1].child}}), lambda h_: h_.child IS NOT NULL)[1] AS hop
    FROM walk w JOIN info n ON w.system = n.system AND w.node = n.node WHERE NOT w.done) x),
res AS (SELECT k.system, k.masked, k.seq, k.msg, k.tk, coalesce(w.tid IS NOT NULL, false) AS ok, w.tid AS template_id, coalesce(w.node, '') AS node
  FROM keys k LEFT JOIN (SELECT * FROM walk WHERE done) w ON k.system = w.system AND k.masked = w.masked)"""
# Labels of each template that have positions, the kept ones only.
KEPT = """JOIN pos p ON c.system = p.system AND c.seq = p.seq
  JOIN fixed f ON f.system = c.system AND f.seq = c.seq AND list_contains(f.good, p.label)"""
REFS = f"""el AS (SELECT system, template_id, labelled, {d.words('example')} AS et FROM cat),
mw AS (SELECT system, masked, {d.words('msg')} AS mt FROM keys),
best AS (SELECT k.system, k.masked, arg_max(labelled, {{'s': {d.jaccard('k.mt', 'e.et')}, 't': -e.template_id}}) AS labelled
  FROM mw k JOIN el e ON k.system = e.system WHERE len(e.et) < 30 GROUP BY k.system, k.masked),
refs AS (SELECT mw.system, mw.masked, coalesce(best.labelled,
  'env.createBean2(): Factory error creating {{module}} ({{module}}, {{module}})') AS reference
  FROM mw LEFT JOIN best ON mw.system = best.system AND mw.masked = best.masked)"""
HINTS = f"""un AS (SELECT c.system, c.seq, c.label, c.value, row_number() OVER (PARTITION BY c.system, c.seq, c.label ORDER BY c.k) - 1 AS pos,
    min(c.k) OVER (PARTITION BY c.system, c.seq, c.label) AS k0
  FROM caps c JOIN slots s ON c.system = s.system AND c.seq = s.seq AND c.label = s.label WHERE NOT s.err),
fu AS (SELECT system, label, min({{'seq': seq, 'li': k0}}) AS use FROM un GROUP BY system, label),
sv AS (SELECT u.system, u.label, u.value, min({{'seq': u.seq, 'pos': u.pos, 'v': u.value}}) AS o FROM un u
  JOIN fu ON u.system = fu.system AND u.label = fu.label WHERE u.seq <> fu.use.seq OR u.pos = 0 GROUP BY u.system, u.label, u.value),
sl AS (SELECT system, label, {first_fit("list([value] ORDER BY o)")} AS symbols FROM sv GROUP BY system, label),
sy AS (SELECT sl.system, sl.label, fu.use, spos, symbols[spos] AS symbol FROM sl JOIN fu ON sl.system = fu.system AND sl.label = fu.label,
  LATERAL (SELECT unnest(generate_series(1, len(symbols))) AS spos)),
sc AS (SELECT *, {d.characters(d.star_digits('symbol'))} AS ch FROM sy WHERE symbol <> '' AND NOT starts_with(label, 'unknown')),
dl AS (SELECT coalesce(list(word), []) AS dl FROM dict),
ut AS (SELECT k.system, k.masked, t.i, tk[t.i] AS token FROM keys k, dl, LATERAL (SELECT unnest(generate_series(1, len(tk))) AS i) t
  WHERE NOT list_contains(dl, tk[t.i]) AND k.system IN (SELECT system FROM sc)),
pr AS (SELECT ut.*, sc.label, sc.symbol, sc.use, sc.spos, {d.jaccard(d.characters('ut.token'), 'sc.ch')} AS score
  FROM ut JOIN sc ON ut.system = sc.system),
bs AS (SELECT system, masked, i, arg_min({{'l': label, 's': symbol}}, {{'n': -score, 'u': use, 'l': label, 'p': spos}}) AS b
  FROM pr WHERE score >= 0.5 GROUP BY system, masked, i),
ls AS (SELECT system, masked, b.l AS label, arg_max(b.s, i) AS symbol, min(i) AS at_ FROM bs GROUP BY system, masked, b.l)"""


def _matching() -> dict[str, str]:
    o: dict[str, str] = {}
    o["catalog_seed"] = f"""WITH {LOGS}, {CATALOG} SELECT system, template_id, template, example, labelled,
  array_to_string(tt, {SEP}) AS tokens, false AS indexed FROM cat"""
    o["wildcard_match"] = f"WITH {WALK} SELECT system, masked, ok, template_id, node AS fail_node FROM res"
    a, b = d.star_digits("r.msg"), d.star_digits("c.example")
    o["similar_match"] = f"""WITH {WALK},
fid AS (SELECT system, node, min(template_id) AS f FROM pf GROUP BY system, node),
dfs AS (SELECT pf.system, pf.template_id, list(fid.f ORDER BY pf.k) AS dfs FROM pf JOIN fid ON pf.system = fid.system
  AND pf.node = fid.node WHERE pf.k > 0 GROUP BY pf.system, pf.template_id),
known AS (SELECT c.system, c.template_id, list(DISTINCT p.i) AS ps FROM cat c {KEPT}
  WHERE NOT starts_with(p.label, 'unknown') GROUP BY c.system, c.template_id),
cand AS (SELECT r.system, r.masked, c.template_id, dfs.dfs, c.tt,
    list_transform(r.tk, lambda x_, i_: CASE WHEN list_contains(coalesce(known.ps, []), i_ - 1) THEN '<*>' ELSE x_ END) AS mt
  FROM res r JOIN ix ON r.system = ix.system JOIN cat c ON c.system = ix.system AND c.template_id = ix.template_id
  JOIN dfs ON dfs.system = c.system AND dfs.template_id = c.template_id
  LEFT JOIN known ON known.system = c.system AND known.template_id = c.template_id
  WHERE NOT r.ok AND (r.node = '' OR r.node = array_to_string(c.tt[:len(string_split(r.node, {SEP}))], {SEP}))
    AND (r.tk[1] = c.tt[1] OR CASE WHEN len(c.tt) = 1 THEN c.tt[1] = '<*>' AND 1 - levenshtein({a}, {b})
      / greatest(length({a}), length({b}), 1) >= 0.8 ELSE coalesce(r.tk[2] = c.tt[2], false) END))
SELECT system, masked, arg_min(template_id, {{'d': dfs, 't': template_id}}) AS template_id FROM cand
WHERE 5 * len(list_intersect(mt, tt)) >= 4 * len(list_distinct(list_concat(mt, tt))) GROUP BY system, masked"""
    o["reference_example"] = f"WITH {LOGS}, {CATALOG}, {KEYS}, {REFS} SELECT system, masked, reference FROM refs"
    o["relevant_variables"] = f"""WITH {LOGS}, {CATALOG}, {KEYS}, {HINTS}
SELECT system, masked, string_agg(label || '=' || symbol, {SEP} ORDER BY at_) AS hints FROM ls GROUP BY system, masked"""
    o["labelling_prompts"] = f"""WITH {LOGS}, {CATALOG}, {KEYS}, {REFS}, {HINTS},
ht AS (SELECT system, masked, string_agg(chr(39) || symbol || chr(39) || ' -> {{' || label || '}}', ', ' ORDER BY at_) AS h
  FROM ls GROUP BY system, masked)
SELECT k.system, k.masked, {d.q(INSTRUCTION)} AS instruction, CASE WHEN ht.h IS NULL THEN '' ELSE 'Variable Examples: ' || ht.h || chr(10) END
  || 'Format Reference: ' || refs.reference || chr(10) || '`' || k.msg || '`' AS prompt
FROM keys k JOIN refs ON k.system = refs.system AND k.masked = refs.masked LEFT JOIN ht ON k.system = ht.system AND k.masked = ht.masked"""
    o["generalised_templates"] = f"""WITH {WALK},
ct AS (SELECT *, {d.words('template')} AS tw FROM cat),
lab AS (SELECT c.system, c.template_id, list(DISTINCT p.i) AS ps FROM cat c {KEPT} GROUP BY c.system, c.template_id),
hw AS (SELECT system, template_id, seq, {d.words('msg')} AS mw FROM res WHERE ok),
df AS (SELECT h.system, h.template_id, h.seq, x.i FROM hw h JOIN ct ON h.system = ct.system AND h.template_id = ct.template_id
  LEFT JOIN lab ON lab.system = ct.system AND lab.template_id = ct.template_id, LATERAL (SELECT unnest(generate_series(1, len(mw))) AS i) x
  WHERE len(mw) = len(tw) AND mw[x.i] <> tw[x.i] AND NOT list_contains(coalesce(lab.ps, []), x.i - 1)),
nw AS (SELECT system, template_id, i, min(seq) AS seq FROM df GROUP BY system, template_id, i),
nm AS (SELECT *, 'unknown_' || (row_number() OVER (PARTITION BY system ORDER BY seq, i, template_id) - 1) AS label FROM nw),
ag AS (SELECT system, template_id, list(i) AS gen, string_agg(label, ',' ORDER BY i) AS unknown FROM nm GROUP BY system, template_id)
SELECT ct.system, ct.template_id, ct.template, CASE WHEN ag.gen IS NULL THEN ct.template ELSE array_to_string(list_transform(tw,
  lambda t_, i_: CASE WHEN list_contains(ag.gen, i_) THEN '<*>' ELSE t_ END), ' ') END AS final_template, coalesce(ag.unknown, '') AS unknown
FROM ct LEFT JOIN ag ON ct.system = ag.system AND ct.template_id = ag.template_id"""
    return o


def catalog_oracles() -> dict[str, str]:
    return _slots() | _matching()
