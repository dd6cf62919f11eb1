"""Oracle SQL (DuckDB) for every registered query with an SQL equivalent.

Each entry reads the pre-registered parquet views and returns the same
columns, names and types as the Spark query of the same name.
"""

from __future__ import annotations

from ..sources.fixtures import branches_sql, examples_sql, log_view_sql, text_view_sql
from . import duck as d

LOGS = f"logs AS ({log_view_sql()})"
TEXTS = f"texts AS ({text_view_sql()})"


def _metrics_from(src: str) -> str:
    """GA/PGA/RGA/FGA/PA/PTA/RTA/FTA per system from CTE ``src(system, truth, parsed)``."""
    return f"""
pairs AS (SELECT system, truth, parsed, count(*) AS n FROM {src} WHERE truth IS NOT NULL GROUP BY system, truth, parsed),
bt AS (SELECT system, truth, count(*) AS k, sum(n) AS rws, max(parsed) AS parsed FROM pairs GROUP BY system, truth),
bp AS (SELECT system, parsed, count(*) AS kt, sum(n) AS parsed_rows, max(truth) AS truth FROM pairs GROUP BY system, parsed),
ga AS (SELECT bt.system, sum(bt.rws) AS rws, count(*) AS ground_templates,
          sum(CASE WHEN bt.k = 1 AND bt.rws = bp.parsed_rows THEN bt.rws ELSE 0 END) AS good_rows,
          count(CASE WHEN bt.k = 1 AND bt.rws = bp.parsed_rows THEN 1 END) AS good_groups
       FROM bt LEFT JOIN bp ON bt.system = bp.system AND bt.parsed = bp.parsed GROUP BY bt.system),
np AS (SELECT system, count(*) AS identified_templates,
          count(CASE WHEN kt = 1 AND truth = parsed THEN 1 END) AS good_t FROM bp GROUP BY system),
pa AS (SELECT system, avg(CASE WHEN truth = parsed THEN 1.0 ELSE 0.0 END)::DOUBLE AS pa FROM {src} GROUP BY system),
m AS (SELECT ga.system, ga.rws, ga.ground_templates, np.identified_templates,
         good_rows / ga.rws AS ga_, good_groups / np.identified_templates AS pga,
         good_groups / ga.ground_templates AS rga, pa.pa,
         good_t / np.identified_templates AS pta, good_t / ga.ground_templates AS rta
      FROM ga JOIN np ON ga.system = np.system JOIN pa ON ga.system = pa.system)
SELECT system, rws::BIGINT AS rows, ground_templates::BIGINT AS ground_templates,
  identified_templates::BIGINT AS identified_templates,
  round(ga_, 6) AS GA, round(pga, 6) AS PGA, round(rga, 6) AS RGA,
  round(CASE WHEN pga <> 0 OR rga <> 0 THEN 2 * pga * rga / (pga + rga) ELSE 0.0 END, 6) AS FGA,
  round(pa, 6) AS PA, round(pta, 6) AS PTA, round(rta, 6) AS RTA,
  round(CASE WHEN pta <> 0 OR rta <> 0 THEN 2 * pta * rta / (pta + rta) ELSE 0.0 END, 6) AS FTA
FROM m"""


RULE_PARSED = f"""{LOGS},
norm AS (SELECT system, seq, {d.correct_message('Content')} AS c, {d.correct_message('EventTemplate')} AS t FROM logs),
r1 AS (SELECT system, seq, t, {d.words(d.rule_chain('c'))} AS ws FROM norm),
parsed_rows AS (SELECT system, seq, {d.canonical_template('t')} AS truth,
  {d.canonical_template(d.rule_tokens('ws'))} AS parsed FROM r1)"""


def oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    o["rule_parse_metrics"] = f"WITH {RULE_PARSED},\n{_metrics_from('parsed_rows')}"
    o["log_view"] = log_view_sql()
    o["labelled_examples"] = examples_sql()
    o["correct_message"] = f"""WITH {LOGS}, {TEXTS} SELECT system, seq, {d.correct_message('Content')} AS value
FROM (SELECT system, seq, Content FROM logs UNION ALL SELECT system, seq, Content FROM texts) x"""
    o["mask_message"] = f"""WITH {LOGS}, {TEXTS},
src AS (SELECT system, seq, Content FROM logs UNION ALL SELECT system, seq, Content FROM texts),
m1 AS (SELECT system, seq, string_split(trim({d.mask_chain('Content')}), ' ') AS tk FROM src)
SELECT system, seq, trim(array_to_string({d.dedup_adjacent('tk')}, ' ')) AS value FROM m1"""
    o["rule_label"] = f"""WITH {LOGS}, {TEXTS},
src AS (SELECT system, seq, {d.correct_message('Content')} AS c FROM logs
        UNION ALL SELECT system, seq, Content FROM texts),
r1 AS (SELECT system, seq, {d.words(d.rule_chain('c'))} AS ws FROM src)
SELECT system, seq, {d.rule_tokens('ws')} AS value FROM r1"""
    o["canonical_template"] = f"""WITH {LOGS}, {TEXTS},
src AS (SELECT system, seq, EventTemplate AS c FROM logs UNION ALL SELECT system, seq, Content FROM texts)
SELECT system, seq, {d.canonical_template('c')} AS value FROM src"""
    return o


SRC = "src AS (SELECT system, seq, Content FROM logs UNION ALL SELECT system, seq, Content FROM texts)"
TEMPLATES = (f"tpl AS (SELECT system, seq, EventTemplate AS Content FROM logs UNION ALL "
             f"SELECT system || '/labelled', seq, EventTemplate FROM ({examples_sql()}) ex)")
SEP = "chr(1)"
DICT = (f"dict AS (SELECT word, count(*)::BIGINT AS n_messages FROM ("
        f"SELECT unnest(list_distinct(list_transform(list_filter({d.tokens(d.correct_message('Content'))}, "
        f"lambda t_: regexp_matches(t_, '^[A-Za-z]+$')), lambda t_: lower(t_)))) AS word FROM logs) "
        f"GROUP BY word HAVING count(*) >= 50)")
NORM = (f"norm AS (SELECT system, seq, {d.correct_message('Content')} AS c, "
        f"{d.correct_message('EventTemplate')} AS t FROM logs)")


def _per_row(expr: str) -> str:
    return f"WITH {LOGS}, {TEXTS}, {SRC} SELECT system, seq, {expr} FROM src"


def _arr(expr: str) -> str:
    return f"array_to_string({expr}, {SEP}) AS value, len({expr})::BIGINT AS n"


def _metric_ctes() -> str:
    return f"""{RULE_PARSED},
pairs AS (SELECT system, truth, parsed, count(*) AS n FROM parsed_rows WHERE truth IS NOT NULL GROUP BY system, truth, parsed),
bt AS (SELECT system, truth, count(*) AS k, sum(n) AS rws, max(parsed) AS parsed FROM pairs GROUP BY system, truth),
bp AS (SELECT system, parsed, count(*) AS kt, sum(n) AS parsed_rows, max(truth) AS truth FROM pairs GROUP BY system, parsed),
st AS (SELECT DISTINCT system, truth FROM parsed_rows WHERE contains(truth, '<*>')),
rt AS (SELECT bt.system, bt.truth, bt.rws FROM bt JOIN bp ON bt.system = bp.system AND bt.parsed = bp.parsed
       WHERE bt.k = 1 AND bt.rws = bp.parsed_rows)"""


def _f1(p: str, r: str) -> str:
    return f"round(CASE WHEN {p} <> 0 OR {r} <> 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END, 6)"


def _fold(e: str) -> str:
    return f"list_transform(string_split({e}, ' '), lambda t_: CASE WHEN contains(t_, '<*>') THEN '<*>' ELSE t_ END)"


def alike(a: str, b: str) -> str:
    """Character-set Jaccard of at least 0.8."""
    ca, cb = d.characters(a), d.characters(b)
    return (f"len(list_intersect({ca}, {cb})) > 0 AND 5 * len(list_intersect({ca}, {cb})) "
            f">= 4 * len(list_distinct(list_concat({ca}, {cb})))")


def first_fit(ordered: str) -> str:
    """Leaders among one-element lists in order: each is kept unless it is like a leader before it."""
    return (f"list_reduce({ordered}, lambda a_, x_: CASE WHEN len(list_filter(a_, lambda l_: {alike('l_', 'x_[1]')})) > 0 "
            f"THEN a_ ELSE list_concat(a_, x_) END)")


def _more() -> dict[str, str]:
    o: dict[str, str] = {}
    o["remove_punctuation"] = _per_row(f"{d.remove_punctuation('Content')} AS value")
    o["tokens"] = _per_row(_arr(d.tokens("Content")))
    o["message_tokens"] = _per_row(_arr(d.tokens(d.correct_message("Content"))))
    o["words"] = _per_row(_arr(d.words("Content")))
    o["format_signature"] = _per_row(f"{d.format_signature('Content')} AS value")
    o["star_digits"] = _per_row(f"{d.star_digits('Content')} AS value")
    o["match_tokens"] = (f"WITH {LOGS}, {TEMPLATES} SELECT system, seq, "
                         f"array_to_string({d.match_tokens('Content')}, {SEP}) AS value FROM tpl")
    o["repair_response"] = f"""WITH b AS ({branches_sql()}),
r0 AS (SELECT system, seq, {d.correct_message('Content')} AS msg, Labelled AS resp FROM b),
r1 AS (SELECT system, seq, msg, {d.words(d.rule_chain("CASE WHEN contains(resp, msg) THEN msg ELSE resp END"))} AS ws FROM r0),
r2 AS (SELECT system, seq, msg, {d.rule_tokens('ws')} AS lab FROM r1),
r3 AS (SELECT system, seq, lab, {d.words('lab')} AS t, {d.words('msg')}[1] AS first FROM r2)
SELECT system, seq, CASE WHEN len(t) > 0 AND len(list_filter(t, lambda x_: NOT regexp_matches(x_, '\\{{.*\\}}'))) = 0
  AND first IS NOT NULL AND NOT regexp_matches(first, '\\p{{Nd}}')
  THEN array_to_string(list_prepend(first, t[2:]), ' ') ELSE lab END AS value FROM r3"""
    o["scoring_tokens"] = f"""WITH {LOGS}, {TEXTS}, {TEMPLATES},
s0 AS (SELECT system, seq, Content FROM tpl UNION ALL SELECT system, seq, Content FROM texts),
s1 AS (SELECT system, seq, {d.scoring_clean(d.scoring_pieces('Content'))} AS sc FROM s0),
s2 AS (SELECT system, seq, {d.collapse_wild('sc')} AS tk FROM s1)
SELECT system, seq, {_arr('tk')} FROM s2"""
    o["jaccard"] = (f"WITH {LOGS}, {NORM} SELECT system, seq, "
                    f"round({d.jaccard(d.tokens('c'), d.match_tokens('t'))}, 6) AS similarity FROM norm")
    o["char_jaccard"] = (f"WITH {LOGS}, {NORM} SELECT system, seq, "
                         f"round({d.jaccard(d.characters('c'), d.characters('t'))}, 6) AS similarity FROM norm")
    a, b = d.star_digits("c"), d.star_digits("t")
    o["edit_similarity"] = (f"WITH {LOGS}, {NORM} SELECT system, seq, round(CASE WHEN greatest(length({a}), length({b})) = 0 "
                            f"THEN 1.0 ELSE 1.0 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END, 6) "
                            f"AS similarity FROM norm")
    msg_tok = d.tokens(d.correct_message("Content"))
    o["dictionary"] = f"WITH {LOGS}, {DICT} SELECT word, n_messages FROM dict"
    o["is_common"] = f"""WITH {LOGS}, {DICT},
toks AS (SELECT DISTINCT unnest({msg_tok}) AS token FROM logs),
x AS (SELECT token, {d.remove_punctuation('token')} AS s FROM toks)
SELECT token, (NOT (s = upper(s) AND s <> lower(s))) AND (lower(s) IN (SELECT word FROM dict)
  OR (ends_with(lower(s), 'ed') AND left(lower(s), length(s) - 2) IN (SELECT word FROM dict))) AS is_common FROM x"""
    unc = f"""{DICT},
dl AS (SELECT coalesce(list(word), []) AS dl FROM dict),
tk AS (SELECT system, seq, {msg_tok} AS tokens FROM logs),
u AS (SELECT system, seq, tokens, list_filter(tokens, lambda t_: NOT list_contains(dl, t_)) AS unc FROM tk, dl)"""
    o["uncommon_tokens"] = (f"WITH {LOGS}, {unc} SELECT system, seq, array_to_string(unc, {SEP}) AS value, "
                            f"len(unc)::BIGINT AS n, (len(tokens) = 1 OR len(unc) = 0) AS is_literal FROM u")
    o["distinct_uncommon_tokens"] = (f"WITH {LOGS}, {unc} SELECT system, seq, array_to_string(list_filter(unc, "
                                     f"lambda x_, i_: NOT list_contains(unc[1:i_ - 1], x_)), {SEP}) AS value FROM u")
    o["dedup_by_mask"] = f"""WITH {LOGS},
m1 AS (SELECT system, seq, string_split(trim({d.mask_chain('Content')}), ' ') AS tk FROM logs),
m2 AS (SELECT system, seq, trim(array_to_string({d.dedup_adjacent('tk')}, ' ')) AS masked FROM m1)
SELECT system, min(seq) AS seq, masked FROM m2 GROUP BY system, masked"""
    o["dedup_by_format"] = (f"WITH {LOGS} SELECT system, min(seq) AS seq, {d.format_signature('Content')} AS signature "
                            f"FROM logs GROUP BY system, signature")
    groups = f"""{DICT},
fmt AS (SELECT arg_min(seq, seq) AS seq, system FROM logs GROUP BY system, {d.format_signature('Content')}),
tk AS (SELECT l.system, l.seq, {msg_tok} AS tokens FROM logs l SEMI JOIN fmt ON l.system = fmt.system AND l.seq = fmt.seq),
dl AS (SELECT coalesce(list(word), []) AS dl FROM dict),
u AS (SELECT system, seq, list_filter(tokens, lambda t_: NOT list_contains(dl, t_)) AS unc FROM tk, dl),
g AS (SELECT system, min(seq) AS seq, unc FROM u GROUP BY system, unc)"""
    o["candidate_groups"] = f"WITH {LOGS}, {groups} SELECT system, seq, array_to_string(unc, {SEP}) AS uncommon FROM g"
    o["distinct_uncommon"] = f"WITH {LOGS}, {groups} SELECT DISTINCT system, unnest(unc) AS token FROM g"
    clusters = f"""{groups},
toks AS (SELECT DISTINCT system, unnest(unc) AS token FROM g),
led AS (SELECT system, {first_fit("list([token] ORDER BY token)")} AS leaders FROM toks GROUP BY system),
cl AS (SELECT t.system, t.token, list_filter(leaders, lambda l_: {alike("l_", "t.token")})[1] AS leader
  FROM toks t JOIN led ON t.system = led.system),
occ AS (SELECT x.system, x.seq, x.token, list_position(tk.tokens, x.token) AS pos, cl.leader
  FROM (SELECT system, seq, unnest(unc) AS token FROM g) x JOIN tk ON x.system = tk.system AND x.seq = tk.seq
  JOIN cl ON x.system = cl.system AND x.token = cl.token),
np AS (SELECT system, leader, count(DISTINCT pos) AS n_positions FROM occ GROUP BY system, leader)"""
    o["token_clusters"] = f"WITH {LOGS}, {clusters} SELECT system, token, leader, token = leader AS is_leader FROM cl"
    o["cluster_positions"] = f"WITH {LOGS}, {clusters} SELECT system, leader, n_positions FROM np"
    o["contribution_scores"] = f"""WITH {LOGS}, {clusters}
SELECT g.system, g.seq, coalesce(w.score, 0)::BIGINT AS score FROM g LEFT JOIN (SELECT occ.system, occ.seq, sum(n_positions) AS score
  FROM occ JOIN np ON occ.system = np.system AND occ.leader = np.leader GROUP BY occ.system, occ.seq) w
ON g.system = w.system AND g.seq = w.seq"""
    o["prefix_sample"] = (f"WITH {LOGS} SELECT system, seq FROM (SELECT system, seq, row_number() OVER "
                          f"(PARTITION BY system ORDER BY seq) AS rn, count(*) OVER (PARTITION BY system) AS n FROM logs) x "
                          f"WHERE rn <= floor(0.2::DOUBLE * n)")
    o["head_per_system"] = (f"WITH {LOGS} SELECT system, seq, Content FROM (SELECT *, row_number() OVER "
                            f"(PARTITION BY system ORDER BY seq) AS rn FROM logs) x WHERE rn <= 32")
    # metrics variants
    o["grouping_accuracy"] = f"""WITH {_metric_ctes()},
ga AS (SELECT bt.system, sum(bt.rws) AS rws, count(*) AS ground_templates,
          sum(CASE WHEN bt.k = 1 AND bt.rws = bp.parsed_rows THEN bt.rws ELSE 0 END) AS good_rows,
          count(CASE WHEN bt.k = 1 AND bt.rws = bp.parsed_rows THEN 1 END) AS good_groups
       FROM bt LEFT JOIN bp ON bt.system = bp.system AND bt.parsed = bp.parsed GROUP BY bt.system),
np AS (SELECT system, count(*) AS identified_templates FROM bp GROUP BY system),
m AS (SELECT ga.*, np.identified_templates, good_groups / np.identified_templates AS pga,
      good_groups / ga.ground_templates AS rga FROM ga JOIN np ON ga.system = np.system)
SELECT system, rws::BIGINT AS rows, ground_templates::BIGINT AS ground_templates,
  identified_templates::BIGINT AS identified_templates, round(good_rows / rws, 6) AS GA,
  round(pga, 6) AS PGA, round(rga, 6) AS RGA, {_f1('pga', 'rga')} AS FGA FROM m"""
    o["grouping_accuracy_stratified"] = f"""WITH {_metric_ctes()},
hits AS (SELECT r.system, sum(r.rws) AS good_rows, count(*) AS good_groups FROM rt r
         SEMI JOIN st ON r.system = st.system AND r.truth = st.truth GROUP BY r.system),
lp AS (SELECT p.* FROM pairs p SEMI JOIN st ON p.system = st.system AND p.truth = st.truth),
tt AS (SELECT system, sum(n) AS rws, count(DISTINCT parsed) AS identified_templates FROM lp GROUP BY system),
sz AS (SELECT system, count(*) AS ground_templates FROM st GROUP BY system),
m AS (SELECT sz.system, tt.rws, sz.ground_templates, tt.identified_templates,
        coalesce(hits.good_rows, 0) AS good_rows, coalesce(hits.good_groups, 0) AS good_groups
      FROM sz LEFT JOIN tt ON sz.system = tt.system LEFT JOIN hits ON sz.system = hits.system),
m2 AS (SELECT *, good_groups / identified_templates AS pga, good_groups / ground_templates AS rga FROM m)
SELECT system, rws::BIGINT AS rows, ground_templates::BIGINT AS ground_templates,
  identified_templates::BIGINT AS identified_templates, round(good_rows / rws, 6) AS GA,
  round(pga, 6) AS PGA, round(rga, 6) AS RGA, {_f1('pga', 'rga')} AS FGA FROM m2"""
    o["parsing_accuracy_folded"] = (f"WITH {RULE_PARSED} SELECT system, round(avg(CASE WHEN {_fold('truth')} = "
                                    f"string_split(parsed, ' ') THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS PA "
                                    f"FROM parsed_rows GROUP BY system")
    o["parsing_accuracy_stratified"] = f"""WITH {_metric_ctes()}
SELECT p.system, round(avg(CASE WHEN p.truth = p.parsed THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS PA
FROM parsed_rows p SEMI JOIN st ON p.system = st.system AND p.truth = st.truth GROUP BY p.system"""

    def ta(same: str) -> str:
        return f"""WITH {_metric_ctes()},
good AS (SELECT system, count(*) AS good FROM bp WHERE kt = 1 AND {same} GROUP BY system),
np AS (SELECT system, count(*) AS identified_templates FROM bp GROUP BY system),
nt AS (SELECT system, count(*) AS ground_templates FROM bt GROUP BY system),
m AS (SELECT np.system, np.identified_templates, nt.ground_templates, coalesce(good.good, 0) AS good
      FROM np JOIN nt ON np.system = nt.system LEFT JOIN good ON np.system = good.system),
m2 AS (SELECT *, good / identified_templates AS pta, good / ground_templates AS rta FROM m)
SELECT system, identified_templates::BIGINT AS identified_templates, ground_templates::BIGINT AS ground_templates,
  round(pta, 6) AS PTA, round(rta, 6) AS RTA, {_f1('pta', 'rta')} AS FTA FROM m2"""
    o["template_accuracy"] = ta("truth = parsed")
    o["template_accuracy_folded"] = ta(f"{_fold('parsed')} = string_split(truth, ' ')")
    o["template_accuracy_stratified"] = f"""WITH {_metric_ctes()},
good AS (SELECT b.system, count(*) AS good FROM bp b SEMI JOIN st ON b.system = st.system AND b.truth = st.truth
         WHERE b.kt = 1 AND b.truth = b.parsed GROUP BY b.system),
np AS (SELECT p.system, count(DISTINCT p.parsed) AS identified_templates FROM pairs p
       SEMI JOIN st ON p.system = st.system AND p.truth = st.truth GROUP BY p.system),
nt AS (SELECT system, count(*) AS ground_templates FROM st GROUP BY system),
m AS (SELECT nt.system, coalesce(np.identified_templates, 0) AS identified_templates, nt.ground_templates,
        coalesce(good.good, 0) AS good
      FROM nt LEFT JOIN np ON nt.system = np.system LEFT JOIN good ON nt.system = good.system),
m2 AS (SELECT *, good / identified_templates AS pta, good / ground_templates AS rta FROM m)
SELECT system, identified_templates::BIGINT AS identified_templates, ground_templates::BIGINT AS ground_templates,
  round(pta, 6) AS PTA, round(rta, 6) AS RTA, {_f1('pta', 'rta')} AS FTA FROM m2"""
    o["similarity_accuracy"] = f"""WITH {RULE_PARSED},
s1 AS (SELECT system, {d.scoring_clean(d.scoring_pieces('truth'))} AS ca, {d.scoring_clean(d.scoring_pieces('parsed'))} AS cb
       FROM parsed_rows),
s2 AS (SELECT system, {d.collapse_wild('ca')} AS ta, {d.collapse_wild('cb')} AS tb FROM s1),
s3 AS (SELECT system, ta, tb, len(list_intersect(ta, tb)) AS i FROM s2)
SELECT system, round(avg(i / (len(ta) + len(tb) - i))::DOUBLE, 6) AS SA FROM s3 GROUP BY system"""
    o["aligned_metrics"] = oracles_base()["rule_parse_metrics"]
    o["result_rows"] = f"""WITH base AS ({oracles_base()['rule_parse_metrics']})
SELECT system AS Dataset, 0.0::DOUBLE AS parse_time, 0.0::DOUBLE AS invoc_time, 0::BIGINT AS invoc_num,
  0.0::DOUBLE AS invoc_token, identified_templates, ground_templates, GA, PA, FGA, PTA, RTA, FTA FROM base"""
    o["stream_first_seen"] = f"""WITH {LOGS},
s AS (SELECT system, seq, {d.correct_message('Content')} AS c FROM logs),
m1 AS (SELECT system, string_split(trim({d.mask_chain('c')}), ' ') AS tk FROM s),
m2 AS (SELECT system, trim(array_to_string({d.dedup_adjacent('tk')}, ' ')) AS masked FROM m1)
SELECT DISTINCT system, masked FROM m2"""
    o["stream_first_messages"] = f"""WITH {LOGS},
s AS (SELECT system, seq, {d.correct_message('Content')} AS c FROM logs),
m1 AS (SELECT system, seq, c, string_split(trim({d.mask_chain('c')}), ' ') AS tk FROM s),
m2 AS (SELECT system, seq, c, trim(array_to_string({d.dedup_adjacent('tk')}, ' ')) AS masked FROM m1)
SELECT system, masked, min(seq) AS seq, arg_min(c, seq) AS msg FROM m2 GROUP BY system, masked"""
    return o


oracles_base = oracles


def oracles() -> dict[str, str]:  # noqa: F811
    out = oracles_base()
    out.update(_more())
    from .catalog_oracles import catalog_oracles
    out.update(catalog_oracles())
    return out
