"""SQL that DuckDB runs on the same tables to check the registered queries.

Written apart from the operators: windows over raw rows, built-in medians and
correlations, numeric integration for p-values. It need not scale.
"""

from __future__ import annotations

from riskloom import fixed
from riskloom.registry import views
from riskloom.registry.queries import RESULT_GROUPS, RESULT_MODELS, RULES, STOP_WORDS, WEIGHTS

_VIEW_SQL = {
    "orders_view": views.ORDERS_VIEW,
    "orders_raw": views.ORDERS_RAW,
    "postings": views.POSTINGS_VIEW,
    "salary": views.SALARY_VIEW,
    "responses": views.RESPONSES_VIEW,
    "review": views.REVIEW_VIEW,
    "results": views.RESULTS_VIEW,
}
_NEEDS = {"orders_raw": ["orders_view"], "review": ["orders_view"]}


def with_views(names: str, sql: str) -> str:
    """Put the named views in front of a SELECT (or of more CTEs)."""
    order: list[str] = []
    for name in names.split():
        order += [n for n in [*_NEEDS.get(name, []), name] if n not in order]
    bound = {t: t for t in [*views.TABLES, "orders_view"]}
    ctes = ", ".join(f"{n} AS MATERIALIZED ({_VIEW_SQL[n].format(**bound)})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


WS = " || ".join(f"chr({ord(c)})" for c in fixed.WHITESPACE)
FLAGS, SCORES = fixed.FLAGS, fixed.SCORES
TOTAL = " + ".join(FLAGS)


def strip(c: str) -> str:
    return f"trim({c}, {WS})"


def t_two_sided(t: str, dof: str) -> str:
    """Two-sided p of Student's t by Simpson's rule on 0..|t|."""
    x = f"(abs({t}) * i / 4000.0)"
    density = (
        f"exp(lgamma(({dof} + 1) / 2.0) - lgamma({dof} / 2.0)) / sqrt({dof} * pi())"
        f" * pow(1 + {x} * {x} / {dof}, -({dof} + 1) / 2.0)"
    )
    return (
        f"(SELECT 1 - 2 * sum((CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
        f" * {density}) * abs({t}) / 4000.0 / 3.0 FROM range(0, 4001) r(i))"
    )


def normal_upper(z: str) -> str:
    x = f"({z} * i / 4000.0)"
    return (
        f"(SELECT 0.5 - sum((CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
        f" * exp(-{x} * {x} / 2) / sqrt(2 * pi())) * {z} / 4000.0 / 3.0 FROM range(0, 4001) r(i))"
    )


def stars(p: str) -> str:
    return f"CASE WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' WHEN {p} < 0.05 THEN '*' ELSE 'ns' END"


def union(parts) -> str:
    return " UNION ALL ".join(parts)


ORACLE: dict[str, str] = {}

# --- cleaning, text, salary ---------------------------------------------------


def _number(c: str) -> str:
    value = f"TRY_CAST({strip(c)} AS DOUBLE)"
    return f"CASE WHEN NOT isnan({value}) THEN {value} END"


ORACLE["coerce_flags"] = with_views(
    "orders_raw",
    "SELECT o_orderkey, "
    + ", ".join(
        f"COALESCE(CAST({_number(f)} AS INT), 0) AS {f}"
        for f in fixed.FLAGS
    )
    + " FROM orders_raw",
)
ORACLE["coerce_scores"] = with_views(
    "orders_raw",
    "SELECT o_orderkey, "
    + ", ".join(f"{_number(s)} AS {s}" for s in fixed.SCORES)
    + " FROM orders_raw",
)

_POSTING_COLUMNS = (
    "title location department salary_range employment_type required_experience "
    "required_education industry function telecommuting has_company_logo has_questions "
    "company_profile description requirements benefits qcew_avg_annual_pay"
).split()


def _line(label: str, column: str) -> str:
    s = strip(f"CAST({column} AS VARCHAR)")
    return (
        f"CASE WHEN lower({s}) NOT IN ('', 'nan', 'none') "
        f"THEN '{label}: ' || substring({s}, 1, {fixed.RENDER_CUT}) END"
    )


_RENDERED = "concat_ws(chr(10), {})".format(
    ", ".join(_line(label, c) for label, c in fixed.RENDER_FIELDS if c in _POSTING_COLUMNS)
)
ORACLE["render_posting"] = with_views(
    "postings", f"SELECT job_id, {_RENDERED} AS posting_text FROM postings"
)
_TEXT = " || ' ' || ".join(f"COALESCE({c}, '')" for c in fixed.TEXT_COLUMNS)
ORACLE["combine_text"] = with_views("postings", f"SELECT job_id, {_TEXT} AS text FROM postings")
ORACLE["combine_text_sep"] = with_views(
    "postings",
    "SELECT job_id, concat_ws(' [SEP] ', "
    + ", ".join(f"nullif({strip(c)}, '')" for c in fixed.TEXT_COLUMNS)
    + ") AS text FROM postings",
)
_EDU = " ".join(
    "WHEN '{}' THEN '{}'".format(k.replace("'", "''"), e) for k, e in fixed.EDUCATION_MAP.items()
)
ORACLE["education_map"] = with_views(
    "postings",
    f"SELECT job_id, CASE required_education {_EDU} ELSE required_education END AS education FROM postings",
)


def label_list(c: str) -> str:
    parts = f"list_filter(list_transform(string_split({c}, ','), lambda x: {strip('x')}), lambda x: x <> '')"
    return f"CASE WHEN {c} IS NULL OR len({parts}) = 0 THEN ['{fixed.MISSING}'] ELSE {parts} END"


ORACLE["parse_multilabel"] = with_views(
    "postings",
    f"""WITH p AS (SELECT job_id, {label_list('industry')} AS ls FROM postings)
    SELECT job_id, array_to_string(ls, '|') AS labels, CAST(len(ls) AS BIGINT) AS n_labels FROM p""",
)
_MONTH = " ".join(f"WHEN contains(s, '{m}') THEN {n}.0" for m, n in fixed.MONTHS.items())
_SALARY = f"""
p AS (SELECT o_orderkey, salary_range, lower({strip('salary_range')}) AS s FROM salary),
m AS (SELECT *, CAST(CASE {_MONTH} END AS DOUBLE) AS month, regexp_extract_all(s, '[0-9]+') AS runs FROM p),
parsed AS (SELECT o_orderkey, CASE WHEN salary_range IS NULL THEN 1 ELSE 0 END AS salary_range_missing,
  COALESCE(month, CAST(runs[1] AS DOUBLE)) AS salary_lower,
  COALESCE(month, CAST(runs[2] AS DOUBLE), CAST(runs[1] AS DOUBLE)) AS salary_upper FROM m)"""
ORACLE["parse_salary"] = with_views("salary", f"WITH {_SALARY} SELECT * FROM parsed")
ORACLE["salary_fill_mean"] = with_views(
    "salary",
    f"""WITH {_SALARY} SELECT o_orderkey, salary_range_missing,
    round(COALESCE(salary_lower, avg(salary_lower) OVER ()), 6) AS salary_lower,
    round(COALESCE(salary_upper, avg(salary_upper) OVER ()), 6) AS salary_upper FROM parsed""",
)

# --- flags and scores ---------------------------------------------------------

_AGENT_OF = {
    fixed.FLAG_BY_ID[i]: agent for agent, ids in fixed.AGENT_FLAG_IDS.items() for i in ids
}


def combo_members(combo: str) -> list[str]:
    return [f for f in FLAGS if _AGENT_OF[f] in fixed.COMBO_AGENTS[combo]]


ORACLE["combo_flags"] = with_views(
    "orders_view",
    union(
        f"SELECT '{combo}' AS combo, '{_AGENT_OF[f]}' AS agent, '{f}' AS flag, "
        f"CAST(sum({f}) AS BIGINT) AS positives FROM orders_view"
        for combo in fixed.COMBO_AGENTS for f in combo_members(combo)
    ),
)
ORACLE["flag_rules"] = with_views(
    "orders_view",
    "SELECT o_orderkey, "
    + ", ".join(
        f"CASE WHEN ({trigger}) AND NOT ({guard or 'false'}) THEN 1 ELSE 0 END AS {name}"
        for name, (trigger, guard) in RULES.items()
    )
    + " FROM orders_view",
)

_JSON = """
j AS MATERIALIZED (SELECT o_orderkey, response,
  CASE WHEN json_valid(response) THEN CASE WHEN json_type(response) = 'OBJECT' THEN response END END AS obj
  FROM responses)"""


def _truth(flag: str) -> str:
    kind, text = f"json_type(obj, '$.{flag}')", f"json_extract_string(obj, '$.{flag}')"
    return f"""CAST(CASE WHEN {kind} IS NULL OR {kind} = 'NULL' THEN 0
      WHEN {kind} = 'BOOLEAN' THEN CASE WHEN {text} = 'true' THEN 1 ELSE 0 END
      WHEN {kind} = 'VARCHAR' THEN CASE WHEN {text} <> '' THEN 1 ELSE 0 END
      WHEN {kind} = 'ARRAY' THEN CASE WHEN json_array_length(obj, '$.{flag}') > 0 THEN 1 ELSE 0 END
      WHEN {kind} = 'OBJECT' THEN CASE WHEN len(json_keys(obj, '$.{flag}')) > 0 THEN 1 ELSE 0 END
      ELSE CASE WHEN TRY_CAST({text} AS DOUBLE) <> 0 THEN 1 ELSE 0 END END AS INT)"""


def _score(default: str) -> str:
    kind, text = "json_type(obj, '$.risk_score')", "json_extract_string(obj, '$.risk_score')"
    number = f"CASE WHEN {kind} = 'BOOLEAN' THEN CASE WHEN {text} = 'true' THEN 1.0 ELSE 0.0 END ELSE TRY_CAST({text} AS DOUBLE) END"
    return f"""CAST(CASE WHEN obj IS NULL THEN NULL WHEN {kind} IS NULL THEN {default}
      ELSE CASE WHEN ({number}) IS NOT NULL THEN greatest(0, least(10, round_even(CAST({number} AS DOUBLE), 0))) END END AS INT)"""


ORACLE["parse_flags"] = with_views(
    "responses",
    f"WITH {_JSON} SELECT o_orderkey, " + ", ".join(f"{_truth(f)} AS {f}" for f in FLAGS) + " FROM j",
)
ORACLE["parse_score"] = with_views(
    "responses",
    f"WITH {_JSON} SELECT o_orderkey, {_score('0')} AS subset_score, {_score('NULL')} AS single_score FROM j",
)
ORACLE["combo_flag_sums"] = with_views(
    "orders_view",
    union(
        f"SELECT o_orderkey, '{c}' AS combo, CAST({' + '.join(combo_members(c))} AS BIGINT) AS triggered FROM orders_view"
        for c in fixed.COMBO_AGENTS
    ),
)


def _weighted(combo: str) -> str:
    names = combo_members(combo)
    hit = " + ".join(f"{WEIGHTS[f]} * {f}" for f in names)
    total = sum(WEIGHTS[f] for f in names)
    return f"CAST(greatest(0, least(10, round_even(({hit}) * CAST(10 AS DOUBLE) / CAST({total} AS DOUBLE), 0))) AS INT) AS {fixed.COMBO_SCORE[combo]}"


ORACLE["weighted_risk"] = with_views(
    "orders_view",
    "SELECT o_orderkey, " + ", ".join(_weighted(c) for c in fixed.COMBO_AGENTS) + " FROM orders_view",
)
ORACLE["score_new"] = with_views(
    "orders_view",
    f"SELECT o_orderkey, {_weighted('all')} FROM orders_view WHERE orders_view.risk_score_all IS NULL",
)


def _band(score: str, bands) -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {low} THEN '{name}'" for low, name in reversed(bands)) + " END"


ORACLE["score_band"] = with_views(
    "orders_view",
    f"""SELECT o_orderkey, {_band('risk_score_all', fixed.SUBSET_BANDS)} AS subset_band,
    {_band('single_pass_risk_score', fixed.SINGLE_PASS_BANDS)} AS single_band FROM orders_view""",
)
ORACLE["score_with_injected"] = with_views(
    "postings",
    f"""WITH r AS (SELECT job_id, {_RENDERED} AS t FROM postings)
    SELECT job_id, true AS ok,
    CAST(least(10, round_even(CAST(length(t) % 23 AS DOUBLE) / 2, 0)) AS INT) AS single_pass_risk_score FROM r""",
)
_AGENT_FLAGS = {f: f"CASE WHEN length(t) % {i + 2} = 0 THEN 1 ELSE 0 END" for i, f in fixed.FLAG_BY_ID.items()}
ORACLE["score_by_agents"] = with_views(
    "postings",
    f"""WITH r AS (SELECT job_id, {_RENDERED} AS t FROM postings),
    fl AS (SELECT job_id, {', '.join(f'{sql} AS {f}' for f, sql in _AGENT_FLAGS.items())} FROM r)
    SELECT *, """
    + ", ".join(
        f"CAST(least(10, round_even(CAST(2.5 * ({' + '.join(combo_members(c))}) AS DOUBLE), 0)) AS INT) AS {s}"
        for c, s in fixed.COMBO_SCORE.items()
    )
    + " FROM fl",
)
_OK = "response IS NOT NULL AND response LIKE '{%'"
ORACLE["failure_defaults"] = with_views(
    "responses",
    f"""WITH {_JSON} SELECT o_orderkey,
    CASE WHEN {_OK} THEN {_truth('flag1_sensitive_info')} ELSE 0 END AS flag1_sensitive_info,
    CASE WHEN {_OK} THEN {_score('0')} END AS risk_score_all FROM j""",
)
ORACLE["scoring_progress"] = with_views(
    "orders_view",
    """WITH p AS (SELECT risk_score_all AS s, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders_view)
    SELECT count(s) AS completed, count(*) - count(s) AS remaining,
    min(CASE WHEN s IS NULL THEN i END) AS first_unscored, max(CASE WHEN s IS NULL THEN i END) AS last_unscored FROM p""",
)
ORACLE["select_range"] = """
SELECT o_orderkey, o_custkey, o_totalprice
FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i >= 1000"""
ORACLE["overlay_results"] = with_views(
    "orders_view responses",
    f"""WITH {_JSON} SELECT o.o_orderkey,
    CASE WHEN {_OK} THEN {_score('0')} ELSE o.risk_score_all END AS risk_score_all
    FROM orders_view o JOIN j ON o.o_orderkey = j.o_orderkey""",
)

# --- flag and score statistics ------------------------------------------------

_Y = fixed.LABEL
ORACLE["base_rate"] = with_views(
    "orders_view",
    f"""SELECT count(*) AS n, CAST(sum({_Y}) AS BIGINT) AS positives,
    CAST(sum({_Y}) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0 AS rate_pct FROM orders_view""",
)
def _long_flags(source: str, key: str, flags: list[str]) -> str:
    return "long AS MATERIALIZED (" + union(
        f"SELECT {key}, '{f}' AS flag, {i} AS place, {f} AS v, {_Y} AS y FROM {source}"
        for i, f in enumerate(flags)
    ) + ")"


def _cells(source: str, key: str, flags: list[str]) -> str:
    """The 2x2 counts of labelled records; `e` has expected cells and chi-square. A row or column without records has no cells."""
    return _long_flags(source, key, flags) + """, cells AS MATERIALIZED (SELECT flag,
  count(*) FILTER (v = 1 AND y = 1) AS n11, count(*) FILTER (v = 1 AND y = 0) AS n10,
  count(*) FILTER (v = 0 AND y = 1) AS n01, count(*) FILTER (v = 0 AND y = 0) AS n00 FROM long GROUP BY flag),
m AS MATERIALIZED (SELECT *, CAST(n11 + n10 AS DOUBLE) AS r1, CAST(n01 + n00 AS DOUBLE) AS r0, CAST(n11 + n01 AS DOUBLE) AS c1,
  CAST(n10 + n00 AS DOUBLE) AS c0, CAST(n11 + n10 + n01 + n00 AS DOUBLE) AS n FROM cells),
e AS MATERIALIZED (SELECT *, least(nullif(r1 * c1, 0) / n, nullif(r1 * c0, 0) / n, nullif(r0 * c1, 0) / n, nullif(r0 * c0, 0) / n) AS expected_min,
  CASE WHEN r1 * r0 * c1 * c0 > 0 THEN n * pow(greatest(0.0, abs(CAST(n11 AS DOUBLE) * n00 - CAST(n10 AS DOUBLE) * n01) - n / 2), 2) / (r1 * r0 * c1 * c0)
    WHEN n > 0 THEN 0.0 END AS chi2 FROM m),
terms AS (SELECT flag, n11, k, -(lgamma(k + 1) + lgamma(r1 - k + 1) + lgamma(c1 - k + 1) + lgamma(n - r1 - c1 + k + 1)) AS w
  FROM (SELECT *, unnest(range(CAST(greatest(0, r1 + c1 - n) AS BIGINT), CAST(least(r1, c1) AS BIGINT) + 1)) AS k FROM m)),
peak AS (SELECT flag, max(w) AS top, max(CASE WHEN k = n11 THEN w END) AS seen FROM terms GROUP BY flag),
fisher AS MATERIALIZED (SELECT flag, least(1.0, sum(CASE WHEN exp(w - top) <= exp(seen - top) * (1 + 1e-7) THEN exp(w - top) ELSE 0 END) / sum(exp(w - top))) AS fisher_p
  FROM terms JOIN peak USING (flag) GROUP BY flag)"""


_LONG_FLAGS = _long_flags("orders_view", "o_orderkey", FLAGS)
_CELLS = _cells("orders_view", "o_orderkey", FLAGS)
ORACLE["contingency"] = with_views("orders_view", f"WITH {_CELLS} SELECT * FROM cells")
_TEST = "CASE WHEN expected_min < 5 THEN 'Fisher' ELSE 'Chi-sq' END"
ORACLE["expected_cells"] = with_views(
    "orders_view", f"WITH {_CELLS} SELECT flag, expected_min, {_TEST} AS test FROM e"
)
ORACLE["chi2_yates"] = with_views(
    "orders_view",
    f"""WITH {_CELLS} SELECT flag, round(chi2, 6) AS chi2,
    round(2 * {normal_upper('sqrt(chi2)')}, 6) AS p_value FROM e""",
)
ORACLE["fisher_exact"] = with_views(
    "orders_view", f"WITH {_CELLS} SELECT flag, round(fisher_p, 6) AS fisher_p FROM fisher"
)


def _prevalence(cells: str, source: str) -> str:
    return f"""WITH {cells}, every AS (SELECT flag, count(*) FILTER (v = 1) AS flagged FROM long GROUP BY flag),
    total AS (SELECT CAST(count(*) AS DOUBLE) AS records, CAST(sum({_Y}) AS DOUBLE) AS positives FROM {source}),
    rates AS (SELECT e.*, flagged, fisher_p, n11 / nullif(r1, 0) * 100.0 AS rate_with_pct, n01 / nullif(r0, 0) * 100.0 AS rate_without_pct
      FROM e JOIN fisher USING (flag) JOIN every USING (flag) WHERE flagged > 0),
    tested AS MATERIALIZED (SELECT *, {_TEST} AS test,
      CASE WHEN expected_min < 5 THEN fisher_p ELSE 2 * {normal_upper('sqrt(chi2)')} END AS p FROM rates)
    SELECT flag, flagged, flagged / records * 100.0 AS prevalence_pct, positives / records * 100.0 AS base_rate_pct,
      rate_without_pct, rate_with_pct, rate_with_pct - rate_without_pct AS difference_pp,
      CASE WHEN rate_without_pct > 0 THEN rate_with_pct / rate_without_pct ELSE 'inf'::DOUBLE END AS relative_risk,
      round(p, 6) AS p_value, {stars('p')} AS sig, test FROM tested, total"""


ORACLE["flag_prevalence"] = with_views("orders_view", _prevalence(_CELLS, "orders_view"))
_RULE_FLAGS = """fp AS MATERIALIZED (SELECT *,
  CASE WHEN description LIKE '%password%' OR description LIKE '%@%' THEN 1 ELSE 0 END AS flag1_sensitive_info,
  CASE WHEN qcew_avg_annual_pay < 200 AND location IS NOT NULL THEN 1 ELSE 0 END AS flag7_vague_info FROM postings)"""
ORACLE["flag_prevalence_partial"] = with_views(
    "postings",
    _prevalence(f"{_RULE_FLAGS}, {_cells('fp', 'job_id', ['flag1_sensitive_info', 'flag7_vague_info'])}", "fp"),
)
ORACLE["sig_stars"] = f"SELECT {stars('l_discount / 9.0')} AS sig, count(*) AS n FROM lineitem GROUP BY 1"
_AGREE = f"""SELECT CAST({TOTAL} AS BIGINT) AS total_flags, count(*) AS records,
  CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM orders_view) * 100.0 AS share_pct,
  CAST(sum({_Y}) AS BIGINT) AS positives, CAST(sum({_Y}) AS DOUBLE) / count(*) * 100.0 AS rate_pct
  FROM orders_view GROUP BY 1"""
ORACLE["flag_agreement"] = with_views("orders_view", _AGREE)


def _spearman(x: str, y: str, source: str) -> str:
    return f"""SELECT count(*) AS n, corr(rx, ry) AS rho FROM (
      SELECT rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS rx,
             rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2.0 AS ry FROM {source})"""


_RHO = _spearman(f"({TOTAL})", _Y, "orders_view")
_RHO_T = "(rho * sqrt((n - 2) / (1 - rho * rho)))"
ORACLE["agreement_footer"] = with_views(
    "orders_view",
    f"""WITH a AS ({_AGREE}), r AS ({_RHO})
    SELECT CAST(total_flags AS VARCHAR) AS total_flags, CAST(records AS VARCHAR) AS records,
      CAST(round_even(share_pct, 2) AS VARCHAR) AS share_pct, CAST(positives AS VARCHAR) AS positives,
      CAST(round_even(rate_pct, 2) AS VARCHAR) AS rate_pct FROM a
    UNION ALL SELECT 'Spearman', '', '', CAST(round_even(rho, 4) AS VARCHAR),
      CAST(CAST(round_even({t_two_sided(_RHO_T, '(n - 2)')}, 4) AS DOUBLE) + 0.0 AS VARCHAR) FROM r""",
)
ORACLE["spearman"] = with_views("orders_view", f"WITH r AS ({_RHO}) SELECT n, round(rho, 9) AS rho FROM r")
ORACLE["spearman_continuous"] = (
    f"WITH r AS ({_spearman('l_extendedprice', 'l_quantity', 'lineitem')}) SELECT n, round(rho, 9) AS rho FROM r"
)


def _rank_sums(scores, source: str = "orders_view") -> str:
    long = union(f"SELECT '{s}' AS score, CAST({s} AS DOUBLE) AS v, {_Y} AS y FROM {source} WHERE {s} IS NOT NULL" for s in scores)
    return f"""ls AS MATERIALIZED ({long}),
    ranked AS (SELECT *, rank() OVER (PARTITION BY score ORDER BY v) + (count(*) OVER (PARTITION BY score, v) - 1) / 2.0 AS r FROM ls),
    ties AS (SELECT score, CAST(sum(pow(t, 3) - t) AS DOUBLE) AS tie FROM (SELECT score, v, CAST(count(*) AS DOUBLE) AS t FROM ls GROUP BY score, v) GROUP BY score),
    sums AS (SELECT score, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg,
      CAST(sum(CASE WHEN y = 1 THEN r ELSE 0 END) AS DOUBLE) AS r1 FROM ranked GROUP BY score),
    u AS MATERIALIZED (SELECT score, n_pos, n_neg, r1 - CAST(n_pos AS DOUBLE) * (n_pos + 1) / 2 AS u, tie,
      CAST(n_pos AS DOUBLE) AS a, CAST(n_neg AS DOUBLE) AS b, CAST(n_pos + n_neg AS DOUBLE) AS n FROM sums JOIN ties USING (score) WHERE n_pos > 0 AND n_neg > 0)"""


_Z = "((u - a * b / 2 - 0.5) / sqrt(a * b / 12 * ((n + 1) - tie / (n * (n - 1)))))"
ORACLE["auroc"] = with_views(
    "orders_view",
    f"WITH {_rank_sums(SCORES)} SELECT score, n_pos, n_neg, round(u / (a * b), 9) AS auroc FROM u",
)
ORACLE["auroc_continuous"] = with_views(
    "orders_view",
    f"WITH {_rank_sums(['o_totalprice'])} SELECT score, n_pos, n_neg, round(u / (a * b), 9) AS auroc FROM u",
)
ORACLE["mann_whitney"] = with_views(
    "orders_view",
    f"""WITH {_rank_sums(SCORES)}, z AS MATERIALIZED (SELECT *, {_Z} AS z FROM u)
    SELECT score, n_pos, n_neg, u, round(z, 6) AS z, round({normal_upper('z')}, 6) AS p_value FROM z""",
)
_SIDE = ", ".join(
    f"count(*) FILTER (y = {c}) AS n_{s}, round(avg(v) FILTER (y = {c}), 9) AS mean_{s}, "
    f"CAST(median(v) FILTER (y = {c}) AS DOUBLE) AS median_{s}, round(stddev_samp(v) FILTER (y = {c}), 9) AS std_{s}"
    for c, s in ((0, "neg"), (1, "pos"))
)
ORACLE["score_distribution"] = with_views(
    "orders_view",
    f"""WITH {_rank_sums(SCORES)}, d AS (SELECT score, {_SIDE} FROM ls GROUP BY score),
    z AS MATERIALIZED (SELECT *, {_Z} AS z FROM u)
    SELECT d.*, round(z.u / (a * b), 9) AS auroc, round({normal_upper('z')}, 6) AS p_value FROM d JOIN z USING (score)""",
)


def _histogram(score: str, source: str) -> str:
    value = _number(f"CAST({score} AS VARCHAR)")
    return f"""(SELECT CAST(i AS INT) AS bucket, count(s) AS records, round(avg(y) * 100.0, 9) AS rate_pct
      FROM range(0, 11) r(i) LEFT JOIN (SELECT CAST({_Y} AS DOUBLE) AS y,
        CASE WHEN {value} IS NOT NULL THEN greatest(0, least(10, round_even({value}, 0))) END AS s FROM {source}) ON s = i GROUP BY i)"""


ORACLE["score_histogram"] = with_views(
    "orders_raw", f"SELECT bucket, records FROM {_histogram('risk_score_all', 'orders_raw')}"
)
ORACLE["rate_by_score"] = with_views(
    "orders_raw", f"SELECT bucket, rate_pct FROM {_histogram('risk_score_all', 'orders_raw')}"
)
_PAIR = union(
    f"SELECT '{s}' AS score, bucket, records, round(rate_pct, 6) AS rate_pct FROM {_histogram(s, 'orders_view')}"
    for s in (fixed.SINGLE_SCORE, "risk_score_all")
)
ORACLE["score_histogram_pair"] = with_views(
    "orders_view",
    f"""WITH h AS MATERIALIZED ({_PAIR}) SELECT *,
    round(CAST((SELECT max(records) FROM h) AS DOUBLE) * CAST(1.08 AS DOUBLE), 6) AS axis_max FROM h""",
)

# --- splits and metrics -------------------------------------------------------


def _quotas(source: str, label: str) -> str:
    return f"""sizes AS (SELECT {label} AS c, count(*) AS n FROM {source} GROUP BY 1),
    exact AS (SELECT c, ceil(0.2::DOUBLE * sum(n) OVER ()) AS wanted, ceil(0.2::DOUBLE * sum(n) OVER ()) * n / sum(n) OVER () AS x FROM sizes),
    quotas AS MATERIALIZED (SELECT c, floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, c) <= wanted - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS quota FROM exact)"""


ORACLE["stratified_split"] = with_views(
    "orders_view",
    f"""WITH {_quotas('orders_view', _Y)}
    SELECT o_orderkey, {_Y}, row_number() OVER (PARTITION BY {_Y} ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':7'), o_orderkey) <= quota AS is_test
    FROM orders_view JOIN quotas ON c = {_Y}""",
)
ORACLE["monte_carlo_splits"] = with_views(
    "orders_view",
    f"""WITH {_quotas('orders_view', _Y)}, drawn AS (
      SELECT CAST(seed AS INT) AS seed, o_orderkey, {_Y}, row_number() OVER (PARTITION BY seed, {_Y} ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':' || CAST(seed AS VARCHAR)), o_orderkey) <= quota AS is_test
      FROM orders_view JOIN quotas ON c = {_Y}, range(1, 51) s(seed))
    SELECT seed, {_Y}, count(*) FILTER (is_test) AS n_test, count(*) FILTER (NOT is_test) AS n_train,
      CAST(sum(o_orderkey) FILTER (is_test) AS BIGINT) AS test_key_sum FROM drawn GROUP BY seed, {_Y}""",
)
ORACLE["classification_metrics"] = with_views(
    "orders_view",
    f"""WITH p AS (SELECT o_orderstatus, {_Y} AS y, greatest(flag4_anon_employer, flag1_sensitive_info) AS p FROM orders_view),
    c AS (SELECT o_orderstatus, count(*) AS n, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp,
      count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn FROM p GROUP BY 1)
    SELECT *, CAST(tp + tn AS DOUBLE) / n AS accuracy, COALESCE(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall,
      COALESCE(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c""",
)


def _average_precision(score: str, part: str) -> str:
    group, by = (f"{part},", f"PARTITION BY {part}") if part else ("", "")
    return f"""steps AS (SELECT {group} {score} AS s, count(*) FILTER ({_Y} = 1) AS h, count(*) AS t FROM orders_view WHERE {score} IS NOT NULL GROUP BY ALL),
    curve AS (SELECT *, CAST(sum(h) OVER w AS DOUBLE) / sum(t) OVER w AS precision FROM steps WINDOW w AS ({by} ORDER BY s DESC)),
    ap AS (SELECT {group} CAST(sum(h) AS BIGINT) AS positives, COALESCE(sum(h * precision) / nullif(sum(h), 0), 0) AS ap FROM curve {'GROUP BY ' + part if part else ''})
    SELECT {group} positives, round(ap, 9) AS average_precision FROM ap"""


ORACLE["average_precision"] = with_views(
    "orders_view", "WITH " + _average_precision("risk_score_all", "o_orderstatus")
)
ORACLE["average_precision_continuous"] = with_views(
    "orders_view", "WITH " + _average_precision("o_totalprice", "")
)

# --- results and paired comparison --------------------------------------------

_LONG = "rl AS MATERIALIZED (" + union(
    f"SELECT random_state, model, grp, '{m}' AS metric, {m} AS value FROM results" for m in fixed.METRICS
) + ")"
ORACLE["results_wide"] = with_views(
    "results",
    "SELECT random_state, "
    + ", ".join(
        f"max(CASE WHEN model = '{m}' AND grp = '{g}' THEN {k} END) AS {m}_{g}_{k}"
        for m in RESULT_MODELS for g in RESULT_GROUPS for k in fixed.METRICS
    )
    + " FROM results GROUP BY 1",
)
ORACLE["results_long"] = with_views("results", f"WITH {_LONG} SELECT * FROM rl")
_MODEL = " ".join(f"WHEN '{k}' THEN '{n}'" for k, n in fixed.MODEL_FILES.items())
ORACLE["summary_means"] = with_views(
    "results",
    f"SELECT CASE model {_MODEL} END AS model, grp, "
    + ", ".join(f"round(avg({m}), 6) AS {m}" for m in fixed.METRICS)
    + " FROM results GROUP BY 1, 2",
)
_PAIRS = _LONG + ", pr AS MATERIALIZED (" + union(
    f"SELECT a.model, '{name}' AS comparison, '{ga}' AS group_a, '{gb}' AS group_b, a.metric, a.random_state, a.value AS a, b.value AS b "
    f"FROM rl a JOIN rl b USING (model, metric, random_state) WHERE a.grp = '{ga}' AND b.grp = '{gb}'"
    for ga, gb, name in fixed.COMPARED_PAIRS
) + """),
mo AS MATERIALIZED (SELECT model, comparison, group_a, group_b, metric, count(*) AS n_iters, avg(a) AS mean_a, avg(b) AS mean_b,
  avg(b - a) AS mean_diff, stddev_samp(b - a) AS sd_diff FROM pr GROUP BY ALL),
tt AS MATERIALIZED (SELECT *, mean_diff / nullif(sd_diff / sqrt(n_iters), 0) AS t FROM mo),
pv AS MATERIALIZED (SELECT *, """ + t_two_sided("t", "(n_iters - 1)") + " AS p FROM tt)"
ORACLE["pair_groups"] = with_views("results", f"WITH {_PAIRS} SELECT * FROM pr")
ORACLE["paired_t"] = with_views(
    "results",
    f"""WITH {_PAIRS} SELECT model, comparison, group_a, group_b, metric, n_iters, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b,
    round(mean_diff, 6) AS mean_diff, round(sd_diff, 6) AS sd_diff, round(t, 6) AS t_statistic, round(p, 6) AS p_value FROM pv""",
)
ORACLE["cohens_d"] = with_views(
    "results",
    f"""WITH {_PAIRS} SELECT model, comparison, group_a, group_b, metric,
    round(CASE WHEN sd_diff > 0 THEN mean_diff / sd_diff ELSE 0 END, 6) AS cohens_d FROM mo""",
)
# Student's 97.5 % point by its expansion around the normal point.
_Q = "1.959963984540054::DOUBLE"
_T975 = f"""({_Q} + (pow({_Q},3) + {_Q}) / (4*v) + (5*pow({_Q},5) + 16*pow({_Q},3) + 3*{_Q}) / (96*pow(v,2))
  + (3*pow({_Q},7) + 19*pow({_Q},5) + 17*pow({_Q},3) - 15*{_Q}) / (384*pow(v,3))
  + (79*pow({_Q},9) + 776*pow({_Q},7) + 1482*pow({_Q},5) - 1920*pow({_Q},3) - 945*{_Q}) / (92160*pow(v,4)))"""
ORACLE["paired_ci"] = with_views(
    "results",
    f"""WITH {_PAIRS}, q AS (SELECT *, {_T975} * sd_diff / sqrt(n_iters) AS margin FROM (SELECT *, CAST(n_iters - 1 AS DOUBLE) AS v FROM mo))
    SELECT model, comparison, group_a, group_b, metric, round(mean_diff - margin, 6) AS ci_95_lower, round(mean_diff + margin, 6) AS ci_95_upper FROM q""",
)
ORACLE["significance_counts"] = with_views(
    "results",
    f"""WITH {_PAIRS} SELECT comparison, count(*) FILTER (p < 0.05) AS significant, count(*) AS total,
    CAST(round_even(CAST(count(*) FILTER (p < 0.05) AS DOUBLE) / count(*) * 100.0, 1) AS DOUBLE) AS pct FROM pv GROUP BY 1""",
)
ORACLE["model_significance"] = with_views(
    "results",
    f"WITH {_PAIRS} SELECT model, count(*) FILTER (p < 0.05) AS significant, count(*) AS total FROM pv GROUP BY 1",
)

# --- review sample and agreement ----------------------------------------------


def greedy_ctes(source: str, key: str, flags: list[str], n_total: int = 50, target: int = 6) -> str:
    """The greedy rounds, one block of CTEs per flag; `sel{n}` is the result."""
    long = union(
        f"SELECT {key} AS k, '{f}' AS f, {i} AS place, {f} AS v FROM {source}" for i, f in enumerate(flags)
    )
    out = [
        f"g AS MATERIALIZED ({long})",
        "turn AS MATERIALIZED (SELECT f, row_number() OVER (ORDER BY sum(v), min(place)) AS r FROM g GROUP BY f)",
        "sel0 AS (SELECT CAST(0 AS BIGINT) AS k WHERE false)",
    ]
    for r in range(1, len(flags) + 1):
        out += [
            f"cov{r} AS MATERIALIZED (SELECT f, COALESCE(sum(v) FILTER (k IN (SELECT k FROM sel{r - 1})), 0) AS c FROM g GROUP BY f)",
            f"cand{r} AS (SELECT g.k, sum(CASE WHEN c < {target} THEN v ELSE 0 END) AS s FROM g JOIN cov{r} USING (f) "
            f"WHERE g.k IN (SELECT k FROM g JOIN turn USING (f) WHERE r = {r} AND v = 1) AND g.k NOT IN (SELECT k FROM sel{r - 1}) GROUP BY g.k)",
            f"sel{r} AS MATERIALIZED (SELECT k FROM sel{r - 1} UNION ALL SELECT k FROM (SELECT k, row_number() OVER (ORDER BY s DESC, k) AS rn FROM cand{r}) "
            f"WHERE rn <= least({target} - (SELECT c FROM cov{r} JOIN turn USING (f) WHERE r = {r}), {n_total} - (SELECT count(*) FROM sel{r - 1})))",
        ]
    return ", ".join(out)


def fill_ctes(source: str, key: str, chosen: str, n_total: int = 50, seed: int = 42) -> str:
    """`filled`: the chosen keys plus the random fill."""
    return f"""pool AS MATERIALIZED (SELECT {key} AS k, {_Y} AS y, md5(CAST({key} AS VARCHAR) || ':{seed}') AS d FROM {source} WHERE {key} NOT IN (SELECT k FROM {chosen})),
    rest AS (SELECT {n_total} - count(*) AS r FROM {chosen}),
    pos AS MATERIALIZED (SELECT k FROM (SELECT k, row_number() OVER (ORDER BY d, k) AS rn FROM pool WHERE y = 1) WHERE rn <= (SELECT r // 2 FROM rest)),
    neg AS MATERIALIZED (SELECT k FROM (SELECT k, row_number() OVER (ORDER BY d, k) AS rn FROM pool WHERE y = 0) WHERE rn <= (SELECT r FROM rest) - (SELECT count(*) FROM pos)),
    both_ AS MATERIALIZED (SELECT k FROM pos UNION ALL SELECT k FROM neg),
    extra AS (SELECT k FROM (SELECT k, row_number() OVER (ORDER BY d, k) AS rn FROM pool WHERE k NOT IN (SELECT k FROM both_)) WHERE rn <= (SELECT r FROM rest) - (SELECT count(*) FROM both_)),
    filled AS MATERIALIZED (SELECT k FROM {chosen} UNION ALL SELECT k FROM both_ UNION ALL SELECT k FROM extra)"""


ORACLE["flag_rarity"] = with_views(
    "orders_view", f"WITH {_LONG_FLAGS} SELECT flag, CAST(sum(v) AS BIGINT) AS positives FROM long GROUP BY flag"
)
_GREEDY = greedy_ctes("orders_view", "o_orderkey", FLAGS)
_LAST = f"sel{len(FLAGS)}"
ORACLE["greedy_coverage"] = with_views("orders_view", f"WITH {_GREEDY} SELECT k AS o_orderkey FROM {_LAST}")
ORACLE["fill_stratified"] = with_views(
    "orders_view",
    f"""WITH {_GREEDY}, {fill_ctes('orders_view', 'o_orderkey', _LAST)}
    SELECT o_orderkey, {_Y} FROM orders_view WHERE o_orderkey IN (SELECT k FROM filled)""",
)
_POSTING_SAMPLE = f"""{_RULE_FLAGS},
  {greedy_ctes('fp', 'job_id', ['flag1_sensitive_info', 'flag7_vague_info'])}, {fill_ctes('fp', 'job_id', 'sel2')},
  sample AS (SELECT *, CAST(row_number() OVER (ORDER BY job_id) AS INT) AS sample_id FROM fp WHERE job_id IN (SELECT k FROM filled))"""
ORACLE["review_sheet"] = with_views(
    "postings",
    f"WITH {_POSTING_SAMPLE} SELECT "
    + ", ".join([*fixed.REVIEW_COLUMNS, *[f"'' AS {c}" for c in fixed.MANUAL_FLAGS]])
    + " FROM sample",
)
ORACLE["reference_sheet"] = with_views(
    "postings",
    f"WITH {_POSTING_SAMPLE} SELECT sample_id, job_id, flag1_sensitive_info, flag7_vague_info, risk_score_all, single_pass_risk_score, {_Y} FROM sample",
)
ORACLE["coverage_report"] = with_views(
    "orders_view",
    f"""WITH {_GREEDY}, cv AS (SELECT f AS flag, CAST(sum(v) AS BIGINT) AS positives FROM g WHERE k IN (SELECT k FROM {_LAST}) GROUP BY f)
    SELECT flag, positives, CAST(positives AS DOUBLE) / (SELECT count(*) FROM {_LAST}) * 100.0 AS share_pct,
    CASE WHEN positives >= 6 THEN 'OK' ELSE 'short by ' || CAST(6 - positives AS VARCHAR) END AS status FROM cv""",
)
ORACLE["sample_composition"] = with_views(
    "orders_view",
    f"""SELECT CASE {_Y} WHEN 1 THEN 'positive' ELSE 'negative' END AS part, count(*) AS records,
    CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM orders_view) * 100.0 AS share_pct FROM orders_view GROUP BY 1""",
)
ORACLE["flag_count_distribution"] = with_views(
    "orders_view", f"SELECT CAST({TOTAL} AS BIGINT) AS total_flags, count(*) AS records FROM orders_view GROUP BY 1"
)
_MATCHED = "mt AS MATERIALIZED (" + union(
    f"SELECT o.o_orderkey AS sample_id, o.o_custkey AS job_id, '{f}' AS flag, '{fixed.FLAG_LABELS[f]}' AS label, {f} AS ai, "
    f"TRY_CAST(manual_{f} AS DOUBLE) AS human FROM orders_view o JOIN review r ON CAST(o.o_orderkey AS VARCHAR) = r.sample_id "
    f"WHERE TRY_CAST(manual_{f} AS DOUBLE) IN (0, 1)"
    for f in FLAGS
) + """), cm AS (SELECT flag, count(*) FILTER (ai = 1 AND human = 1) AS tp, count(*) FILTER (ai = 0 AND human = 0) AS tn,
  count(*) FILTER (ai = 1 AND human = 0) AS fp, count(*) FILTER (ai = 0 AND human = 1) AS fn, CAST(count(*) AS DOUBLE) AS n FROM mt GROUP BY flag),
df AS MATERIALIZED (SELECT sample_id, job_id, label AS flag, ai AS ai_label, CAST(human AS INT) AS human_label,
  CASE WHEN ai = 1 THEN 'AI flagged, human did not (FP)' ELSE 'Human flagged, AI did not (FN)' END AS type FROM mt WHERE ai <> human)"""
ORACLE["valid_sample_rows"] = with_views(
    "review",
    "SELECT CAST(sample_id AS BIGINT) AS sample_id, manual_flag4_anon_employer FROM review WHERE sample_id <> 'Total'",
)
ORACLE["confusion_by_flag"] = with_views(
    "review",
    f"""WITH {_MATCHED} SELECT flag, tp, tn, fp, fn, tp + tn + fp + fn AS n_compared, tp + fp AS ai_positive,
    tp + fn AS human_positive, CAST(tp + tn AS DOUBLE) / n * 100.0 AS agreement_pct FROM cm""",
)
ORACLE["cohens_kappa"] = with_views(
    "review",
    f"""WITH {_MATCHED}, k AS (SELECT flag, (tp + tn) / n AS po, (tp + fp) / n * ((tp + fn) / n) + (tn + fn) / n * ((tn + fp) / n) AS pe FROM cm)
    SELECT flag, round(CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 9) AS kappa FROM k""",
)
ORACLE["disagreements"] = with_views("review", f"WITH {_MATCHED} SELECT * FROM df")
ORACLE["disagreement_counts"] = with_views(
    "review", f"WITH {_MATCHED} SELECT type, count(*) AS records FROM df GROUP BY 1"
)

# --- text, number and category features ---------------------------------------

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_WORDS = (
    f"list_filter(regexp_extract_all(lower({_TEXT}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOP}))"
)


def _tokens(source: str) -> str:
    return f"tk AS MATERIALIZED (SELECT job_id, {_WORDS} AS ws FROM {source})"


def _vocab(source: str) -> str:
    return _tokens(source) + f""",
    occ AS MATERIALIZED (SELECT job_id, term, count(*) AS tf FROM (SELECT job_id, unnest(ws) AS term FROM tk) GROUP BY 1, 2),
    freq AS (SELECT term, count(*) AS df, sum(tf) AS tf FROM occ GROUP BY term),
    nd AS MATERIALIZED (SELECT count(*) AS n FROM {source}),
    top AS (SELECT *, row_number() OVER (ORDER BY tf DESC, term) AS place FROM freq WHERE df >= 5 AND df <= 0.9 * (SELECT n FROM nd)),
    vocab AS MATERIALIZED (SELECT term, df, CAST(tf AS BIGINT) AS tf, row_number() OVER (ORDER BY term) - 1 AS idx FROM top WHERE place <= 5000),
    wt AS MATERIALIZED (SELECT job_id, term, occ.tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM occ JOIN vocab USING (term), nd),
    tfidf AS MATERIALIZED (SELECT job_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY job_id)) AS weight FROM wt)"""


ORACLE["tokenize"] = with_views(
    "postings",
    f"WITH {_tokens('postings')} SELECT job_id, array_to_string(ws, ' ') AS tokens, CAST(len(ws) AS BIGINT) AS n_tokens FROM tk",
)
ORACLE["tfidf_vocab"] = with_views("postings", f"WITH {_vocab('postings')} SELECT term, df, tf, idx FROM vocab")
ORACLE["tfidf_sparse"] = with_views(
    "postings", f"WITH {_vocab('postings')} SELECT job_id, term, round(weight, 6) AS weight FROM tfidf"
)

def _leading(steps: int) -> str:
    """Power iteration on the weights: `axis` is the leading right singular vector."""
    out = ["v0 AS MATERIALIZED (SELECT term, CAST(1 AS DOUBLE) AS a FROM vocab)"]
    for i in range(1, steps + 1):
        out.append(
            f"v{i} AS MATERIALIZED (SELECT term, a / sqrt(sum(a * a) OVER ()) AS a FROM (SELECT t.term, sum(t.weight * u.d) AS a "
            f"FROM tfidf t JOIN (SELECT job_id, sum(weight * a) AS d FROM tfidf JOIN v{i - 1} USING (term) GROUP BY job_id) u USING (job_id) GROUP BY t.term))"
        )
    return ", ".join([*out, f"axis AS MATERIALIZED (SELECT * FROM v{steps})"])


# Every dense vector has unit length unless the record has no vocabulary word.
ORACLE["tfidf_svd"] = with_views(
    "postings",
    f"""WITH {_vocab('postings')}, {_leading(40)},
    along AS MATERIALIZED (SELECT job_id, sum(weight * a) AS d FROM tfidf JOIN axis USING (term) GROUP BY job_id),
    lead AS (SELECT sqrt(sum(d * d)) AS s FROM along)
    SELECT p.job_id, least(300, (SELECT count(*) FROM vocab) - 1) AS components,
    CASE WHEN d IS NOT NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS length,
    round(COALESCE(abs(d), 0), 4) AS leading_weight, round((SELECT s FROM lead), 4) AS leading_value
    FROM postings p LEFT JOIN along ON p.job_id = along.job_id""",
)
_IMPUTED = ", ".join(f"COALESCE({c}, median({c}) OVER ()) AS {c}" for c in fixed.NUMBER_COLUMNS)
ORACLE["median_impute"] = with_views(
    "salary", f"WITH {_SALARY} SELECT o_orderkey, {_IMPUTED} FROM parsed"
)
ORACLE["standardize"] = with_views(
    "salary",
    f"WITH {_SALARY}, im AS (SELECT o_orderkey, {_IMPUTED} FROM parsed) SELECT o_orderkey, "
    + ", ".join(
        f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in fixed.NUMBER_COLUMNS
    )
    + " FROM im",
)


def _mode(c: str) -> str:
    return f"(SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM b WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)"


_BOOL = "b AS MATERIALIZED (SELECT *, CASE WHEN salary_range IS NULL THEN 1 ELSE 0 END AS salary_range_missing FROM {source})"
ORACLE["mode_impute"] = with_views(
    "postings",
    f"WITH {_BOOL.format(source='postings')} SELECT job_id, "
    + ", ".join(f"COALESCE({c}, {_mode(c)}) AS {c}" for c in fixed.BOOLEAN_COLUMNS)
    + " FROM b",
)


def _categories(source: str) -> str:
    """`learned`: kept tokens; `bucketed`: (job_id, col, multi, tokens)."""
    edu = f"CASE required_education {_EDU} ELSE required_education END"
    long = union(
        f"SELECT job_id, '{c}' AS col, CAST({edu if c == 'required_education' else c} AS VARCHAR) AS v FROM {source}"
        for c in fixed.CATEGORY_COLUMNS
    )
    return f"""cl AS MATERIALIZED ({long}),
    firsts AS (SELECT col, v, row_number() OVER (PARTITION BY col ORDER BY job_id) AS r FROM cl WHERE v IS NOT NULL),
    kind AS MATERIALIZED (SELECT col, COALESCE(bool_or(contains(f.v, ',')) FILTER (r <= 100), false) AS multi FROM (SELECT DISTINCT col FROM cl) LEFT JOIN firsts f USING (col) GROUP BY col),
    tok AS MATERIALIZED (SELECT job_id, col, multi, CASE WHEN multi THEN {label_list('v')} ELSE [COALESCE(v, '{fixed.MISSING}')] END AS ts FROM cl JOIN kind USING (col)),
    freqs AS (SELECT col, token, any_value(multi) AS multi, count(*) AS n FROM (SELECT col, multi, unnest(ts) AS token FROM tok) GROUP BY 1, 2),
    ranked_tokens AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, token) AS r FROM freqs WHERE NOT multi OR n >= 2),
    learned AS MATERIALIZED (SELECT col, token FROM ranked_tokens WHERE r <= 10 UNION SELECT col, '{fixed.MISSING}' FROM kind),
    kept AS MATERIALIZED (SELECT col, list(token) AS ks FROM learned GROUP BY col),
    bucketed AS MATERIALIZED (SELECT job_id, col, multi, CASE WHEN multi
        THEN CASE WHEN len(list_filter(ts, lambda t: list_contains(ks, t))) = 0 THEN ['{fixed.MISSING}'] ELSE list_filter(ts, lambda t: list_contains(ks, t)) END
        ELSE list_transform(ts, lambda t: CASE WHEN list_contains(ks, t) THEN t ELSE '{fixed.OTHER}' END) END AS ts FROM tok JOIN kept USING (col)),
    onehot AS MATERIALIZED (SELECT DISTINCT job_id, col, unnest(ts) AS token FROM bucketed)"""


_CATS = _categories("postings")
ORACLE["detect_multilabel"] = with_views(
    "postings",
    f"WITH {_CATS.replace('CASE required_education ' + _EDU + ' ELSE required_education END', 'required_education')} SELECT col, multi AS is_multilabel FROM kind",
)
ORACLE["learn_categories"] = with_views("postings", f"WITH {_CATS} SELECT col, token FROM learned")
ORACLE["onehot_topk"] = with_views("postings", f"WITH {_CATS} SELECT job_id, col, token FROM onehot")
_SINGLE_COLUMNS = [c for c in fixed.CATEGORY_COLUMNS if c != "industry"]
for _name, _columns in (("bucket_single", _SINGLE_COLUMNS), ("bucket_multi", ["industry"])):
    ORACLE[_name] = with_views(
        "postings",
        f"WITH {_CATS} SELECT job_id, "
        + ", ".join(f"max(array_to_string(ts, '|')) FILTER (col = '{c}') AS {c}" for c in _columns)
        + " FROM bucketed GROUP BY job_id",
    )

_LABELLED = f"lab AS MATERIALIZED (SELECT * FROM postings WHERE {_Y} IS NOT NULL)"
_MODEL_CTES = f"{_LABELLED}, {_vocab('lab')}, {_categories('lab')}"
ORACLE["feature_block_sizes"] = with_views(
    "postings",
    f"""WITH {_MODEL_CTES} SELECT 'text' AS block, count(*) AS size FROM vocab UNION ALL SELECT 'numbers', 2
    UNION ALL SELECT 'booleans', 4 UNION ALL SELECT 'categories', count(*) FROM (SELECT DISTINCT col, token FROM onehot)""",
)
# Salaries come from the posting's own column, filled over all postings.
_POSTING_SALARY = _SALARY.replace("o_orderkey", "job_id").replace("FROM salary", "FROM postings")
ORACLE["feature_vectors"] = with_views(
    "postings",
    f"""WITH {_POSTING_SALARY}, sf AS (SELECT job_id, COALESCE(salary_lower, avg(salary_lower) OVER ()) AS lo, COALESCE(salary_upper, avg(salary_upper) OVER ()) AS up FROM parsed),
    {_MODEL_CTES}, {_BOOL.format(source='lab')},
    num AS (SELECT job_id, (lo - avg(lo) OVER ()) / stddev_pop(lo) OVER () + (up - avg(up) OVER ()) / stddev_pop(up) OVER () AS s FROM sf WHERE job_id IN (SELECT job_id FROM lab)),
    bo AS (SELECT job_id, {' + '.join(f'COALESCE({c}, {_mode(c)})' for c in fixed.BOOLEAN_COLUMNS)} AS s FROM b),
    width AS (SELECT (SELECT count(*) FROM vocab) + 2 + 4 + (SELECT count(*) FROM (SELECT DISTINCT col, token FROM onehot)) AS w)
    SELECT lab.job_id, (SELECT w FROM width) AS width,
      round(COALESCE((SELECT sum(weight) FROM tfidf t WHERE t.job_id = lab.job_id), 0) + num.s + bo.s + (SELECT count(*) FROM onehot o WHERE o.job_id = lab.job_id), 4) AS total
    FROM lab JOIN num USING (job_id) JOIN bo USING (job_id)""",
)
ORACLE["embed_text"] = """
SELECT doc_id AS job_id, CAST(64 AS BIGINT) AS width,
  round(CAST(CAST(length(text) / CAST(1000 AS DOUBLE) AS FLOAT) AS DOUBLE), 6) AS first FROM documents"""
ORACLE["embedding_features"] = """
SELECT d.doc_id AS vec_id, d.source AS department, CAST(COALESCE(len(embedding), 64) AS BIGINT) AS width,
  round(COALESCE(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))),
    pow(CAST(CAST(length(text) / CAST(1000 AS DOUBLE) AS FLOAT) AS DOUBLE), 2)), 6) AS square
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id"""
_PRESENT = ["salary_lower", "salary_upper", "single_pass_risk_score", "risk_score_all"]
ORACLE["feature_groups"] = with_views(
    "postings",
    f"""WITH {_POSTING_SALARY} """
    + union(
        f"SELECT '{g}' AS grp, {i} AS place, '{c}' AS col, count({c}) AS filled FROM "
        + ("parsed" if c in fixed.NUMBER_COLUMNS else "postings")
        for g, cols in fixed.FEATURE_GROUPS.items() if set(cols) <= set(_PRESENT)
        for i, c in enumerate(cols)
    ),
)

# --- balancing ----------------------------------------------------------------


def _neighbors(where: str) -> str:
    return f"""vx AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {where}),
    nb AS MATERIALIZED (SELECT vec_id, rank, neighbor, distance FROM (
      SELECT a.vec_id, b.vec_id AS neighbor, list_distance(a.e, b.e) AS distance,
        CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS INT) AS rank
      FROM vx a JOIN vx b ON a.vec_id <> b.vec_id) WHERE rank <= 5)"""


ORACLE["smote_neighbors"] = (
    f"WITH {_neighbors('label = 0')} SELECT vec_id, rank, neighbor, round(distance, 6) AS distance FROM nb"
)
ORACLE["neighbor_index"] = (
    "SELECT count(*) AS n_queries, sum(least(5, (SELECT count(*) - 1 FROM embeddings)))::BIGINT AS neighbors, true AS enough"
    " FROM embeddings WHERE vec_id % 50 = 0"
)
ORACLE["nearest_neighbors"] = (
    f"WITH {_neighbors('true')} SELECT vec_id, rank, neighbor, round(distance, 6) AS distance FROM nb"
)
_SMOTE = f"""{_neighbors('label = 0')},
size AS MATERIALIZED (SELECT count(*) FILTER (label = 0) AS m, count(*) FILTER (label <> 0) AS big FROM embeddings),
syn AS (SELECT i AS synthetic_id, md5(CAST(i AS VARCHAR) || ':3') AS d FROM range(0, (SELECT big - m FROM size)) r(i)),
drawn AS (SELECT synthetic_id, CAST('0x' || substr(d, 1, 13) AS BIGINT) % (SELECT m * 5 FROM size) AS pick,
  CAST('0x' || substr(d, 14, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u FROM syn),
place AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM vx),
pairs AS MATERIALIZED (SELECT synthetic_id, place.vec_id AS base, neighbor, u FROM drawn JOIN place ON pos = pick // 5
  JOIN nb ON nb.vec_id = place.vec_id AND nb.rank = pick % 5 + 1)"""
ORACLE["smote"] = f"WITH {_SMOTE} SELECT synthetic_id, base, neighbor, round(u, 12) AS u FROM pairs"
ORACLE["smote_rows"] = f"""WITH {_SMOTE}
SELECT CASE WHEN label = 0 THEN 1 ELSE 0 END AS label, false AS is_synthetic, count(*) AS n,
  round(sum(list_sum(CAST(embedding AS DOUBLE[]))), 4) AS total FROM embeddings GROUP BY 1
UNION ALL SELECT 1, true, count(*), round(sum(list_sum(x.e) + u * (list_sum(y.e) - list_sum(x.e))), 4)
FROM pairs JOIN vx x ON x.vec_id = base JOIN vx y ON y.vec_id = neighbor"""

# --- models: facts that SQL can derive without fitting ------------------------

_SPLIT = """vx AS (SELECT CASE WHEN label = 0 THEN 1 ELSE 0 END AS y FROM embeddings),
sizes AS (SELECT y, count(*) AS n FROM vx GROUP BY y),
quota AS (SELECT y, n, ceil(CAST(0.2 AS DOUBLE) * sum(n) OVER ()) AS wanted, ceil(CAST(0.2 AS DOUBLE) * sum(n) OVER ()) * n / sum(n) OVER () AS exact FROM sizes),
placed AS (SELECT *, row_number() OVER (ORDER BY floor(exact) - exact, y) AS r, wanted - sum(floor(exact)) OVER () AS rest FROM quota),
parts AS (SELECT y, n, floor(exact) + CASE WHEN r <= rest THEN 1 ELSE 0 END AS test FROM placed)"""


def _model_facts(*more: str) -> str:
    """Sizes from the quotas of the split; over-sampling makes both classes as large as the larger."""
    ones = [*[f"{m}_in_range" for m in fixed.METRICS], *more]
    return (
        f"WITH {_SPLIT} SELECT 'width' AS property, CAST(max(len(embedding)) AS DOUBLE) AS value FROM embeddings"
        " UNION ALL SELECT 'test_' || y, CAST(test AS DOUBLE) FROM parts"
        " UNION ALL SELECT 'train_' || y, CAST(max(n - test) OVER () AS DOUBLE) FROM parts"
        + "".join(f" UNION ALL SELECT '{name}', CAST(1 AS DOUBLE)" for name in ones)
    )


for _name in ("model_rf", "model_gbt", "model_mlp"):
    ORACLE[_name] = _model_facts("beats_constant")
for _name in ("model_lr", "model_enlr"):
    ORACLE[_name] = _model_facts("beats_constant", "gradient_vanishes")


def _grid(seeds: list[int], learners: list[str], groups: list[str]) -> str:
    """Every combination of the grid whose columns exist has all its metrics."""
    return (
        f"SELECT CAST(s AS BIGINT) AS random_state, m AS model, g AS grp, k AS metric, true AS in_range "
        f"FROM (SELECT unnest({seeds}) AS s), (SELECT unnest({learners}) AS m), (SELECT unnest({groups}) AS g), "
        f"(SELECT unnest({list(fixed.METRICS)}) AS k) WHERE (SELECT count(DISTINCT toxic) FROM labels) = 2"
    )


ORACLE["model_embedding_mlp"] = _grid([1], ["bert_mlp"], ["base"])
ORACLE["evaluate_grid"] = _grid([1, 2], ["lr"], ["base", "single_pass"])

# --- helpers ------------------------------------------------------------------

ORACLE["normalize_target"] = with_views("postings", f"SELECT job_id, {_Y} FROM postings")
ORACLE["ensure_columns"] = with_views(
    "postings", "SELECT job_id, title, CAST(NULL AS VARCHAR) AS posting_text, CAST(NULL AS DOUBLE) AS extra_score FROM postings"
)
ORACLE["keep_columns"] = with_views("postings", "SELECT job_id, location, title FROM postings")
ORACLE["missing_columns"] = with_views(
    "postings", "SELECT unnest(['absent', 'nowhere']) AS name, records FROM (SELECT count(*) AS records FROM postings)"
)
ORACLE["union_results"] = with_views("results", f"WITH {_LONG} SELECT * FROM rl")
