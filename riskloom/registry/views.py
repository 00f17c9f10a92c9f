"""Record tables for the registered queries, derived from the given tables.

Each view is one SELECT that both engines understand: `spark.sql` runs it with
the Parquet tables bound to the placeholders, the oracle uses the same text as
a common table expression. Only inputs are shared; what the operators compute
is written separately on each side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom import fixed

ORDERS_BASE = """
SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_orderpriority, o.o_totalprice,
       CASE WHEN o.o_orderstatus = 'F' AND o.o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS fraudulent_agent,
       COALESCE(li.line_count, 0) AS line_count, COALESCE(li.max_quantity, 0) AS max_quantity,
       COALESCE(li.returned, 0) AS returned
FROM {orders} o LEFT JOIN (
  SELECT l_orderkey, COUNT(*) AS line_count, MAX(l_quantity) AS max_quantity,
         SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned
  FROM {lineitem} GROUP BY l_orderkey) li ON o.o_orderkey = li.l_orderkey
"""

ORDERS_FLAGS = """
SELECT b.*,
  CASE WHEN o_orderkey % 400 = 0 THEN 1 ELSE 0 END AS flag1_sensitive_info,
  CASE WHEN line_count >= 7 THEN 1 ELSE 0 END AS flag2_unrealistic_comp,
  CASE WHEN max_quantity >= 49 THEN 1 ELSE 0 END AS flag3_pressure_tactics,
  CASE WHEN returned >= 3 OR (fraudulent_agent = 1 AND o_custkey % 2 = 0) THEN 1 ELSE 0 END AS flag4_anon_employer,
  CASE WHEN o_custkey % 5 = 0 OR (fraudulent_agent = 1 AND o_custkey % 3 = 0) THEN 1 ELSE 0 END AS flag5_req_role_mismatch,
  CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS flag6_info_conflict,
  CASE WHEN (o_orderkey * 7) % 20 < 17 THEN 1 ELSE 0 END AS flag7_vague_info,
  0 AS flag8_promo_template
FROM ({base}) b
"""

ORDERS_VIEW = """
SELECT f.*,
  CASE WHEN o_orderkey % 997 <> 0 THEN CAST(LEAST(10, 2 * (flag1_sensitive_info + flag2_unrealistic_comp + flag3_pressure_tactics + flag4_anon_employer + flag5_req_role_mismatch) + o_custkey % 3) AS INT) END AS risk_score_all,
  CASE WHEN o_orderkey % 997 <> 0 THEN CAST(LEAST(10, 3 * (flag1_sensitive_info + flag2_unrealistic_comp + flag4_anon_employer) + o_custkey % 4) AS INT) END AS risk_score_legit_context,
  CASE WHEN o_orderkey % 991 <> 0 THEN CAST(LEAST(10, 4 * (flag4_anon_employer + flag5_req_role_mismatch)) AS INT) END AS risk_score_context_consist,
  CAST(LEAST(10, 2 * (flag2_unrealistic_comp + flag3_pressure_tactics + flag5_req_role_mismatch) + o_custkey % 2) AS INT) AS risk_score_legit_consist,
  CAST(LEAST(10, o_custkey % 7 + 2 * fraudulent_agent) AS INT) AS single_pass_risk_score
FROM ({flags}) f
""".replace("{flags}", ORDERS_FLAGS.replace("{base}", ORDERS_BASE))

def _raw_flag(flag: str, i: int) -> str:
    """A flag as text in several spellings, by key."""
    text = f"CAST({flag} AS VARCHAR(9))"
    if flag == "flag7_vague_info":
        return f"CASE o_orderkey % 4 WHEN 0 THEN {text} WHEN 1 THEN 'nan' WHEN 2 THEN {text} || '.0' END AS {flag}"
    return (
        f"CASE (o_orderkey + {i}) % 5 WHEN 0 THEN {text} WHEN 1 THEN {text} || '.0' "
        f"WHEN 2 THEN ' ' || {text} || ' ' WHEN 3 THEN 'x' END AS {flag}"
    )


def _raw_score(score: str, i: int) -> str:
    """A score as text in several spellings, by key."""
    text = f"CAST({score} AS VARCHAR(9))"
    if score == "single_pass_risk_score":
        return f"CASE o_orderkey % 4 WHEN 0 THEN {text} WHEN 1 THEN 'nan' WHEN 2 THEN '' ELSE {text} || '.0' END AS {score}"
    return f"CASE (o_orderkey + {i}) % 3 WHEN 0 THEN {text} WHEN 1 THEN {text} || '.5' ELSE 'n/a' END AS {score}"


ORDERS_RAW = (
    "SELECT o_orderkey, fraudulent_agent,\n  "
    + ",\n  ".join([
        *[_raw_flag(f, i) for i, f in enumerate(fixed.FLAGS)],
        *[_raw_score(s, i) for i, s in enumerate(fixed.SCORES)],
    ])
    + "\nFROM {orders_view}"
)

POSTINGS_VIEW = """
SELECT d.doc_id AS job_id,
  d.source || ' / ' || d.lang AS title,
  CASE WHEN d.doc_id % 11 <> 0 THEN d.lang END AS location,
  d.source AS department,
  CASE d.doc_id % 6 WHEN 1 THEN '30000' WHEN 2 THEN CAST(d.n_chars AS VARCHAR(20)) || '-' || CAST(2 * d.n_chars AS VARCHAR(20))
       WHEN 3 THEN '50,000-60,000' WHEN 4 THEN '10-Nov' WHEN 5 THEN 'negotiable' END AS salary_range,
  CASE d.doc_id % 4 WHEN 0 THEN 'Full-time' WHEN 1 THEN 'Part-time' WHEN 2 THEN 'Contract' END AS employment_type,
  CASE d.doc_id % 13 WHEN 0 THEN 'Internship' WHEN 1 THEN 'Director' WHEN 2 THEN 'Associate' WHEN 3 THEN '' ELSE 'Entry level' END AS required_experience,
  CASE d.doc_id % 12 WHEN 0 THEN 'Bachelor''s Degree' WHEN 1 THEN 'Master''s Degree' WHEN 2 THEN 'High School or equivalent'
       WHEN 3 THEN 'Associate Degree' WHEN 4 THEN 'Doctorate' WHEN 5 THEN 'Certification' WHEN 6 THEN 'Professional'
       WHEN 7 THEN 'Some College Coursework Completed' WHEN 8 THEN 'Some High School Coursework' WHEN 9 THEN 'Unspecified'
       WHEN 10 THEN 'Vocational' END AS required_education,
  CASE d.doc_id % 7 WHEN 0 THEN 'Internet, Media' WHEN 1 THEN 'Media' WHEN 2 THEN ' Internet ,  , Telecom ' WHEN 3 THEN ' , '
       WHEN 4 THEN '' WHEN 5 THEN d.source || ', Media, ' || d.lang END AS industry,
  CASE d.doc_id % 3 WHEN 0 THEN 'Engineering' WHEN 1 THEN 'Sales' END AS function,
  CASE d.doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 1 END AS telecommuting,
  CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END AS has_company_logo,
  CASE WHEN d.doc_id % 9 <> 0 THEN CASE WHEN d.lang = 'en' THEN 1 ELSE 0 END END AS has_questions,
  CASE WHEN d.doc_id % 4 <> 3 THEN '  Published by ' || d.source || ' ' END AS company_profile,
  d.text AS description,
  CASE d.doc_id % 4 WHEN 0 THEN '   ' WHEN 1 THEN 'nan' WHEN 2 THEN 'Reads ' || d.lang END AS requirements,
  CASE d.doc_id % 3 WHEN 0 THEN 'None' WHEN 1 THEN 'Paid leave' END AS benefits,
  CAST(d.n_chars AS DOUBLE) AS qcew_avg_annual_pay,
  l.toxic AS fraudulent_agent,
  CAST(d.doc_id * 7 % 11 AS INT) AS risk_score_all,
  CAST(d.n_chars % 11 AS INT) AS single_pass_risk_score
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""

SALARY_VIEW = """
SELECT o_orderkey,
  CASE o_orderkey % 12 WHEN 1 THEN '' WHEN 2 THEN 'negotiable' WHEN 3 THEN CAST(30000 + o_custkey AS VARCHAR(20))
    WHEN 4 THEN CAST(50000 + o_custkey AS VARCHAR(20)) || '-' || CAST(60000 + o_orderkey AS VARCHAR(20))
    WHEN 5 THEN '50,000-60,000' WHEN 6 THEN '10-Nov' WHEN 7 THEN 'Oct-20' WHEN 8 THEN 'Market rate 500'
    WHEN 9 THEN ' 0-0 ' WHEN 10 THEN 'from 20 to 30 to 40' WHEN 11 THEN 'MAY 2013' END AS salary_range
FROM {orders}
"""

RESPONSES_VIEW = """
SELECT o_orderkey,
  CASE o_orderkey % 12
    WHEN 0 THEN '{{"flag1_sensitive_info": true, "flag2_unrealistic_comp": false, "risk_score": ' || CAST(o_custkey % 13 AS VARCHAR(9)) || '.5}}'
    WHEN 1 THEN '{{"flag1_sensitive_info": 1, "extra": true, "risk_score": 6.5}}'
    WHEN 2 THEN '{{"flag1_sensitive_info": null, "flag4_anon_employer": "false", "risk_score": null}}'
    WHEN 3 THEN '{{"flag2_unrealistic_comp": "", "flag3_pressure_tactics": [], "risk_score": 12}}'
    WHEN 4 THEN '{{"flag4_anon_employer": 0, "flag5_req_role_mismatch": 0.0, "flag6_info_conflict": {{}}, "risk_score": -3}}'
    WHEN 5 THEN 'not json'
    WHEN 6 THEN '{{"flag7_vague_info": "x", "risk_score": "8"}}'
    WHEN 7 THEN '{{"risk_score": "high"}}'
    WHEN 9 THEN '{{"flag8_promo_template": [0], "flag6_info_conflict": {{"a": 1}}, "risk_score": true}}'
    WHEN 10 THEN '{{"flag3_pressure_tactics": -0.5}}'
    WHEN 11 THEN '[1]' END AS response
FROM {orders}
"""

REVIEW_VIEW = (
    "SELECT CAST(o_orderkey AS VARCHAR(20)) AS sample_id"
    + "".join(
        f""",
  CASE WHEN (o_orderkey + {i}) % 29 = 0 THEN NULL WHEN (o_orderkey + {i}) % 31 = 0 THEN '2'
       WHEN (o_orderkey * 31 + {i} * 17) % 13 = 0 THEN CAST(1 - {flag} AS VARCHAR(9)) || '.0'
       ELSE CAST({flag} AS VARCHAR(9)) END AS manual_{flag}"""
        for i, flag in enumerate(fixed.FLAGS, start=1)
    )
    + "\nFROM {orders_view}\nUNION ALL SELECT 'Total'"
    + "".join(f", CAST(SUM({f}) AS VARCHAR(20))" for f in fixed.FLAGS)
    + " FROM {orders_view}"
)

# Event types stand for feature groups and users for random states; the group
# multi_agent_ls stays empty, as when its score column is missing.
RESULTS_VIEW = """
SELECT user_id AS random_state,
  CASE user_id % 3 WHEN 0 THEN 'lr' WHEN 1 THEN 'rf' ELSE 'bert_mlp' END AS model,
  CASE event_type WHEN 'error' THEN 'base' WHEN 'click' THEN 'single_pass' WHEN 'view' THEN 'multi_agent_all'
       WHEN 'signup' THEN 'multi_agent_lc' ELSE 'multi_agent_cc' END AS grp,
  CAST(SUM(CASE WHEN value >= 5 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS accuracy,
  CAST(SUM(CASE WHEN value >= 10 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS recall,
  CAST(SUM(CASE WHEN value >= 20 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS f1,
  CAST(SUM(CASE WHEN value < 2 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS pr_auc
FROM {events} GROUP BY user_id, event_type
"""

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class Views:
    """The given tables of one scale folder and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, text: str, **frames: DataFrame) -> DataFrame:
        bound = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **bound, **frames)

    def orders(self) -> DataFrame:
        return self._sql(ORDERS_VIEW)

    def orders_raw(self) -> DataFrame:
        return self._sql(ORDERS_RAW, orders_view=self.orders())

    def postings(self) -> DataFrame:
        return self._sql(POSTINGS_VIEW)

    def salary(self) -> DataFrame:
        return self._sql(SALARY_VIEW)

    def responses(self) -> DataFrame:
        return self._sql(RESPONSES_VIEW)

    def review(self) -> DataFrame:
        return self._sql(REVIEW_VIEW, orders_view=self.orders())

    def results(self) -> DataFrame:
        """Long form: random_state, model, grp, metric, value."""
        metrics = ["accuracy", "recall", "f1", "pr_auc"]
        return self._sql(RESULTS_VIEW).unpivot(
            ["random_state", "model", "grp"], metrics, "metric", "value"
        )

    def vectors(self) -> DataFrame:
        return self._sql(
            "SELECT vec_id, embedding, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label FROM {embeddings}"
        )
