"""Names, maps and bands the results depend on."""

# The label column and its accepted alias.
LABEL = "fraudulent_agent"
LABEL_ALIAS = "fraudulent"
KEY = "job_id"

# The eight flags, by id, with their display names.
FLAG_BY_ID = {
    1: "flag1_sensitive_info",
    2: "flag2_unrealistic_comp",
    3: "flag3_pressure_tactics",
    4: "flag4_anon_employer",
    5: "flag5_req_role_mismatch",
    6: "flag6_info_conflict",
    7: "flag7_vague_info",
    8: "flag8_promo_template",
}
FLAGS = list(FLAG_BY_ID.values())
FLAG_LABELS = {
    "flag1_sensitive_info": "Sensitive Information Request",
    "flag2_unrealistic_comp": "Unrealistic Compensation",
    "flag3_pressure_tactics": "Pressure Tactics",
    "flag4_anon_employer": "Unidentifiable Employer",
    "flag5_req_role_mismatch": "Requirements Role Mismatch",
    "flag6_info_conflict": "Internal Information Conflict",
    "flag7_vague_info": "Vague Information",
    "flag8_promo_template": "Promotional Template Substitution",
}

# Which agent owns which flags, and which agents a score sees.
AGENT_FLAG_IDS = {
    "legitimacy": [1, 2, 3, 7],
    "context": [4],
    "consistency": [5, 6, 8],
}
COMBO_AGENTS = {
    "all": ["legitimacy", "context", "consistency"],
    "legit_context": ["legitimacy", "context"],
    "context_consist": ["context", "consistency"],
    "legit_consist": ["legitimacy", "consistency"],
}

# Score columns.
COMBO_SCORE = {
    "all": "risk_score_all",
    "legit_context": "risk_score_legit_context",
    "context_consist": "risk_score_context_consist",
    "legit_consist": "risk_score_legit_consist",
}
SINGLE_SCORE = "single_pass_risk_score"
SCORES = [*COMBO_SCORE.values(), SINGLE_SCORE]

# Score bands (lowest score of the band, name).
SUBSET_BANDS = [
    (0, "very likely legitimate"),
    (2, "probably legitimate"),
    (4, "uncertain"),
    (6, "probably fraudulent"),
    (8, "likely fraudulent"),
    (10, "very likely fraudulent"),
]
SINGLE_PASS_BANDS = [
    (0, "definitely legitimate"),
    (1, "very likely legitimate"),
    (3, "more likely legitimate than not"),
    (5, "uncertain"),
    (6, "more likely fraudulent than not"),
    (8, "very likely fraudulent"),
    (10, "definitely fraudulent"),
]

# Order and labels of the rendered fields, and the cut length.
RENDER_FIELDS = [
    ("Title", "title"),
    ("Location", "location"),
    ("Department", "department"),
    ("Salary Range", "salary_range"),
    ("Employment Type", "employment_type"),
    ("Required Experience", "required_experience"),
    ("Required Education", "required_education"),
    ("Industry", "industry"),
    ("Function", "function"),
    ("Telecommuting", "telecommuting"),
    ("Has Company Logo", "has_company_logo"),
    ("Has Questions", "has_questions"),
    ("Company Profile", "company_profile"),
    ("Description", "description"),
    ("Requirements", "requirements"),
    ("Benefits", "benefits"),
    ("QCEW Annual Avg Employment", "qcew_annual_avg_emplvl"),
    ("QCEW Avg Annual Pay", "qcew_avg_annual_pay"),
    ("QCEW OTY Employment Change", "qcew_oty_annual_avg_emplvl_chg"),
    ("QCEW OTY Employment Pct Chg", "qcew_oty_annual_avg_emplvl_pct_chg"),
]
RENDER_CUT = 700

# Feature columns.
TEXT_COLUMNS = ["description", "requirements", "benefits", "company_profile"]
CATEGORY_COLUMNS = [
    "title", "location", "department", "employment_type",
    "required_experience", "required_education", "industry", "function",
]
BOOLEAN_COLUMNS = [
    "telecommuting", "has_company_logo", "has_questions", "salary_range_missing",
]
NUMBER_COLUMNS = ["salary_lower", "salary_upper"]
MISSING = "__MISSING__"
OTHER = "__OTHER__"

# Education names.
EDUCATION_MAP = {
    "Bachelor's Degree": "Bachelors",
    "Master's Degree": "Masters",
    "High School or equivalent": "High School",
    "Associate Degree": "Associate",
    "Doctorate": "Doctorate",
    "Certification": "Certification",
    "Professional": "Certification",
    "Some College Coursework Completed": "Some College",
    "Some High School Coursework": "Some HS",
    "Unspecified": "Unspecified",
}

# Month names, in the order they are looked for.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3,
    "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7,
    "aug": 8, "august": 8, "sep": 9, "september": 9, "oct": 10, "october": 10,
    "nov": 11, "november": 11, "dec": 12, "december": 12,
}

# Feature groups, metrics, models and the compared pairs.
FEATURE_GROUPS = {
    "base": NUMBER_COLUMNS,
    "single_pass": [*NUMBER_COLUMNS, "single_pass_risk_score"],
    "multi_agent_all": [*NUMBER_COLUMNS, "risk_score_all"],
    "multi_agent_lc": [*NUMBER_COLUMNS, "risk_score_legit_context"],
    "multi_agent_cc": [*NUMBER_COLUMNS, "risk_score_context_consist"],
    "multi_agent_ls": [*NUMBER_COLUMNS, "risk_score_legit_consist"],
}
METRICS = ["accuracy", "recall", "f1", "pr_auc"]
MODEL_FILES = {
    "lr": "LR", "enlr": "ENLR", "rf": "RF",
    "xgb": "XGBoost", "mlp": "MLP", "bert_mlp": "BERT_MLP",
}
COMPARED_PAIRS = [
    ("base", "single_pass", "base → single_pass"),
    ("base", "multi_agent_all", "base → multi_agent_all"),
    ("single_pass", "multi_agent_all", "single_pass → multi_agent_all"),
    ("multi_agent_lc", "multi_agent_all", "multi_agent_lc → multi_agent_all (ablation)"),
    ("multi_agent_cc", "multi_agent_all", "multi_agent_cc → multi_agent_all (ablation)"),
    ("multi_agent_ls", "multi_agent_all", "multi_agent_ls → multi_agent_all (ablation)"),
]

# The columns a reviewer sees, and the reference columns.
REVIEW_COLUMNS = [
    "sample_id", "job_id", "title", "location", "department", "salary_range",
    "employment_type", "required_experience", "required_education", "industry",
    "function", "telecommuting", "has_company_logo", "has_questions",
    "company_profile", "description", "requirements", "benefits",
    "qcew_avg_annual_pay",
]
MANUAL_FLAGS = [f"manual_{flag}" for flag in FLAGS]
REFERENCE_COLUMNS = [
    "sample_id", "job_id", *FLAGS, "risk_score_all", "single_pass_risk_score", LABEL,
]
FALSE_POSITIVE = "AI flagged, human did not (FP)"
FALSE_NEGATIVE = "Human flagged, AI did not (FN)"

# The characters Python's str.strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# How much each level of a flag definition's calibration weighs.
CALIBRATION_LEVELS = {
    "indicative_strength": {"strong": 3, "moderate": 2, "weak": 1},
    "frequency_in_fraud": {"common": 3, "occasional": 2, "rare": 1},
    "specificity_to_fraud": {"high": 3, "medium": 2, "low": 1},
    "false_positive_risk": {"low": 3, "medium": 2, "high": 1},
}
