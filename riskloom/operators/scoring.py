"""Flags and risk scores: rules, response parsing, weighting, overlay, progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom import fixed
from riskloom.functions.columns import add_up, band, number_text, score_0_10
from riskloom.functions.shipping import ship
from riskloom.operators.ordering import keys_at


def combo_flag_names(combo: str) -> list[str]:
    """Flag columns seen by a combination of agents, in flag order."""
    ids = [i for agent in fixed.COMBO_AGENTS[combo] for i in fixed.AGENT_FLAG_IDS[agent]]
    return [fixed.FLAG_BY_ID[i] for i in sorted(ids)]


def agent_flags(spark: SparkSession) -> DataFrame:
    rows = [
        (agent, i, fixed.FLAG_BY_ID[i])
        for agent, ids in fixed.AGENT_FLAG_IDS.items() for i in ids
    ]
    return spark.createDataFrame(rows, "agent string, flag_id int, flag string")


def combo_flags(spark: SparkSession) -> DataFrame:
    """Dimension of (combo, agent, flag_id, flag): 24 fixed rows."""
    rows = [(combo, agent) for combo, agents in fixed.COMBO_AGENTS.items() for agent in agents]
    combos = spark.createDataFrame(rows, "combo string, agent string")
    return combos.join(F.broadcast(agent_flags(spark)), "agent").select(
        "combo", "agent", "flag_id", "flag"
    )


def apply_flag_rules(df: DataFrame, rules: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Add one 0/1 column per rule: trigger holds and guard does not.

    Rules are SQL predicates {flag: (trigger, guard or None)}; null is false.
    """
    flags = {}
    for flag, (trigger, guard) in rules.items():
        fires = F.coalesce(F.expr(trigger), F.lit(False))
        if guard:
            fires = fires & ~F.coalesce(F.expr(guard), F.lit(False))
        flags[flag] = fires.cast("int")
    return df.withColumns(flags)


def _with_members(df: DataFrame, response: str, names: list[str]) -> DataFrame:
    """Add `_kind_<name>` and `_text_<name>` for top-level members of a JSON
    object. Each response is parsed once, in a projection of its own. The kind
    is null for an absent member, and `_object` is false without an object."""
    parsed = df.withColumn("_json", F.try_parse_json(response))
    members = {"_object": F.coalesce(F.schema_of_variant("_json").startswith("OBJECT"), F.lit(False))}
    for name in names:
        members[f"_kind_{name}"] = F.schema_of_variant(
            F.try_variant_get(F.col("_json"), f"$.{name}", "variant")
        )
        members[f"_text_{name}"] = F.try_variant_get(F.col("_json"), f"$.{name}", "string")
    return parsed.withColumns(members).drop("_json")


def _without_members(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c == "_object" or c.startswith(("_kind_", "_text_"))])


def _truth(name: str) -> Column:
    """Truth of a member: false, null, 0, "", [], {} and absence are 0."""
    kind, text = F.col(f"_kind_{name}"), F.col(f"_text_{name}")
    truth = (
        F.when(kind.isNull() | (kind == "VOID"), False)
        .when(kind == "BOOLEAN", text == "true")
        .when(kind == "STRING", text != "")
        .when(kind.startswith("ARRAY"), text != "[]")
        .when(kind.startswith("OBJECT"), text != "{}")
        .otherwise(text.try_cast("double") != 0)
    )
    return (F.col("_object") & F.coalesce(truth, F.lit(False))).cast("int")


def parse_flags(
    df: DataFrame, response: str = "response", flags: list[str] = fixed.FLAGS
) -> DataFrame:
    """Add each expected flag from a JSON response; other members are ignored."""
    members = _with_members(df, response, flags)
    return _without_members(members.withColumns({f: _truth(f) for f in flags}))


def parse_score(
    df: DataFrame,
    out: str,
    response: str = "response",
    default: int | None = None,
    name: str = "risk_score",
) -> DataFrame:
    """Add the 0..10 score of a JSON response. An absent member gives
    `default`; null, unreadable and non-JSON responses give null."""
    kind, text = F.col(f"_kind_{name}"), F.col(f"_text_{name}")
    number = (
        F.when(kind == "BOOLEAN", (text == "true").cast("double"))
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), None)
        .otherwise(number_text(text).try_cast("double"))
    )
    finite = F.when(F.abs(F.col("_number")) < float("inf"), F.col("_number"))
    return _without_members(
        _with_members(df, response, [name])
        .withColumn("_number", number)
        .withColumn(
            out,
            F.when(~F.col("_object"), None)
            .when(kind.isNull(), F.lit(default).cast("int"))
            .otherwise(score_0_10(finite)),
        )
        .drop("_number")
    )


def failure_defaults(
    df: DataFrame, ok: str, flags: list[str] = (), scores: list[str] = ()
) -> DataFrame:
    """Where the step failed (`ok` not true), flags become 0 and scores null."""
    good = F.coalesce(F.col(ok), F.lit(False))
    return df.withColumns({
        **{f: F.when(good, F.coalesce(F.col(f), F.lit(0))).otherwise(0) for f in flags},
        **{s: F.when(good, F.col(s)) for s in scores},
    })


def combo_flag_sums(df: DataFrame, key: str) -> DataFrame:
    """(key, combo, triggered): how many flags each combination sees set.

    Written as expressions on the row, so no join and no shuffle is needed.
    """
    sums = [
        F.struct(
            F.lit(combo).alias("combo"),
            add_up([F.coalesce(F.col(f), F.lit(0)) for f in combo_flag_names(combo)])
            .cast("bigint").alias("triggered"),
        )
        for combo in fixed.COMBO_AGENTS
    ]
    return df.select(key, F.inline(F.array(*sums)))


def calibration_weights(definitions: DataFrame) -> dict[str, int]:
    """Whole-number weight per flag from the calibration part of the definitions.

    strength x frequency x specificity x reliability, each 1..3. The weighting
    is this library's own: flags that are rarer false alarms weigh more.
    """
    weights = {}
    # One row per flag definition, never data rows.
    for row in definitions.select("flag_id", "orchestrator").collect():
        weight = 1
        for field, table in fixed.CALIBRATION_LEVELS.items():
            weight *= table.get((row["orchestrator"] or {}).get(field, ""), 1)
        weights[fixed.FLAG_BY_ID[row["flag_id"]]] = weight
    return weights


def weighted_risk(df: DataFrame, weights: dict[str, int]) -> DataFrame:
    """Add one 0..10 score per combination: weight of its set flags over the
    weight of all its flags."""
    scores = {}
    for combo, column in fixed.COMBO_SCORE.items():
        names = [f for f in combo_flag_names(combo) if f in weights]
        total = sum(weights[f] for f in names)
        if not total:
            scores[column] = F.lit(None).cast("int")
            continue
        hit = add_up([F.coalesce(F.col(f), F.lit(0)) * weights[f] for f in names])
        scores[column] = score_0_10(hit * F.lit(10.0) / F.lit(float(total)))
    return df.withColumns(scores)


def score_bands(df: DataFrame, score: str, scale: str = "subset", out: str = "band") -> DataFrame:
    bands = {"subset": fixed.SUBSET_BANDS, "single_pass": fixed.SINGLE_PASS_BANDS}[scale]
    return df.withColumn(out, band(F.col(score), bands))


Scorer = Callable[[pd.Series], pd.Series]


def _answers(scorer: Scorer, texts: pd.Series) -> list:
    """Responses to a batch; if the batch raises, each row is tried alone."""

    def one(value):
        try:
            return scorer(pd.Series([value])).iloc[0]
        except Exception:  # noqa: BLE001 - the scorer is foreign code
            return None

    try:
        return list(scorer(texts))
    except Exception:  # noqa: BLE001
        return [one(value) for value in texts]


def score_many(
    df: DataFrame, steps: dict[str, tuple[str, Scorer]], carry: list[str]
) -> DataFrame:
    """Run several injected batch scorers over the rows in one pass.

    `steps` maps a name to (text column, scorer). A scorer gets a Series of
    texts and returns a Series of JSON responses; null means the row failed,
    and one bad row costs only itself. Rows are stateless. The result has the
    `carry` columns and `response_<name>`; the number of partitions is the
    number of scorers at work.
    """
    ship(df.sparkSession)
    texts = list(dict.fromkeys(text for text, _ in steps.values()))
    rows = df.select(*carry, *[t for t in texts if t not in carry])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[carry].copy()
            for name, (text, scorer) in steps.items():
                answers = _answers(scorer, batch[text])
                out[f"response_{name}"] = pd.Series(answers, index=batch.index, dtype=object)
            yield out

    kept = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry]
    return rows.mapInPandas(run, ", ".join([*kept, *[f"response_{n} string" for n in steps]]))


def score_with(df: DataFrame, key: str, text: str, scorer: Scorer) -> DataFrame:
    """(key, response, ok): one injected scorer over rendered texts."""
    answered = score_many(df, {"text": (text, scorer)}, [key])
    return answered.select(
        key, F.col("response_text").alias("response"), F.col("response_text").isNotNull().alias("ok")
    )


def scoring_progress(df: DataFrame, key: str, score: str = "risk_score_all") -> DataFrame:
    """One row: completed, remaining, first and last position without a score.

    A position is the number of smaller keys, so two counts replace a sort.
    """
    unscored = F.col(score).isNull()
    ends = df.where(unscored).agg(F.min(key).alias("first"), F.max(key).alias("last"))
    first, last = ends.select("first").scalar(), ends.select("last").scalar()
    out = df.agg(
        F.count(score).alias("completed"),
        F.count(F.when(unscored, 1)).alias("remaining"),
        F.count(F.when(F.col(key) < first, 1)).alias("_first"),
        F.count(F.when(F.col(key) < last, 1)).alias("_last"),
    )
    some = F.col("remaining") > 0
    return out.select(
        "completed", "remaining",
        F.when(some, F.col("_first")).alias("first_unscored"),
        F.when(some, F.col("_last")).alias("last_unscored"),
    )


def select_range(df: DataFrame, key: str, start: int = 0, end: int = -1) -> DataFrame:
    """Rows at positions start..end (inclusive, 0-based, key order).

    Only the two end keys are looked up; the result is a plain key filter that
    the scan can use. A negative end means the last row.
    """
    total = df.count()
    end = total - 1 if end < 0 else end
    if not 0 <= start <= end < total:
        raise ValueError(f"invalid range {start}-{end} for {total} rows")
    low, high = keys_at(df, key, [start, end])
    return df.where((F.col(key) >= F.lit(low)) & (F.col(key) <= F.lit(high)))


def overlay_results(
    base: DataFrame, new: DataFrame, key: str, columns: list[str], ok: str | None = None
) -> DataFrame:
    """Write the new values over the base rows with the same key, nulls included.

    Rows without a new result, and rows whose step failed, stay untouched.
    """
    new = new.where(F.col(ok)) if ok else new
    fresh = new.select(
        F.col(key), F.lit(True).alias("_matched"), *[F.col(c).alias(f"_new_{c}") for c in columns]
    )
    old = [c for c in base.columns if c not in columns]
    return base.join(fresh, key, "left").select(
        *old,
        *[
            F.when(F.col("_matched"), F.col(f"_new_{c}"))
            .otherwise(F.col(c) if c in base.columns else F.lit(None))
            .alias(c)
            for c in columns
        ],
    )


def unscored(df: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no result yet."""
    return df.join(scored.select(key), key, "left_anti")
