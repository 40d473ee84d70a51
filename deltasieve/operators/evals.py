"""Scoring of findings against labels, sweeps over confidence floors, gates on a baseline, and gate calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..options import EvaluationOptions
from .compare import compare_samples

SEVERITIES = ("nit", "minor", "major", "critical")
KEYS = ["run", "case"]
# Metrics of a report with the way that is worse and the tolerance, for steady and for model-backed runs.
TOLERANCES = {
    "critical_recall": ("drop", 0.05, 0.10),
    "critical_precision": ("drop", 0.10, 0.10),
    "critical_f1": ("drop", 0.05, 0.10),
    "severity_calibration_mae": ("rise", 0.30, 0.30),
    "judge_brier_score": ("rise", 0.05, 0.10),
    "avg_false_positives_per_case": ("rise", 0.50, 1.00),
    "forbidden_path_findings": ("rise", 0.0, 0.0),
    "pass_rate": ("drop", 0.0, 0.0),
    "observed_null_fpr": ("rise", 0.05, 0.05),
    "observed_borderline_tpr": ("drop", 0.10, 0.10),
}


def paths_match(a: Column, b: Column) -> Column:
    return a.endswith(b) | b.endswith(a)


def match_candidates(expected: DataFrame, findings: DataFrame) -> DataFrame:
    """run, case, ord (of the label), seq (of the finding): findings at a label's file, in its lines, of its category."""
    e = expected.select(*KEYS, "ord", F.col("file").alias("e_file"), "line_lo", "line_hi", F.col("category").alias("e_category"))
    f = findings.select(*KEYS, "seq", "file", "line", "category")
    inside = F.col("line_lo").isNull() | F.coalesce(F.col("line").between(F.col("line_lo"), F.col("line_hi")), F.lit(False))
    same = F.col("e_category").isNull() | (F.lower("e_category") == F.lower("category"))
    return e.join(f, KEYS).where(paths_match(F.col("e_file"), F.col("file")) & inside & same).select(*KEYS, "ord", "seq")


def assign_matches(candidates: DataFrame) -> DataFrame:
    """run, case, ord, seq: labels in order take their first finding that no earlier label has taken.

    A case's candidates are folded as arrays of numbers, label by label.
    """
    per_label = candidates.groupBy(*KEYS, "ord").agg(F.sort_array(F.collect_set("seq")).alias("seqs"))
    per_case = per_label.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("ord", "seqs"))).alias("labels"))

    def step(acc: Column, label: Column) -> Column:
        free = F.filter(label["seqs"], lambda s: ~F.array_contains(acc["used"], s))
        picked = F.transform(F.array(F.try_element_at(free, F.lit(1))), lambda s: F.struct(F.when(s.isNull(), acc["used"]).otherwise(F.concat(acc["used"], F.array(s))).alias("used"), F.when(s.isNull(), acc["pairs"]).otherwise(F.concat(acc["pairs"], F.array(F.struct(label["ord"].alias("ord"), s.alias("seq"))))).alias("pairs")))
        return picked[0]

    start = F.struct(F.array().cast("array<bigint>").alias("used"), F.array().cast("array<struct<ord:bigint,seq:bigint>>").alias("pairs"))
    return per_case.select(*KEYS, F.inline(F.aggregate("labels", start, step, lambda acc: acc["pairs"])))


def score_cases(cases: DataFrame, expected: DataFrame, forbidden: DataFrame, judged: DataFrame, floor: float = EvaluationOptions().floor) -> DataFrame:
    """One row for each run and case: labels required, caught and extra, severity distance, Brier sum, false positives, cap.

    critical_shipped are the case's critical findings, critical_right those that match a critical label. cases may have
    judge_error, duration_ms, prompt_tokens and completion_tokens, which go along.
    """
    shipped = judged.where((F.col("verdict") != "drop") & (F.col("confidence") >= floor))
    pairs = assign_matches(match_candidates(expected, shipped))
    found = pairs.join(shipped.select(*KEYS, "seq", F.col("sev_rank").alias("_model")), [*KEYS, "seq"])
    labels = expected.join(found, [*KEYS, "ord"], "left").withColumn("_hit", F.col("seq").isNotNull())
    must = F.col("must_catch")
    per_label = labels.groupBy(*KEYS).agg(
        F.count_if(must).alias("expected_total"),
        F.count_if(must & F.col("_hit")).alias("expected_caught"),
        F.count_if(~must & F.col("_hit")).alias("bonus_caught"),
        F.coalesce(F.sum(F.when(must & F.col("_hit"), F.abs(F.col("_model") - F.col("sev_rank")))), F.lit(0)).alias("severity_distance_sum"),
        F.count_if(must & F.col("_hit")).alias("severity_distance_n"),
        *[F.count_if(must & (F.col("sev_rank") == i)).alias(f"{s}_total") for i, s in enumerate(SEVERITIES)],
        *[F.count_if(must & F.col("_hit") & (F.col("sev_rank") == i)).alias(f"{s}_caught") for i, s in enumerate(SEVERITIES)],
    )
    bad = shipped.select(*KEYS, "seq", "file").join(forbidden.select(*KEYS, "path"), KEYS).where(paths_match(F.col("path"), F.col("file"))).select(*KEYS, "seq").distinct()
    hits = pairs.join(expected.select(*KEYS, "ord", (F.col("sev_rank") == 3).alias("_critical")), [*KEYS, "ord"]).select(*KEYS, "seq", "_critical", F.lit(True).alias("_hit"))
    marked = shipped.join(hits, [*KEYS, "seq"], "left").join(bad.withColumn("_bad", F.lit(True)), [*KEYS, "seq"], "left").na.fill(False, ["_hit", "_bad", "_critical"])
    miss = F.col("confidence") - F.col("_hit").cast("double")
    per_finding = marked.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("findings_total"), F.count_if(F.col("_bad")).alias("findings_forbidden"), F.count_if(~F.col("_bad") & ~F.col("_hit")).alias("findings_unmatched"), F.sum(miss * miss).alias("brier_sum"), F.count_if(F.col("sev_rank") == 3).alias("critical_shipped"), F.count_if((F.col("sev_rank") == 3) & F.col("_critical")).alias("critical_right"))
    out = cases.join(per_label, KEYS, "left").join(per_finding, KEYS, "left")
    out = out.na.fill(0, [c for c in out.columns if c not in [*KEYS, "max_findings"]])
    return out.withColumn("over_cap", F.coalesce(F.col("findings_total") > F.col("max_findings"), F.lit(False)))


def recall_at_or_above(results: DataFrame, severity: str) -> Column:
    """Aggregate: share of required labels of a severity or a higher one that were caught; one if there are none."""
    upper = SEVERITIES[SEVERITIES.index(severity) :]
    caught, total = (sum((F.sum(f"{s}_{n}") for s in upper), F.lit(0)) for n in ("caught", "total"))
    return F.when(total == 0, 1.0).otherwise(F.try_divide(caught, total))


def score_corpus(results: DataFrame, by: list[str] = ["run"]) -> DataFrame:  # noqa: B006
    """The summary of each run's cases.

    critical_precision is one, as it is where only what was caught is counted; measured_critical_precision is the share of
    critical findings shipped that match a critical label (one if none was shipped). Judge errors, mean latency (whole
    milliseconds) and tokens are 0 where the results don't have them.
    """
    have = lambda c: F.col(c) if c in results.columns else F.lit(None)
    total = lambda c: F.coalesce(F.sum(have(c).cast("bigint")), F.lit(0))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(0.0))
    out = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases_total"),
        F.count_if(F.col("expected_total") == F.col("expected_caught")).alias("cases_fully_recalled"),
        F.count_if("over_cap").alias("cases_over_cap"),
        *[recall_at_or_above(results, s).alias(f"recall_{s}") for s in SEVERITIES],
        ratio("severity_distance_sum", "severity_distance_n").alias("severity_calibration_mae"),
        ratio("brier_sum", "findings_total").alias("judge_brier_score"),
        (F.sum(F.col("findings_unmatched") + F.col("findings_forbidden")) / F.count(F.lit(1))).alias("avg_false_positives_per_case"),
        F.sum("findings_forbidden").alias("forbidden_path_findings"),
        F.when(F.sum("critical_shipped") == 0, 1.0).otherwise(F.try_divide(F.sum("critical_right"), F.sum("critical_shipped"))).alias("measured_critical_precision"),
        F.count(have("judge_error").cast("string")).alias("cases_with_judge_error"),
        F.floor(total("duration_ms") / F.count(F.lit(1))).alias("avg_latency_ms"),
        total("prompt_tokens").alias("total_prompt_tokens"),
        total("completion_tokens").alias("total_completion_tokens"),
    )
    recall = F.col("recall_critical")
    return out.withColumns({"critical_precision": F.lit(1.0), "critical_recall": recall, "critical_f1": 2 * recall / (1 + recall)})


def finding_records(judged: DataFrame, width: int = 80) -> DataFrame:
    """What of a finding is kept for later sweeps: all but dropped ones, titles cut to width bytes at a character."""
    fitting = F.filter(F.sequence(F.lit(width // 4), F.lit(width)), lambda n: F.octet_length(F.left("title", n)) <= width)
    cut = F.when(F.octet_length("title") <= width, F.col("title")).otherwise(F.left("title", F.array_max(fitting)))
    return judged.where("verdict <> 'drop'").select(*KEYS, "seq", "file", "line", "severity", "sev_rank", "category", "confidence", "verdict", cut.alias("title"))


def recalibrate(records: DataFrame, cases: DataFrame, expected: DataFrame, forbidden: DataFrame, floors: list[float]) -> DataFrame:
    """The corpus summary of each run at each floor, from records alone. The floors are a literal list on each row.

    Raises if a run has cases but no records at all, or records of a case that isn't known. Cases without records are
    fine in a run that has others with some.
    """
    bare = [r["run"] for r in cases.select("run").distinct().join(records.select("run").distinct(), "run", "left_anti").orderBy("run").limit(5).collect()]
    if bare or records.isEmpty():
        raise ValueError(f"no records to sweep over: {', '.join(map(str, bare)) or 'none at all'}")
    stray = records.select(*KEYS).distinct().join(cases, KEYS, "left_anti")
    if not stray.isEmpty():
        raise ValueError("records of an unknown case")
    at = lambda d: d.withColumn("floor", F.explode(F.array(*map(F.lit, floors)))).withColumn("run", F.concat("run", F.lit("@"), F.col("floor").cast("string")))
    swept = at(records).where(F.col("confidence") >= F.col("floor"))
    scored = score_cases(at(cases).drop("floor"), at(expected).drop("floor"), at(forbidden).drop("floor"), swept.drop("floor"), 0.0)
    whole = scored.withColumns({"floor": F.substring_index("run", "@", -1).cast("double"), "run": F.substring_index("run", "@", 1)})
    return score_corpus(whole, ["run", "floor"])


def sweep_table(summary: DataFrame, metrics: list[str]) -> DataFrame:
    """run, metric, floor, value, delta to the value at the lowest floor."""
    long = summary.select("run", "floor", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(["run", "floor"], metrics, "metric", "value")
    first = F.first_value("value").over(Window.partitionBy("run", "metric").orderBy("floor"))
    return long.withColumn("delta", F.col("value") - first)


def eval_metrics(summary: DataFrame) -> DataFrame:
    """run, metric, value of a summary's metrics that gates know."""
    known = [m for m in TOLERANCES if m in summary.columns]
    return summary.select("run", *[F.col(m).cast("double").alias(m) for m in known]).unpivot(["run"], known, "metric", "value")


def eval_regressions(base: DataFrame, current: DataFrame, base_is_real: bool = False, current_is_real: bool = False) -> DataFrame:
    """metric, baseline, current, delta_worse, tolerance of metrics (metric, value) that are worse by more than allowed.

    A baseline from a real model has the wider tolerances, and can't be met by a run without one.
    """
    spark = base.sparkSession
    rows = [(m, way == "drop", real if base_is_real else steady) for m, (way, steady, real) in TOLERANCES.items()]
    table = spark.createDataFrame(rows, "metric string, drop boolean, tolerance double")
    joined = base.select("metric", F.col("value").alias("baseline")).join(current.select("metric", F.col("value").alias("current")), "metric").join(F.broadcast(table), "metric")
    worse = F.when(F.col("drop"), F.col("baseline") - F.col("current")).otherwise(F.col("current") - F.col("baseline"))
    out = joined.withColumn("delta_worse", worse).where("delta_worse > tolerance").select("metric", "baseline", "current", "delta_worse", "tolerance")
    if base_is_real and not current_is_real:
        out = out.unionByName(spark.createDataFrame([("real_model", 1.0, 0.0, 1.0, 0.0)], out.schema))
    return out


def eval_diff(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, a, b, delta of two runs' tables; null where one lacks the row."""
    both = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys, "full_outer")
    return both.withColumn("delta", F.col("b") - F.col("a"))


def gate_calibration(trials: DataFrame) -> DataFrame:
    """scenario, trials, rates of verdicts and of noisy neutrals, mean p: the comparison over a table of trials at once.

    trials: scenario, trial, side, ns.
    """
    diffs = compare_samples(trials.withColumn("file", F.lit("")), ["scenario", "trial"])
    rate = lambda c: F.avg(c.cast("double"))
    v = F.col("verdict")
    return diffs.groupBy("scenario").agg(F.count(F.lit(1)).alias("trials"), *[rate(v == x).alias(f"{x}_rate") for x in ("regression", "improvement", "neutral")], rate(F.coalesce(F.col("neutral_reason") == "too-noisy", F.lit(False))).alias("too_noisy_rate"), F.avg("p_value").alias("mean_p"))


BOUNDS = (("regression_rate", "min_regression_rate", True), ("regression_rate", "max_regression_rate", False), ("improvement_rate", "min_improvement_rate", True), ("improvement_rate", "max_improvement_rate", False), ("neutral_rate", "min_neutral_rate", True), ("too_noisy_rate", "min_too_noisy_rate", True))


def check_expectations(rates: DataFrame, expects: DataFrame) -> DataFrame:
    """rates with failures (the bounds that are broken) and passed; expects: scenario and the bounds, null for none."""
    joined = rates.join(expects, "scenario")
    broken = [F.when((F.col(r) < F.col(b)) if least else (F.col(r) > F.col(b)), F.lit(b)) for r, b, least in BOUNDS]
    out = joined.withColumn("failures", F.filter(F.array(*broken), lambda f: f.isNotNull()))
    return out.withColumn("passed", F.size("failures") == 0).select(*rates.columns, "failures", "passed")


def calibration_summary(checked: DataFrame, null: str = "null", borderline: str = "borderline") -> DataFrame:
    """pass_rate, and the regression rates of the scenarios without a change and with one at the border."""
    of = lambda s: F.coalesce(F.max(F.when(F.col("scenario") == s, F.col("regression_rate"))), F.lit(0.0))
    return checked.groupBy().agg(F.avg(F.col("passed").cast("double")).alias("pass_rate"), of(null).alias("observed_null_fpr"), of(borderline).alias("observed_borderline_tpr"))
