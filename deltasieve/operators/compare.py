"""Base-versus-head comparison of benchmarks, for all pairs of runs in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DASH, basename, format_ns, format_p, format_pct, format_signed_pct, short_ref
from ..options import CompareOptions
from .stats import mann_whitney, summarize_samples, welch_t

VERDICTS = ("regression", "improvement", "neutral", "new", "removed", "out-of-scope")


def dedupe_runs(runs: DataFrame, keys: list[str], position: str = "pos") -> DataFrame:
    """Of rows with the same keys, the last by position."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(position).desc()))
    return runs.withColumn("_nth", last).where("_nth = 1").drop("_nth")


def pair_benches(sides: DataFrame, keys: list[str], side: str = "side") -> DataFrame:
    """keys, base and head (structs of the other columns; null where a side lacks the bench) from rows of both sides.

    They meet by grouping: each row is dealt once, and a side is one row for each of the keys.
    """
    fields = F.struct(*[c for c in sides.columns if c not in (*keys, side)])
    return sides.groupBy(*keys).agg(*[F.first(F.when(F.col(side) == s, fields), ignorenulls=True).alias(s) for s in ("base", "head")])


def _delta(field: str) -> Column:
    b, h = F.col(f"base.{field}"), F.col(f"head.{field}")
    return F.when(b.isNotNull() & h.isNotNull(), F.when(b == 0, 0.0).otherwise(F.try_divide(h - b, b)))


def with_deltas(pairs: DataFrame) -> DataFrame:
    """Relative changes of the median and the mean; zero for a base of zero, null without both sides."""
    return pairs.withColumns({"delta_pct": _delta("median"), "mean_delta_pct": _delta("mean"), "max_cv": F.when(F.col("base").isNotNull() & F.col("head").isNotNull(), F.greatest("base.cv", "head.cv"))})


def with_verdict(pairs: DataFrame, opts: CompareOptions = CompareOptions()) -> DataFrame:
    """Verdict and neutral reason: noise is looked at first, then the size of the change, then its significance."""
    noisy = (F.col("max_cv") > opts.noisy_cv) & (F.abs("delta_pct") < 2 * F.col("max_cv"))
    small = F.abs("delta_pct") < opts.threshold
    unsure = F.col("p_value") >= opts.alpha
    reason = F.when(noisy, "too-noisy").when(small, "below-threshold").when(unsure, "not-significant")
    both = F.col("base").isNotNull() & F.col("head").isNotNull()
    verdict = F.when(F.col("base").isNull(), "new").when(F.col("head").isNull(), "removed").when(reason.isNotNull(), "neutral").when(F.col("delta_pct") > 0, "regression").otherwise("improvement")
    return pairs.withColumns({"verdict": verdict, "neutral_reason": F.when(both, reason)})


def mark_out_of_scope(diffs: DataFrame, skipped: DataFrame, keys: list[str]) -> DataFrame:
    """Removed benches of files that were skipped on purpose are out of scope; files are told by their base names.

    skipped: keys and path; a pair's list of skipped files.
    """
    names = skipped.select(*keys, basename(F.col("path")).alias("_name")).distinct().withColumn("_skipped", F.lit(True))
    marked = diffs.withColumn("_name", basename(F.coalesce("base.file", "head.file"))).join(names, [*keys, "_name"], "left")
    gone = (F.col("verdict") == "removed") & F.col("_skipped")
    return marked.withColumn("verdict", F.when(gone, "out-of-scope").otherwise(F.col("verdict"))).drop("_name", "_skipped").select(diffs.columns)


def compare_samples(samples: DataFrame, keys: list[str], opts: CompareOptions = CompareOptions(), skipped: DataFrame | None = None, scope: list[str] | None = None, welch: bool = False, wide: bool = False) -> DataFrame:
    """One row for each bench: summaries of both sides, changes, p, verdict. samples: keys, side (base or head), file, ns.

    Summaries, ranks and the pairing are each one exchange on keys, whatever the number of pairs. With welch the
    diagnostic p of Welch's test is added; no verdict reads it. wide: for benches too large for a task, see
    with_running_sum.
    """
    summary = summarize_samples(samples, [*keys, "side"], carry=("file",), wide=wide)
    pairs = pair_benches(summary, keys)
    tests = mann_whitney(samples, keys, wide=wide).withColumnRenamed("p", "p_value")
    out = with_deltas(pairs).join(tests, keys, "left")
    two = F.col("base").isNotNull() & F.col("head").isNotNull()
    out = out.withColumn("p_value", F.when(two, F.col("p_value")))
    if welch:
        out = out.join(welch_t(samples, keys).select(*keys, F.col("p").alias("p_value_welch")), keys, "left").withColumn("p_value_welch", F.when(two, F.col("p_value_welch")))
    out = with_verdict(out, opts)
    return mark_out_of_scope(out, skipped, scope or []) if skipped is not None else out


def compare_summary(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the number of benches with each verdict, with the sum of changes and whether the pair fails."""
    counts = [F.count_if(F.col("verdict") == v).alias(v.replace("-", "_")) for v in VERDICTS]
    return diffs.groupBy(*keys).agg(*counts, F.coalesce(F.sum("delta_pct"), F.lit(0.0)).alias("delta_sum")).withColumn("failed", F.col("regression") > 0)


def failing_pairs(summary: DataFrame) -> DataFrame:
    return summary.where("regression > 0")


def badge(verdict: Column, reason: Column) -> Column:
    """The label of a verdict in reports."""
    plain = {"regression": "🔴 Regression", "improvement": "🟢 Improvement", "new": "🆕 New", "removed": "🗑 Removed", "out-of-scope": "⏭ Skipped"}
    shown = reduce(lambda acc, kv: acc.when(verdict == kv[0], kv[1]), plain.items(), F.when((verdict == "neutral") & (reason == "too-noisy"), "🟡 Noisy"))
    return shown.otherwise("⚪ Neutral")


def report_rows(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """The report's table: medians, changes, variation before and after, and p, as text; a dash for what is missing."""
    two = F.col("base").isNotNull() & F.col("head").isNotNull()
    b95, h95 = F.col("base.p95"), F.col("head.p95")
    return diffs.select(
        *keys,
        format_ns(F.col("base.median")).alias("base_median"),
        format_ns(F.col("head.median")).alias("head_median"),
        F.coalesce(format_signed_pct(F.col("delta_pct")), F.lit(DASH)).alias("delta"),
        F.when(two & (b95 > 0), format_signed_pct(F.try_divide(h95 - b95, b95))).otherwise(DASH).alias("p95_delta"),
        F.when(two, F.concat(format_pct(F.col("base.cv")), F.lit("→"), format_pct(F.col("head.cv")))).otherwise(DASH).alias("cv"),
        F.coalesce(format_p(F.col("p_value")), F.lit(DASH)).alias("p"),
        badge(F.col("verdict"), F.col("neutral_reason")).alias("badge"),
    )


def report_sections(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, counts of each section, of noisy benches, and the headline: regressions, else improvements, else inventory."""
    section = F.when(F.col("verdict").isin("regression", "improvement"), "significant").otherwise(F.col("verdict"))
    sections = ("significant", "new", "removed", "neutral", "out-of-scope")
    rows = diffs.withColumn("section", section)
    out = rows.groupBy(*keys).agg(*(F.count_if(F.col("section") == s).alias(s.replace("-", "_")) for s in sections), F.count_if(F.col("neutral_reason") == "too-noisy").alias("noisy"), F.count_if(F.col("verdict") == "regression").alias("_r"), F.count_if(F.col("verdict") == "improvement").alias("_i"))
    many = lambda c, word: F.concat(F.lit("Performance · "), F.col(c).cast("string"), F.lit(f" {word}"), F.when(F.col(c) == 1, "").otherwise("s"))
    headline = F.when(F.col("_r") > 0, many("_r", "regression")).when(F.col("_i") > 0, many("_i", "improvement")).when(F.col("new") + F.col("removed") > 0, "Performance · inventory changed").otherwise("Performance · no significant changes")
    return out.withColumn("headline", headline).drop("_r", "_i")


# Names of the languages in reports.
LANGUAGE_NAMES = {"ts": "TypeScript", "go": "Go", "rust": "Rust"}


def report_header(pairs: DataFrame, keys: list[str], opts: CompareOptions = CompareOptions()) -> DataFrame:
    """keys, header: the report's second line, of pairs with service, language, base_ref and head_ref."""
    name = F.coalesce(*[F.when(F.col("language") == k, v) for k, v in LANGUAGE_NAMES.items()], "language")
    text = F.format_string("Service `%s` (%s) · base `%s` → head `%s` · threshold ±%s · α=%s", "service", name, short_ref(F.col("base_ref")), short_ref(F.col("head_ref")), format_pct(F.lit(opts.threshold)), F.lit(f"{opts.alpha:g}"))
    return pairs.select(*keys, text.alias("header"))


def pair_metrics(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, base, head, direction (better, worse, same or null) of metrics other than time.

    metrics: keys, side, name, value, lower_is_better. The direction is told only where the metric says which way is better.
    """
    two = [metrics.where(F.col("side") == s).select(*keys, "name", F.col("value").alias(s), F.col("lower_is_better").alias(f"_{s}")) for s in ("base", "head")]
    both = two[0].join(two[1], [*keys, "name"], "full_outer")
    lower = F.coalesce("_head", "_base")
    change = F.col("head") - F.col("base")
    direction = F.when(change == 0, "same").when((change < 0) == lower, "better").when((change < 0) != lower, "worse")
    return both.select(*keys, "name", "base", "head", direction.alias("direction"))


def filter_benches(runs: DataFrame, pattern: str | None = None, tags: list[str] | None = None, name: str = "bench") -> DataFrame:
    """Runs whose bench name matches the pattern and that have one of the tags, where these are given."""
    if pattern is not None:
        runs = runs.where(F.col(name).rlike(pattern))
    if tags is not None:
        runs = runs.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)).cast("array<string>")))
    return runs


def split_param(runs: DataFrame, name: str = "bench") -> DataFrame:
    """bench_base and bench_param of names of the form base/param; a null param if there is none."""
    at = F.instr(F.col(name), "/")
    return runs.withColumns({"bench_base": F.substring_index(F.col(name), "/", 1), "bench_param": F.when(at > 0, F.substring(F.col(name), at + 1, F.lit(1 << 30)))})
