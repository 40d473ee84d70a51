"""Queries on statistics and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, stats
from . import fixtures as fx

KEYS = ["bench", "side"]
NUMBERS = ["elapsed_ns", "mean", "median", "trimmed_mean", "stddev", "cv", "mad", "iqr", "min", "max", "p50", "p95", "p99"]


def _rounded(df: DataFrame, places: int = 5) -> DataFrame:
    """Doubles to a fixed number of places, for comparing sums taken in another order."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def summarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.summarize_samples(fx.samples(spark, sf_dir), KEYS))


def trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.trimmed_mean(fx.samples(spark, sf_dir), KEYS, 0.1))


def mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.mad(fx.samples(spark, sf_dir), KEYS))


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.percentiles_by_rank(fx.samples(spark, sf_dir), KEYS, [0.1, 0.5, 0.95]))


def mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.mann_whitney(fx.samples(spark, sf_dir), ["bench"]), 6)


def welch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.welch_moments(fx.samples(spark, sf_dir), ["bench"]))


def welch_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.welch_t(fx.samples(spark, sf_dir), ["bench"]))


def sufficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sufficient_prefix(fx.samples(spark, sf_dir), KEYS, least=5, target_cv=0.08, budget_ns=20000.0)


def per_op(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched = fx.samples(spark, sf_dir).withColumn("batch_size", F.col("l_partkey") % 4)
    return _rounded(stats.per_op_ns(batched).groupBy("bench").agg(F.sum("ns").alias("ns")))


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = fx.samples(spark, sf_dir).groupBy("bench", "side").agg(F.sort_array(F.collect_list("ns")).alias("samples"), F.max("l_partkey").alias("k"))
    zero = {c: F.when(F.col("k") % 3 == 0, 1.0).otherwise(0.0) for c in stats.DERIVED}
    runs = runs.withColumns(zero | {"iterations": F.lit(0).cast("bigint"), "batch_size": (F.col("k") % 2).cast("bigint"), "elapsed_ns": F.when(F.col("k") % 3 == 0, 5.0).otherwise(0.0)})
    return _rounded(stats.normalize_runs(runs, KEYS).drop("samples", "k"))


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    skipped = spark.createDataFrame([("some/mod_3.rs",)], "path string")
    rows = fx.inventory(spark, sf_dir).withColumn("pair", F.lit(1))
    return compare.compare_samples(rows, ["pair", "bench"], skipped=skipped.withColumn("pair", F.lit(1)), scope=["pair"]).drop("pair")


def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = diffs(spark, sf_dir)
    return _rounded(d.select("bench", F.col("base.median").alias("base_median"), F.col("head.median").alias("head_median"), "delta_pct", "mean_delta_pct", "max_cv", "p_value", "verdict", "neutral_reason"), 6)


def compare_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison for benches of any size: over distinct values, ordered by ranges."""
    d = compare.compare_samples(fx.inventory(spark, sf_dir), ["bench"], wide=True)
    return _rounded(d.select("bench", F.col("base.trimmed_mean").alias("trimmed_mean"), F.col("base.mad").alias("mad"), F.col("head.iqr").alias("iqr"), F.col("head.p99").alias("p99"), "delta_pct", "p_value", "verdict"), 6)


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(compare.compare_summary(diffs(spark, sf_dir).withColumn("service", F.lit("svc")), ["service"]), 6)


def failing(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_file = diffs(spark, sf_dir).withColumn("file", F.coalesce("base.file", "head.file"))
    return _rounded(compare.failing_pairs(compare.compare_summary(by_file, ["file"])), 6)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.report_rows(diffs(spark, sf_dir), ["bench"])


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_file = diffs(spark, sf_dir).withColumn("file", F.coalesce("base.file", "head.file"))
    return compare.report_sections(by_file, ["file"])


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header of a comparison of each order's two versions."""
    ref = lambda c: F.md5(F.col(c).cast("string"))
    pairs = fx.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("service"), F.lit("rust").alias("language"), ref("o_custkey").alias("base_ref"), ref("o_orderkey").alias("head_ref"))
    return compare.report_header(pairs, ["o_orderkey"])


def metric_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.inventory(spark, sf_dir).groupBy("bench", "side", "l_partkey").agg(F.min("ns").alias("value"))
    m = m.select("bench", "side", F.lit("alloc").alias("name"), "value", F.when(F.col("l_partkey") % 3 == 0, True).when(F.col("l_partkey") % 3 == 1, False).alias("lower_is_better"))
    return _rounded(compare.pair_metrics(m, ["bench"]))


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = fx.samples(spark, sf_dir).select("bench", "l_partkey").distinct().withColumn("tags", F.array(F.concat(F.lit("t"), F.col("l_partkey") % 3), F.lit("all")))
    return compare.filter_benches(runs, "^p1[0-9]*$", ["t1"]).select("bench")


def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = fx.samples(spark, sf_dir).select("l_partkey", F.when(F.col("l_partkey") % 2 == 0, F.concat("bench", F.lit("/"), F.col("l_partkey") % 9, F.lit("/x"))).otherwise(F.col("bench")).alias("bench")).distinct()
    return compare.split_param(named).select("bench", "bench_base", "bench_param")


def dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")
    return compare.dedupe_runs(o, ["o_custkey", "o_orderpriority"], "o_orderkey")


QUERIES = {
    "summarize_samples": summarize,
    "trimmed_mean": trimmed,
    "median_absolute_deviation": mad,
    "percentiles_by_rank": percentiles,
    "mann_whitney": mann_whitney,
    "welch_t": welch,
    "welch_p": welch_p,
    "sufficient_prefix": sufficient,
    "per_op_ns": per_op,
    "normalize_runs": normalized,
    "compare_runs": compare_runs,
    "compare_wide": compare_wide,
    "compare_summary": summary,
    "failing_pairs": failing,
    "report_rows": rows,
    "report_sections": sections,
    "report_header": headers,
    "pair_metrics": metric_pairs,
    "filter_benches": filtered,
    "split_param": params,
    "dedupe_runs": dedupe,
}

_S = f"WITH {fx.SAMPLES_SQL}"
_D = f"{_S}, {fx.INVENTORY_SQL}, {fx.SUMMARY_SQL.format(src='v')}, {fx.MANN_WHITNEY_SQL.format(src='v')}, {fx.COMPARE_SQL.format(scoped='true')}"
_DW = f"{_S}, {fx.INVENTORY_SQL}, {fx.SUMMARY_SQL.format(src='v')}, {fx.MANN_WHITNEY_SQL.format(src='v')}, {fx.COMPARE_SQL.format(scoped='false')}"
_r = lambda cols, n: ", ".join(f"round({c}, {n}) AS {c}" for c in cols)
_COUNTS = ", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS {v.replace('-', '_')}" for v in compare.VERDICTS)
_BADGE = "CASE verdict WHEN 'regression' THEN '🔴 Regression' WHEN 'improvement' THEN '🟢 Improvement' WHEN 'new' THEN '🆕 New' WHEN 'removed' THEN '🗑 Removed' WHEN 'out-of-scope' THEN '⏭ Skipped' ELSE CASE WHEN neutral_reason = 'too-noisy' THEN '🟡 Noisy' ELSE '⚪ Neutral' END END"

# Half a last digit goes up: through decimals, as the digits of a double are shown.
_FIX = lambda v, n: f"round(({v})::DECIMAL(30, 12), {n})::DECIMAL(30, {n})::VARCHAR" if n else f"round(({v})::DECIMAL(30, 12), 0)::BIGINT::VARCHAR"
_NS = lambda v: f"CASE WHEN {v} IS NULL THEN '—' WHEN {v} < 1e3 THEN {_FIX(v, 0)} || 'ns' WHEN {v} < 1e6 THEN {_FIX(v + ' / 1e3', 2)} || 'µs' WHEN {v} < 1e9 THEN {_FIX(v + ' / 1e6', 2)} || 'ms' ELSE {_FIX(v + ' / 1e9', 2)} || 's' END"
_PCT = lambda v: f"CASE WHEN abs({v}) < 0.001 THEN {_FIX(v + ' * 100', 2)} WHEN abs({v}) < 0.01 THEN {_FIX(v + ' * 100', 1)} ELSE {_FIX(v + ' * 100', 0)} END || '%'"
_SIGNED = lambda v: f"CASE WHEN {v} > 0 THEN '+' WHEN {v} < 0 AND round(({v} * 100)::DECIMAL(30, 12), 1) = 0 THEN '-' ELSE '' END || {_FIX(v + ' * 100', 1)} || '%'"

ORACLE_SQL = {
    "summarize_samples": f"{_S}, {fx.SUMMARY_SQL.format(src='s')} SELECT bench, side, n, {_r([c for c in NUMBERS if c != 'p50'], 5)}, round(median, 5) AS p50 FROM q",
    "trimmed_mean": f"{_S}, r AS (SELECT *, row_number() OVER (PARTITION BY bench, side ORDER BY ns) AS rn, count(*) OVER (PARTITION BY bench, side) AS n FROM s) SELECT bench, side, round(avg(ns) FILTER (WHERE (rn > floor(n * 0.1) AND rn <= n - floor(n * 0.1)) OR 2 * floor(n * 0.1) >= n), 5) AS trimmed_mean FROM r GROUP BY bench, side",
    "median_absolute_deviation": f"{_S} SELECT bench, side, round(mad(ns), 5) AS mad FROM s GROUP BY bench, side",
    "percentiles_by_rank": f"{_S} SELECT bench, side, p, round(CASE p WHEN 0.1 THEN a WHEN 0.5 THEN b ELSE c END, 5) AS value FROM (SELECT bench, side, quantile_cont(ns, 0.1) AS a, quantile_cont(ns, 0.5) AS b, quantile_cont(ns, 0.95) AS c FROM s GROUP BY bench, side), (SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.95::DOUBLE]) AS p)",
    "mann_whitney": f"{_S}, {fx.MANN_WHITNEY_SQL.format(src='s')} SELECT bench, round(u, 6) AS u, round(z, 6) AS z, round(p, 6) AS p FROM mw",
    "welch_t": f"{_S}, g AS (SELECT bench, count(*) FILTER (WHERE side = 'base') AS n0, count(*) FILTER (WHERE side = 'head') AS n1, avg(ns) FILTER (WHERE side = 'base') AS m0, avg(ns) FILTER (WHERE side = 'head') AS m1, var_samp(ns) FILTER (WHERE side = 'base') AS v0, var_samp(ns) FILTER (WHERE side = 'head') AS v1 FROM s GROUP BY bench) SELECT bench, CASE WHEN n0 >= 2 AND n1 >= 2 AND v0 / n0 + v1 / n1 > 0 THEN round((m0 - m1) / sqrt(v0 / n0 + v1 / n1), 5) END AS t, CASE WHEN n0 >= 2 AND n1 >= 2 AND v0 / n0 + v1 / n1 > 0 THEN round((v0 / n0 + v1 / n1) ^ 2 / ((v0 / n0) ^ 2 / (n0 - 1) + (v1 / n1) ^ 2 / (n1 - 1)), 5) END AS df FROM g",
    "sufficient_prefix": f"{_S}, w AS (SELECT bench, side, count(*) OVER o AS n, avg(ns) OVER o AS m, stddev_samp(ns) OVER o AS d, sum(ns) OVER o AS t FROM s WINDOW o AS (PARTITION BY bench, side ORDER BY idx ROWS UNBOUNDED PRECEDING)) SELECT bench, side, max(n) AS n_samples, min(n) FILTER (WHERE n >= 5 AND ((coalesce(d / m, 0) > 0 AND coalesce(d / m, 0) <= 0.08) OR t >= 20000)) AS enough_at FROM w GROUP BY bench, side",
    "per_op_ns": f"{_S} SELECT bench, round(sum(ns / greatest(1, l_partkey % 4)), 5) AS ns FROM s GROUP BY bench",
    "normalize_runs": f"{_S}, {fx.SUMMARY_SQL.format(src='s')}, z AS (SELECT q.*, k, NOT (k % 3 = 0) OR k % 2 = 0 AS bad FROM q JOIN (SELECT DISTINCT bench, l_partkey AS k FROM s) USING (bench)) SELECT bench, side, "
    + ", ".join(f"round(CASE WHEN bad THEN {'median' if c == 'p50' else c} ELSE 1.0 END, 5) AS {c}" for c in stats.DERIVED)
    + ", CASE WHEN bad THEN n ELSE 0 END AS iterations, CASE WHEN k % 2 = 0 THEN 1 ELSE k % 2 END AS batch_size, round(CASE WHEN k % 3 = 0 THEN 5.0 ELSE elapsed_ns END, 5) AS elapsed_ns FROM z",
    "compare_runs": f"{_D} SELECT bench, round(b_median, 6) AS base_median, round(h_median, 6) AS head_median, round(delta, 6) AS delta_pct, round(mean_delta, 6) AS mean_delta_pct, round(max_cv, 6) AS max_cv, round(p_value, 6) AS p_value, verdict, neutral_reason FROM d",
    "compare_wide": f"{_DW} SELECT d.bench, round(b.trimmed_mean, 6) AS trimmed_mean, round(b.mad, 6) AS mad, round(h.iqr, 6) AS iqr, round(h.p99, 6) AS p99, round(delta, 6) AS delta_pct, round(p_value, 6) AS p_value, verdict FROM d LEFT JOIN q b ON b.bench = d.bench AND b.side = 'base' LEFT JOIN q h ON h.bench = d.bench AND h.side = 'head'",
    "compare_summary": f"{_D} SELECT 'svc' AS service, {_COUNTS}, round(coalesce(sum(delta), 0), 6) AS delta_sum, count(*) FILTER (WHERE verdict = 'regression') > 0 AS failed FROM d",
    "failing_pairs": f"{_D} SELECT file, {_COUNTS}, round(coalesce(sum(delta), 0), 6) AS delta_sum, true AS failed FROM d GROUP BY file HAVING count(*) FILTER (WHERE verdict = 'regression') > 0",
    "report_rows": f"{_D} SELECT bench, {_NS('b_median')} AS base_median, {_NS('h_median')} AS head_median, coalesce({_SIGNED('delta')}, '—') AS delta, CASE WHEN has_b AND has_h AND b_p95 > 0 THEN {_SIGNED('((h_p95 - b_p95) / b_p95)')} ELSE '—' END AS p95_delta, CASE WHEN has_b AND has_h THEN {_PCT('b_cv')} || '→' || {_PCT('h_cv')} ELSE '—' END AS cv, coalesce(CASE WHEN p_value = 0 THEN '0.00e0' ELSE regexp_replace(printf('%.2e', p_value), 'e([-]?)\\+?0*(\\d)', 'e\\1\\2') END, '—') AS p, {_BADGE} AS badge FROM d",
    "report_sections": f"{_D}, g AS (SELECT file, count(*) FILTER (WHERE verdict IN ('regression', 'improvement')) AS significant, count(*) FILTER (WHERE verdict = 'new') AS \"new\", count(*) FILTER (WHERE verdict = 'removed') AS removed, count(*) FILTER (WHERE verdict = 'neutral') AS neutral, count(*) FILTER (WHERE verdict = 'out-of-scope') AS out_of_scope, count(*) FILTER (WHERE neutral_reason = 'too-noisy') AS noisy, count(*) FILTER (WHERE verdict = 'regression') AS r, count(*) FILTER (WHERE verdict = 'improvement') AS i FROM d GROUP BY file) SELECT * EXCLUDE (r, i), 'Performance · ' || CASE WHEN r > 0 THEN r || ' regression' || CASE r WHEN 1 THEN '' ELSE 's' END WHEN i > 0 THEN i || ' improvement' || CASE i WHEN 1 THEN '' ELSE 's' END WHEN \"new\" + removed > 0 THEN 'inventory changed' ELSE 'no significant changes' END AS headline FROM g",
    "report_header": "SELECT o_orderkey, 'Service `' || o_orderpriority || '` (Rust) · base `' || left(md5(o_custkey::VARCHAR), 7) || '` → head `' || left(md5(o_orderkey::VARCHAR), 7) || '` · threshold ±5% · α=0.05' AS header FROM orders",
    "pair_metrics": f"{_S}, {fx.INVENTORY_SQL}, g AS (SELECT bench, any_value(l_partkey) AS k, min(ns) FILTER (WHERE side = 'base') AS base, min(ns) FILTER (WHERE side = 'head') AS head FROM v GROUP BY bench) SELECT bench, 'alloc' AS name, round(base, 5) AS base, round(head, 5) AS head, CASE WHEN head = base THEN 'same' WHEN k % 3 = 2 OR head IS NULL OR base IS NULL THEN NULL WHEN (head < base) = (k % 3 = 0) THEN 'better' ELSE 'worse' END AS direction FROM g",
    "filter_benches": "SELECT DISTINCT 'p' || l_partkey AS bench FROM lineitem WHERE regexp_matches('p' || l_partkey, '^p1[0-9]*$') AND l_partkey % 3 = 1",
    "split_param": "SELECT DISTINCT CASE WHEN l_partkey % 2 = 0 THEN 'p' || l_partkey || '/' || (l_partkey % 9) || '/x' ELSE 'p' || l_partkey END AS bench, 'p' || l_partkey AS bench_base, CASE WHEN l_partkey % 2 = 0 THEN (l_partkey % 9) || '/x' END AS bench_param FROM lineitem",
    "dedupe_runs": "SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) = 1",
}
