"""Statistics of groups of samples: every operator works on all groups of a table at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dist import norm_cdf, student_t_cdf
from ..sources.shared import settled


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def mean_ns(c: str = "ns") -> Column:
    return _or_zero(F.avg(c))


def var_ns(c: str = "ns") -> Column:
    return _or_zero(F.var_samp(c))


def stddev_ns(c: str = "ns") -> Column:
    return _or_zero(F.stddev_samp(c))


def cv(c: str = "ns") -> Column:
    return _or_zero(F.try_divide(stddev_ns(c), F.avg(c)))


def percentile_ns(p: float, c: str = "ns") -> Column:
    """Linearly interpolated percentile; for groups whose distinct values fit in a task's memory."""
    return _or_zero(F.percentile(c, F.lit(p)))


def median_ns(c: str = "ns") -> Column:
    return _or_zero(F.median(c))


def iqr(c: str = "ns") -> Column:
    return percentile_ns(0.75, c) - percentile_ns(0.25, c)


def with_running_sum(rows: DataFrame, keys: list[str], order: str, value: str, name: str, wide: bool = False) -> DataFrame:
    """rows with name, the sum of value up to and with each row, by keys in order.

    A window orders a group in one task. With wide, groups too large for that are cut by ranges of order: sums
    within each range are moved on by those of the ranges before it, of which there is a row for each key and range.
    """
    if not wide:
        upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(name, F.sum(value).over(upto))
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written, so that the two uses below see the same ranges.
    cut = settled(rows.repartitionByRange(ranges, *keys, order).withColumn("_range", F.spark_partition_id()), "ranges")
    within = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    totals = cut.groupBy(*keys, "_range").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # Each range goes on with one group of the range before it at most, so that there are fewer of these rows than ranges.
    offsets = totals.withColumn("_before", F.sum("_total").over(before)).drop("_total").where("_before IS NOT NULL")
    summed = cut.withColumn(name, F.sum(value).over(within)).join(F.broadcast(offsets), [*keys, "_range"], "left")
    return summed.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_range", "_before")


def percentiles_by_rank(samples: DataFrame, keys: list[str], points: list[float], c: str = "ns", wide: bool = False, weight: str | None = None) -> DataFrame:
    """keys, p, value: the same percentiles from counts of distinct values, for groups of any size.

    A group is reduced to its distinct values before it is ordered, and no value list is held in memory. wide: see
    with_running_sum. weight: a column that tells how many samples a row stands for.
    """
    many = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = samples.groupBy(*keys, c).agg(many.alias("_n"))
    sizes = samples.groupBy(*keys).agg(many.alias("_all"))
    ranked = with_running_sum(counts, keys, c, "_n", "_to", wide).withColumn("_from", F.col("_to") - F.col("_n")).join(sizes, keys)
    asked = ranked.withColumn("p", F.explode(F.array(*map(F.lit, points))))
    at = F.col("p") * (F.col("_all") - 1)
    low = F.floor(at)
    inside = lambda r: (F.col("_from") <= r) & (r < F.col("_to"))
    found = asked.groupBy(*keys, "p").agg(F.max(F.when(inside(low), F.col(c))).alias("_lo"), F.max(F.when(inside(F.ceil(at)), F.col(c))).alias("_hi"), F.max(at - low).alias("_part"))
    return found.select(*keys, "p", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).alias("value"))


def trimmed_mean(samples: DataFrame, keys: list[str], trim: float = 0.05, c: str = "ns", keep_all: bool = True) -> DataFrame:
    """keys, trimmed_mean: the mean without floor(n * trim) values at each end (of all if nothing would be left)."""
    by_value = Window.partitionBy(*keys).orderBy(c)
    cut = F.floor(F.col("_n") * trim)
    inside = (F.col("_at") > cut) & (F.col("_at") <= F.col("_n") - cut)
    if keep_all:
        inside = inside | (2 * cut >= F.col("_n"))
    ranked = samples.select(*keys, c).withColumns({"_at": F.row_number().over(by_value), "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    return ranked.groupBy(*keys).agg(_or_zero(F.avg(F.when(inside, F.col(c)))).alias("trimmed_mean"))


def mad(samples: DataFrame, keys: list[str], c: str = "ns") -> DataFrame:
    """keys, mad: the median of distances to the group's median."""
    middle = samples.groupBy(*keys).agg(F.median(c).alias("_median"))
    return samples.select(*keys, c).join(middle, keys).groupBy(*keys).agg(_or_zero(F.median(F.abs(F.col(c) - F.col("_median")))).alias("mad"))


def summarize_samples(samples: DataFrame, keys: list[str], trim: float = 0.05, carry: tuple[str, ...] = (), wide: bool = False) -> DataFrame:
    """keys, n, elapsed and the twelve summary numbers of each group, from one exchange of the samples on keys.

    carry: other columns, of which each group keeps the greatest value.

    Moments and percentiles are one aggregate; the trimmed mean and the median distance need the group's order and
    median first, which windows over the same partitioning give. With wide no group is ordered in one task: see
    _summarize_wide.
    """
    if wide:
        return _summarize_wide(samples, keys, trim, carry)
    group, ordered = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("ns")
    rows = samples.select(*keys, *carry, "ns").withColumns({"_at": F.row_number().over(ordered), "_n": F.count(F.lit(1)).over(group), "_median": F.median("ns").over(group)})
    cut = F.floor(F.col("_n") * trim)
    inside = ((F.col("_at") > cut) & (F.col("_at") <= F.col("_n") - cut)) | (2 * cut >= F.col("_n"))
    points = F.percentile("ns", F.array(*map(F.lit, _POINTS)))
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("ns").alias("elapsed_ns"),
        mean_ns().alias("mean"),
        F.first("_median").alias("median"),
        _or_zero(F.avg(F.when(inside, F.col("ns")))).alias("trimmed_mean"),
        stddev_ns().alias("stddev"),
        cv().alias("cv"),
        _or_zero(F.median(F.abs(F.col("ns") - F.col("_median")))).alias("mad"),
        F.min("ns").alias("min"),
        F.max("ns").alias("max"),
        points.alias("_points"),
        *[F.max(c).alias(c) for c in carry],
    )
    return _with_points(out.withColumns({f"_p{i}": F.col("_points")[i] for i in range(len(_POINTS))}), keys, carry)


#: Percentiles of a summary beside the median.
_POINTS = (0.25, 0.75, 0.95, 0.99)


def _with_points(rows: DataFrame, keys: list[str], carry: tuple[str, ...]) -> DataFrame:
    zero = [_or_zero(F.col(f"_p{i}")) for i in range(len(_POINTS))]
    found = {"iqr": zero[1] - zero[0], "p50": F.col("median"), "p95": zero[2], "p99": zero[3]}
    return rows.withColumns(found).select(*keys, "n", "elapsed_ns", *DERIVED, *carry)


def _summarize_wide(samples: DataFrame, keys: list[str], trim: float, carry: tuple[str, ...]) -> DataFrame:
    """summarize_samples for groups of any size: over counts of distinct values, ordered by ranges, not by group.

    The counts are ordered once; all but the median distance comes from these, and that from the same counts.
    """
    counts = samples.groupBy(*keys, "ns").agg(F.count(F.lit(1)).alias("_k"), *[F.max(c).alias(c) for c in carry])
    ranked = settled(with_running_sum(counts, keys, "ns", "_k", "_to", True), "ranked")
    k, ns, n = F.col("_k"), F.col("ns"), F.col("n")
    # Values alone count for moments.
    there = F.when(ns.isNotNull(), k)
    plain = ranked.groupBy(*keys).agg(F.sum("_k").alias("n"), F.sum(there).alias("_there"), F.sum(k * ns).alias("elapsed_ns"), F.min("ns").alias("min"), F.max("ns").alias("max"), *[F.max(c).alias(c) for c in carry])
    plain = plain.withColumn("_mean", F.try_divide("elapsed_ns", "_there"))
    rows = ranked.drop(*carry).join(plain, keys)
    start = F.col("_to") - k
    cut = F.floor(n * trim)
    # How many of a value's samples lie within the places that are kept.
    inside = F.greatest(F.lit(0), F.least(F.col("_to"), n - cut) - F.greatest(start, cut))
    weight = F.when(2 * cut >= n, k).otherwise(inside)
    at = {p: p * (n - 1) for p in (0.5, *_POINTS)}
    of = lambda place: F.max(F.when((start <= place) & (place < F.col("_to")), ns))
    found = rows.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in plain.columns if c not in keys],
        _or_zero(F.try_divide(F.sum(weight * ns), F.sum(weight))).alias("trimmed_mean"),
        F.sum(k * (ns - F.col("_mean")) * (ns - F.col("_mean"))).alias("_squares"),
        *[of(f(place)).alias(f"_{side}{i}") for i, place in enumerate(at.values()) for side, f in (("lo", F.floor), ("hi", F.ceil))],
    )
    names = ["median", *(f"_p{i}" for i in range(len(_POINTS)))]
    between = [F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (place - F.floor(place)) for i, place in enumerate(at.values())]
    found = found.withColumns(dict(zip(names, between, strict=True)))
    deviation = F.when(F.col("_there") > 1, F.sqrt(F.try_divide("_squares", F.col("_there") - 1)))
    found = found.withColumns({"mean": _or_zero(F.col("_mean")), "stddev": _or_zero(deviation), "cv": _or_zero(F.try_divide(deviation, "_mean"))})
    found = settled(found, "found")
    apart = ranked.join(found.select(*keys, "median"), keys).select(*keys, F.abs(ns - F.col("median")).alias("ns"), "_k")
    mads = percentiles_by_rank(apart, keys, [0.5], wide=True, weight="_k").select(*keys, F.col("value").alias("mad"))
    return _with_points(found.join(mads, keys), keys, carry)


DERIVED = ["mean", "median", "trimmed_mean", "stddev", "cv", "mad", "iqr", "min", "max", "p50", "p95", "p99"]


def normalize_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs (keys, iterations, batch_size, elapsed_ns, samples, the derived numbers) with suspect rows filled in anew.

    A row is suspect if it has samples but no mean and median, no elapsed time or no batch size.
    """
    suspect = (F.size("samples") > 0) & (((F.col("mean") == 0) & (F.col("median") == 0)) | (F.col("elapsed_ns") == 0) | (F.col("batch_size") == 0))
    bad = runs.where(suspect)
    fresh = summarize_samples(bad.select(*keys, F.explode("samples").alias("ns")), keys)
    fresh = fresh.withColumnsRenamed({c: f"_{c}" for c in [*DERIVED, "elapsed_ns", "n"]})
    fixed = bad.join(fresh, keys).withColumns(
        {c: F.col(f"_{c}") for c in DERIVED}
        | {
            "iterations": F.col("_n"),
            "batch_size": F.when(F.col("batch_size") == 0, 1).otherwise(F.col("batch_size")),
            "elapsed_ns": F.when(F.col("elapsed_ns") == 0, F.col("_elapsed_ns")).otherwise(F.col("elapsed_ns")),
        }
    )
    return runs.where(~F.coalesce(suspect, F.lit(False))).unionByName(fixed.select(runs.columns))


def mann_whitney(samples: DataFrame, keys: list[str], side: str = "side", base: str = "base", head: str = "head", wide: bool = False) -> DataFrame:
    """keys, u, z, p of the two sides of each key: normal approximation with tie and continuity corrections.

    Samples are counted by value first, so ties shrink the data before it is ordered. wide: see with_running_sum.
    """
    counted = samples.groupBy(*keys, "ns").agg(F.count_if(F.col(side) == base).alias("_a"), F.count_if(F.col(side) == head).alias("_b"))
    counted = counted.withColumn("_t", (F.col("_a") + F.col("_b")).cast("double"))
    upto = with_running_sum(counted, keys, "ns", "_t", "_upto", wide)
    ranked = upto.withColumn("_rank", F.col("_upto") - (F.col("_t") - 1) / 2)
    t = F.col("_t")
    sums = ranked.groupBy(*keys).agg(F.sum("_a").cast("double").alias("_na"), F.sum("_b").cast("double").alias("_nb"), F.sum(F.col("_a") * F.col("_rank")).alias("_ranks"), F.sum(t * t * t - t).alias("_ties"))
    na, nb = F.col("_na"), F.col("_nb")
    ua = F.col("_ranks") - na * (na + 1) / 2
    sums = sums.withColumn("u", F.when((na == 0) | (nb == 0), 0.0).otherwise(F.least(ua, na * nb - ua)))
    total = na + nb
    spread = na * nb / 12 * (total + 1 - F.coalesce(F.try_divide(F.col("_ties"), total * (total - 1)), F.lit(0.0)))
    usable = (na > 0) & (nb > 0) & (spread > 0)
    sums = sums.withColumn("z", F.when(usable, F.greatest(F.lit(0.0), F.abs(F.col("u") - na * nb / 2) - 0.5) / F.sqrt(F.when(usable, spread))).otherwise(0.0))
    p = F.when(usable, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * norm_cdf(-F.col("z"))))).otherwise(1.0)
    return sums.select(*keys, "u", "z", p.alias("p"))


def welch_moments(samples: DataFrame, keys: list[str], side: str = "side", base: str = "base", head: str = "head") -> DataFrame:
    """keys, t, df of Welch's test; null where a side has under two samples or both have no variance."""
    of = lambda s: F.when(F.col(side) == s, F.col("ns"))
    m = samples.groupBy(*keys).agg(*(f(of(s)).alias(f"_{n}{i}") for i, s in enumerate((base, head)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    se = [F.col(f"_v{i}") / F.col(f"_n{i}") for i in (0, 1)]
    pooled = se[0] + se[1]
    usable = (F.col("_n0") >= 2) & (F.col("_n1") >= 2) & (pooled > 0)
    df = F.try_divide(pooled * pooled, F.try_divide(se[0] * se[0], F.col("_n0") - 1) + F.try_divide(se[1] * se[1], F.col("_n1") - 1))
    return m.select(*keys, F.when(usable, F.try_divide(F.col("_m0") - F.col("_m1"), F.sqrt(pooled))).alias("t"), F.when(usable, df).alias("df"))


def welch_t(samples: DataFrame, keys: list[str], side: str = "side", base: str = "base", head: str = "head") -> DataFrame:
    """keys, t, df, p (two-tailed; 1 where the test can't be made)."""
    m = welch_moments(samples, keys, side, base, head)
    p = F.when(F.col("t").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * (1 - student_t_cdf(F.abs("t"), "df")))))
    return m.select(*keys, _or_zero(F.col("t")).alias("t"), _or_zero(F.col("df")).alias("df"), p.alias("p"))


def per_op_ns(samples: DataFrame, reading: str = "ns", size: str = "batch_size") -> DataFrame:
    """Readings of batches as time for one operation; a batch size of zero counts as one."""
    return samples.withColumn(reading, F.col(reading) / F.greatest(F.lit(1), F.col(size)))


def sufficient_prefix(samples: DataFrame, keys: list[str], least: int = 30, target_cv: float = 0.02, budget_ns: float = math.inf) -> DataFrame:
    """keys, n_samples, enough_at: the shortest prefix (in order of idx) of at least `least` samples that would have sufficed.

    It suffices if its variation is above 0 and at most target_cv, or its time reaches the budget; null if none does. The
    variance is taken as the samples' covariance with themselves, which rounds as DuckDB's stddev_samp does (Spark's rounds
    otherwise): some prefixes vary by target_cv exactly, so that the last digit decides.
    """
    prefix = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    run = samples.select(*keys, "idx", F.count(F.lit(1)).over(prefix).alias("_n"), F.avg("ns").over(prefix).alias("_m"), F.covar_samp("ns", "ns").over(prefix).alias("_v"), F.sum("ns").over(prefix).alias("_sum"))
    ratio = F.coalesce(F.try_divide(F.sqrt("_v"), F.col("_m")), F.lit(0.0))
    enough = (F.col("_n") >= least) & (((ratio > 0) & (ratio <= target_cv)) | (F.col("_sum") >= budget_ns))
    return run.groupBy(*keys).agg(F.max("_n").alias("n_samples"), F.min(F.when(enough, F.col("_n"))).alias("enough_at"))
