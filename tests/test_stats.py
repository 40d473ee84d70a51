"""Statistics against plain Python, and on degenerate groups."""

import datetime
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from deltasieve.functions import dist
from deltasieve.operators import compare, stats
from deltasieve.plans import fixtures


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(5)
    data = {"one": [7.0], "same": [3.0] * 9, "neg": [-2.0, 5.0, 1.0], "many": [rng.gauss(100, 9) for _ in range(57)]}
    return data


@pytest.fixture(scope="module")
def samples(spark, groups):
    return spark.createDataFrame([(k, i, v) for k, vs in groups.items() for i, v in enumerate(vs)], "bench string, idx bigint, ns double")


def percentile(values, p):
    s = sorted(values)
    at = p * (len(s) - 1)
    lo = math.floor(at)
    return s[lo] + (s[math.ceil(at)] - s[lo]) * (at - lo)


def test_summary(samples, groups):
    got = {r["bench"]: r for r in stats.summarize_samples(samples, ["bench"]).collect()}
    for k, v in groups.items():
        r = got[k]
        cut = int(len(v) * 0.05)
        trimmed = sorted(v)[cut : len(v) - cut] if cut else v
        assert r["mean"] == pytest.approx(statistics.fmean(v))
        assert r["stddev"] == pytest.approx(statistics.stdev(v) if len(v) > 1 else 0)
        assert r["median"] == pytest.approx(statistics.median(v))
        assert r["trimmed_mean"] == pytest.approx(statistics.fmean(trimmed))
        assert r["mad"] == pytest.approx(statistics.median(abs(x - statistics.median(v)) for x in v))
        assert r["p95"] == pytest.approx(percentile(v, 0.95))
        assert r["iqr"] == pytest.approx(percentile(v, 0.75) - percentile(v, 0.25))


def test_percentiles_by_rank_equal_the_aggregate(samples, groups):
    got = {(r["bench"], r["p"]): r["value"] for r in stats.percentiles_by_rank(samples, ["bench"], [0.0, 0.33, 0.5, 1.0]).collect()}
    for k, v in groups.items():
        for p in (0.0, 0.33, 0.5, 1.0):
            assert got[k, p] == pytest.approx(percentile(v, p))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "bench string, side string, idx bigint, ns double")
    assert stats.summarize_samples(empty, ["bench"]).count() == 0
    assert stats.mann_whitney(empty, ["bench"]).count() == 0


def rank_test(a, b):
    both = sorted(a + b)
    ranks = {v: (2 * both.index(v) + both.count(v) + 1) / 2 for v in set(both)}
    ua = sum(ranks[v] for v in a) - len(a) * (len(a) + 1) / 2
    return min(ua, len(a) * len(b) - ua)


def test_mann_whitney(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for k in range(12):
        a = [float(rng.randint(0, 9)) for _ in range(rng.randint(1, 20))]
        b = [float(rng.randint(0, 12)) for _ in range(rng.randint(1, 20))]
        want[k] = rank_test(a, b)
        rows += [(k, "base", v) for v in a] + [(k, "head", v) for v in b]
    rows += [(99, "base", 1.0), (98, "base", 2.0), (98, "head", 2.0)]
    got = {r["k"]: r for r in stats.mann_whitney(spark.createDataFrame(rows, "k int, side string, ns double"), ["k"]).collect()}
    for k, u in want.items():
        assert got[k]["u"] == pytest.approx(u)
        assert 0 <= got[k]["p"] <= 1
    assert got[99]["p"] == 1 and got[98]["p"] == 1


def test_distributions(spark):
    t = spark.createDataFrame([(2.0, 10.0), (1.0, 5.0), (2.576, 1000.0), (12.706, 1.0), (1.0, 0.0)], "t double, df double")
    p = [2 * (1 - r[0]) for r in t.select(dist.student_t_cdf(F.col("t"), F.col("df"))).collect()]
    assert p == pytest.approx([0.0733880, 0.3632175, 0.0101376, 0.0500008, 1.0], abs=1e-6)
    # Closed forms for one, two and four degrees of freedom.
    two = lambda v: 0.5 + v / (2 * math.sqrt(2 + v * v))
    four = lambda v: 0.5 + 3 / 8 * v / math.sqrt(1 + v * v / 4) * (1 - v * v / (1 + v * v / 4) / 12)
    exact = [(v, n, f(v)) for v in (-40.0, -3.0, -0.2, 0.0, 0.7, 2.5, 90.0) for n, f in ((1.0, lambda v: 0.5 + math.atan(v) / math.pi), (2.0, two), (4.0, four))]
    whole = spark.createDataFrame(exact, "t double, df double, want double").select("want", dist.student_t_cdf("t", "df").alias("p"))
    assert max(abs(r["p"] - r["want"]) for r in whole.collect()) < 1e-10
    assert "Python" not in whole._jdf.queryExecution().executedPlan().toString()
    odd = spark.createDataFrame([(0, None, 1.0), (1, 1.0, None), (2, float("nan"), 1.0), (3, float("-inf"), 1.0), (4, 1.0, -2.0), (5, 1e200, 3.0), (6, -1e200, 3.0)], "i int, t double, df double")
    got = [r[0] for r in odd.orderBy("i").select(dist.student_t_cdf("t", "df")).collect()]
    assert got[:2] == [None, None] and math.isnan(got[2]) and got[3:] == [0.5, 0.5, 1.0, 0.0]
    x = spark.createDataFrame([(-1.5,), (0.3,), (2.0,)], "x double")
    for r in x.select("x", dist.erf(F.col("x")).alias("e")).collect():
        assert r["e"] == pytest.approx(math.erf(r["x"]), abs=2e-7)


def test_gate(spark):
    base = [(("b", "base", "f", float(v))) for v in range(100, 160)]
    head = [("b", "head", "f", v * 1.3) for _, _, _, v in base]
    row = compare.compare_samples(spark.createDataFrame(base + head, "bench string, side string, file string, ns double"), ["bench"], welch=True).first()
    assert row["verdict"] == "regression"
    assert row["delta_pct"] == pytest.approx(0.3)
    assert row["p_value"] < 1e-12 and row["p_value_welch"] < 1e-12


def test_verdict_precedence(spark):
    rows = []
    for bench, base, head in (("noisy", [10.0, 100.0] * 10, [12.0, 130.0] * 10), ("small", [100.0 + i % 2 for i in range(20)], [101.0 + i % 2 for i in range(20)]), ("zero", [0.0] * 8, [5.0] * 8)):
        rows += [(bench, "base", "f", v) for v in base] + [(bench, "head", "f", v) for v in head]
    rows += [("new", "head", "f", 1.0), ("gone", "base", "x/skip.rs", 1.0), ("lost", "base", "f", 1.0)]
    df = spark.createDataFrame(rows, "bench string, side string, file string, ns double").withColumn("pair", F.lit(1))
    skipped = spark.createDataFrame([(1, "other/skip.rs")], "pair int, path string")
    got = {r["bench"]: (r["verdict"], r["neutral_reason"]) for r in compare.compare_samples(df, ["pair", "bench"], skipped=skipped, scope=["pair"]).collect()}
    assert got["noisy"] == ("neutral", "too-noisy")
    assert got["small"] == ("neutral", "below-threshold")
    assert got["zero"] == ("neutral", "below-threshold")
    assert got["new"] == ("new", None) and got["lost"] == ("removed", None) and got["gone"] == ("out-of-scope", None)


def test_no_python_in_verdict_plans(spark, samples):
    plan = compare.compare_samples(samples.withColumns({"side": F.lit("base"), "file": F.lit("f")}), ["bench"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_lines_of_one_number_are_numbered_alike_in_any_order(spark, tmp_path):
    rows = [(1, 5, 7, q, datetime.datetime(1998, 1, 1)) for q in (3.0, 1.0, 2.0)]
    for name, lines in (("up", rows), ("down", rows[::-1])):
        spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_quantity double, l_shipdate timestamp").coalesce(1).write.parquet(str(tmp_path / name / "lineitem.parquet"))
        assert sorted((r["idx"], r["ns"]) for r in fixtures.samples(spark, str(tmp_path / name)).collect()) == [(0, 10.0), (1, 20.0), (2, 30.0)]


def test_wide_groups_give_the_same(spark, samples):
    two = samples.withColumn("side", F.when(F.col("idx") % 2 == 0, "base").otherwise("head"))
    plain, wide = (sorted(map(tuple, stats.mann_whitney(two, ["bench"], wide=w).collect())) for w in (False, True))
    assert plain == wide
    plain, wide = (sorted(map(tuple, stats.percentiles_by_rank(samples, ["bench"], [0.2, 0.9], wide=w).collect())) for w in (False, True))
    assert plain == wide


def test_wide_summaries_of_rows_that_stand_for_many(spark):
    rows = [("a", x) for x in (5.0, 1.0, 1.0, 9.0, 9.0, 9.0, 2.5)] + [("b", 3.0), ("c", None), ("c", 4.0)]
    samples = spark.createDataFrame(rows, "bench string, ns double")
    pick = lambda d: {r["bench"]: [r[c] for c in ("n", "elapsed_ns", *stats.DERIVED)] for r in d.collect()}
    got, want = (pick(stats.summarize_samples(samples.where("ns IS NOT NULL"), ["bench"], wide=w)) for w in (True, False))
    assert got.keys() == want.keys() and all(got[b] == pytest.approx(want[b]) for b in want)
    counted = samples.groupBy("bench", "ns").count()
    plain, weighed = (sorted(map(tuple, stats.percentiles_by_rank(d, ["bench"], [0.5, 0.9], wide=True, **k).where("bench = 'a'").collect())) for d, k in ((samples, {}), (counted, {"weight": "count"})))
    assert plain == weighed


def test_sufficient_prefix_is_that_of_its_sql_at_the_limit_and_without_numbers(spark, tmp_path):
    """Prefixes that vary by the limit exactly end alike (quantities of 15, 25, 35), and lines without order or number come last."""
    import duckdb

    from deltasieve.plans import core

    rng, day = random.Random(1), (datetime.datetime(1995, 1, 1), datetime.datetime(1999, 1, 1))
    rows = [(o, 1, o // 30, rng.choice([15.0] * 4 + [35.0] * 4 + [25.0]), day[o // 30 % 2]) for o in range(30_000)]
    rows += [(None if i % 6 == 5 else i, None if i % 6 == 2 else 1, 2000 + i // 6, float(rng.randint(1, 50)), day[0]) for i in range(600)]
    lines = spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_quantity double, l_shipdate timestamp_ntz")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(core.sufficient(spark, str(tmp_path)).collect())
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        want = sorted(con.execute(core.ORACLE_SQL["sufficient_prefix"]).fetchall(), key=lambda r: r[:2])
    assert [tuple(r) for r in got] == want and len(want) == 1100
