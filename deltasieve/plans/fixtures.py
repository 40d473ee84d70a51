"""Deterministic views of the driver's tables in the shape of the operators' inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Head-side factor of a bench by its number: one clear gain, no change, below the threshold, and two losses.
DRIFT = (0.9013717171717171, 1.0, 1.0207717171717171, 1.1009717171717171, 1.3011717171717171)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """service, bench, file, side, idx, ns: order lines as timings, halves of the calendar as sides.

    Lines without an order or a number come last. Lines with one number, of which there are some, come in order of ns, so
    that idx doesn't depend on how rows arrive.
    """
    side = F.when(F.col("l_shipdate") < F.lit("1998-05-24").cast("timestamp"), "base").otherwise("head")
    reading = F.when(F.col("l_partkey") % 7 == 0, 10 * F.col("l_quantity")).otherwise(1000 + 10 * F.col("l_quantity"))
    drift = F.element_at(F.array(*map(F.lit, DRIFT)), (F.col("l_partkey") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(
        F.lit("svc").alias("service"),
        F.concat(F.lit("p"), F.col("l_partkey")).alias("bench"),
        F.concat(F.lit("mod_"), F.col("l_partkey") % 8, F.lit(".rs")).alias("file"),
        side.alias("side"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        (reading * F.when(side == "head", drift).otherwise(1.0)).alias("ns"),
    )
    idx = F.row_number().over(Window.partitionBy("bench", "side").orderBy(F.asc_nulls_last("l_orderkey"), F.asc_nulls_last("l_linenumber"), "ns")) - 1
    return rows.withColumn("idx", idx.cast("bigint")).drop("l_orderkey", "l_linenumber")


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples without the head of some benches and the base of others."""
    gone = ((F.col("side") == "head") & (F.col("l_partkey") % 41 == 0)) | ((F.col("side") == "base") & (F.col("l_partkey") % 43 == 0))
    return samples(spark, sf_dir).where(~gone)


SAMPLES_SQL = """
s AS (
  SELECT bench, file, side, l_partkey, ns, row_number() OVER (PARTITION BY bench, side ORDER BY l_orderkey, l_linenumber) - 1 AS idx
  FROM (SELECT *, (CASE WHEN l_partkey % 7 = 0 THEN 10 * l_quantity ELSE 1000 + 10 * l_quantity END)
               * CASE WHEN side = 'head' THEN (CASE l_partkey % 5 WHEN 0 THEN 0.9013717171717171::DOUBLE WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 1.0207717171717171::DOUBLE WHEN 3 THEN 1.1009717171717171::DOUBLE ELSE 1.3011717171717171::DOUBLE END) ELSE 1.0::DOUBLE END AS ns
        FROM (SELECT *, 'p' || l_partkey AS bench, 'mod_' || (l_partkey % 8) || '.rs' AS file,
                     CASE WHEN l_shipdate < TIMESTAMP '1998-05-24' THEN 'base' ELSE 'head' END AS side FROM lineitem)))"""

SUMMARY_SQL = """
m AS (SELECT bench, side, median(ns) AS med, count(*) AS n FROM {src} GROUP BY bench, side),
r AS (SELECT x.*, m.med, m.n, row_number() OVER (PARTITION BY x.bench, x.side ORDER BY ns) AS rn FROM {src} x JOIN m ON x.bench = m.bench AND x.side = m.side),
q AS (
  SELECT bench, side, any_value(file) AS file, count(*) AS n, sum(ns) AS elapsed_ns, avg(ns) AS mean, any_value(med) AS median,
    avg(ns) FILTER (WHERE (rn > floor(n * 0.05) AND rn <= n - floor(n * 0.05)) OR 2 * floor(n * 0.05) >= n) AS trimmed_mean,
    coalesce(stddev_samp(ns), 0) AS stddev, coalesce(stddev_samp(ns) / avg(ns), 0) AS cv, median(abs(ns - med)) AS mad,
    quantile_cont(ns, 0.75) - quantile_cont(ns, 0.25) AS iqr, min(ns) AS min, max(ns) AS max,
    quantile_cont(ns, 0.95) AS p95, quantile_cont(ns, 0.99) AS p99
  FROM r GROUP BY bench, side)"""

MANN_WHITNEY_SQL = """
c AS (SELECT bench, ns, count(*) FILTER (WHERE side = 'base') AS ca, count(*) FILTER (WHERE side = 'head') AS cb, count(*)::DOUBLE AS t FROM {src} GROUP BY bench, ns),
k AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY bench ORDER BY ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS rk FROM c),
u0 AS (SELECT bench, sum(ca)::DOUBLE AS na, sum(cb)::DOUBLE AS nb, sum(ca * rk) AS ra, sum(t * t * t - t) AS ties FROM k GROUP BY bench),
u1 AS (SELECT bench, na, nb, CASE WHEN na = 0 OR nb = 0 THEN 0 ELSE least(ra - na * (na + 1) / 2, na * nb - (ra - na * (na + 1) / 2)) END AS u,
         na * nb / 12 * (na + nb + 1 - coalesce(ties / nullif((na + nb) * (na + nb - 1), 0), 0)) AS v FROM u0),
u2 AS (SELECT bench, u, CASE WHEN na > 0 AND nb > 0 AND v > 0 THEN greatest(0, abs(u - na * nb / 2) - 0.5) / sqrt(v) END AS z FROM u1),
u3 AS (SELECT bench, u, z, z / sqrt(2.0) AS a, 1 / (1 + 0.3275911 * (z / sqrt(2.0))) AS t FROM u2),
mw AS (SELECT bench, u, coalesce(z, 0) AS z, CASE WHEN z IS NULL THEN 1.0 ELSE least(1.0, greatest(0.0,
         CASE WHEN z = 0 THEN 1 + (1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-a * a))
              ELSE 1 - (1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-a * a)) END)) END AS p FROM u3)"""

COMPARE_SQL = """
d0 AS (
  SELECT coalesce(b.bench, h.bench) AS bench, coalesce(b.file, h.file) AS file, b.bench IS NOT NULL AS has_b, h.bench IS NOT NULL AS has_h,
    b.median AS b_median, h.median AS h_median, b.cv AS b_cv, h.cv AS h_cv, b.p95 AS b_p95, h.p95 AS h_p95, b.mean AS b_mean, h.mean AS h_mean
  FROM (SELECT * FROM q WHERE side = 'base') b FULL OUTER JOIN (SELECT * FROM q WHERE side = 'head') h ON b.bench = h.bench),
d1 AS (
  SELECT d0.*, CASE WHEN has_b AND has_h THEN CASE WHEN b_median = 0 THEN 0 ELSE (h_median - b_median) / b_median END END AS delta,
    CASE WHEN has_b AND has_h THEN CASE WHEN b_mean = 0 THEN 0 ELSE (h_mean - b_mean) / b_mean END END AS mean_delta,
    CASE WHEN has_b AND has_h THEN greatest(b_cv, h_cv) END AS max_cv, CASE WHEN has_b AND has_h THEN mw.p END AS p_value
  FROM d0 LEFT JOIN mw ON d0.bench = mw.bench),
d2 AS (
  SELECT *, CASE WHEN has_b AND has_h THEN CASE WHEN max_cv > 0.25 AND abs(delta) < 2 * max_cv THEN 'too-noisy' WHEN abs(delta) < 0.05 THEN 'below-threshold' WHEN p_value >= 0.05 THEN 'not-significant' END END AS neutral_reason
  FROM d1),
d AS (
  SELECT *, CASE WHEN NOT has_b THEN 'new' WHEN NOT has_h THEN CASE WHEN file = 'mod_3.rs' AND {scoped} THEN 'out-of-scope' ELSE 'removed' END
    WHEN neutral_reason IS NOT NULL THEN 'neutral' WHEN delta > 0 THEN 'regression' ELSE 'improvement' END AS verdict
  FROM d2)"""
INVENTORY_SQL = "v AS (SELECT * FROM s WHERE NOT ((side = 'head' AND l_partkey % 41 = 0) OR (side = 'base' AND l_partkey % 43 = 0)))"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: two links from each part, within blocks of 16, with cycles; some lead to parts that aren't there."""
    key = F.col("p_partkey")
    block = F.expr("p_partkey div 16 * 16")
    return table(spark, sf_dir, "part").select(key.alias("src"), F.explode(F.array(block + (7 * key + 3) % 16, block + F.expr("p_partkey % 16 div 2"))).alias("dst"))


#: Documents in a repository, and in a review.
REPO, REVIEW = 1000, 200


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, path, language, content: documents as source files: imports and symbols by arithmetic on doc_id, then the text."""
    i = F.col("doc_id")
    ext = F.element_at(F.array(F.lit("ts"), F.lit("go"), F.lit("rs")), (i % 3 + 1).cast("int"))
    path = lambda n: F.concat(F.lit("doc_"), n.cast("string"))
    ts = F.concat(F.lit("import x from './"), path(i + 3), F.lit("';\nimport '../s/"), path(i + 6), F.lit(".ts';\n// import './gone'\nconst y = require('lib');\nf"), i.cast("string"), F.lit("(1);\nexport function f"), i.cast("string"), F.lit("(a) {\n  g"), (i % 7).cast("string"), F.lit("(a);\n}\nfunction g"), (i % 7).cast("string"), F.lit("(b) { if (b) f"), i.cast("string"), F.lit("(b); }\n"))
    go = F.concat(F.lit("package a\nimport \"fmt\"\nimport (\n  \"os\"\n  z \"./pkg\"\n)\nfunc h"), i.cast("string"), F.lit("() {\n  k()\n}\r\nfunc k() { h"), i.cast("string"), F.lit("() }\ntype T"), i.cast("string"), F.lit(" struct {}\n"))
    rs = F.concat(F.lit("mod "), path(i + 3), F.lit(";\n/* mod gone; */\n\tpub fn m"), i.cast("string"), F.lit("() {\n  n()\n}\nfn n() { m"), i.cast("string"), F.lit("() }\ninclude!(\"doc_"), (i + 6).cast("string"), F.lit(".rs\");\n"))
    body = F.when(i % 3 == 0, ts).when(i % 3 == 1, go).otherwise(rs)
    lang = F.when(i % 3 == 0, "ts").when(i % 3 == 1, "go").otherwise("rust")
    repo = F.concat(F.lit("r"), F.expr(f"doc_id div {REPO}"))
    return table(spark, sf_dir, "documents").select(repo.alias("repo"), "doc_id", F.concat(F.lit("s/"), path(i), F.lit("."), ext).alias("path"), lang.alias("language"), F.concat(body, F.coalesce("text", F.lit(""))).alias("content"))


FILES_SQL = r"""
f AS (
  SELECT 'r' || (i // 1000) AS repo, i, 's/doc_' || i || '.' || CASE i % 3 WHEN 0 THEN 'ts' WHEN 1 THEN 'go' ELSE 'rs' END AS path,
    CASE i % 3 WHEN 0 THEN 'ts' WHEN 1 THEN 'go' ELSE 'rust' END AS language,
    CASE i % 3
      WHEN 0 THEN 'import x from ''./doc_' || (i + 3) || chr(39) || ';' || chr(10) || 'import ''../s/doc_' || (i + 6) || '.ts'';' || chr(10) || '// import ''./gone' || chr(39) || chr(10) || 'const y = require(''lib'');' || chr(10) || 'f' || i || '(1);' || chr(10) || 'export function f' || i || '(a) {' || chr(10) || '  g' || (i % 7) || '(a);' || chr(10) || '}' || chr(10) || 'function g' || (i % 7) || '(b) { if (b) f' || i || '(b); }' || chr(10)
      WHEN 1 THEN 'package a' || chr(10) || 'import "fmt"' || chr(10) || 'import (' || chr(10) || '  "os"' || chr(10) || '  z "./pkg"' || chr(10) || ')' || chr(10) || 'func h' || i || '() {' || chr(10) || '  k()' || chr(10) || '}' || chr(13) || chr(10) || 'func k() { h' || i || '() }' || chr(10) || 'type T' || i || ' struct {}' || chr(10)
      ELSE 'mod doc_' || (i + 3) || ';' || chr(10) || '/* mod gone; */' || chr(10) || chr(9) || 'pub fn m' || i || '() {' || chr(10) || '  n()' || chr(10) || '}' || chr(10) || 'fn n() { m' || i || '() }' || chr(10) || 'include!("doc_' || (i + 6) || '.rs");' || chr(10)
    END || coalesce(text, '') AS content
  FROM (SELECT doc_id AS i, text FROM documents))"""

PERSONAS = ("correctness", "security", "performance", "maintainability")
SEVERITIES = ("nit", "minor", "major", "critical")


def _pick(values: tuple, n) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, pr, seq, file, line, severity, sev_rank, category, title, rationale, suggestion, raised_by from documents."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("r"), F.expr(f"doc_id div {REPO}")).alias("repo"),
        F.expr(f"doc_id div {REVIEW}").alias("pr"),
        i.alias("seq"),
        F.col("source").alias("file"),
        F.when(i % 11 == 0, None).otherwise(i % 40).cast("bigint").alias("line"),
        _pick(SEVERITIES, i).alias("severity"),
        (i % 4).cast("int").alias("sev_rank"),
        _pick(PERSONAS, F.expr("doc_id div 4")).alias("category"),
        F.substring_index("text", ".", 1).alias("title"),
        F.col("text").alias("rationale"),
        F.when(i % 6 == 0, F.concat(F.lit("try "), i.cast("string"))).alias("suggestion"),
        _pick(PERSONAS, F.expr("doc_id div 4")).alias("raised_by"),
    )


FINDINGS_SQL = """
fi AS (
  SELECT 'r' || (doc_id // 1000) AS repo, doc_id // 200 AS pr, doc_id AS seq, source AS file, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id % 40 END AS line,
    CASE doc_id % 4 WHEN 0 THEN 'nit' WHEN 1 THEN 'minor' WHEN 2 THEN 'major' ELSE 'critical' END AS severity, doc_id % 4 AS sev_rank,
    CASE (doc_id // 4) % 4 WHEN 0 THEN 'correctness' WHEN 1 THEN 'security' WHEN 2 THEN 'performance' ELSE 'maintainability' END AS category,
    split_part(text, '.', 1) AS title, text AS rationale, CASE WHEN doc_id % 6 = 0 THEN 'try ' || doc_id END AS suggestion
  FROM documents)"""

#: Documents in a diff, a file each.
DIFF = 40


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, pr, diff: unified diffs of DIFF documents each, with a piece for each document."""
    i = F.col("doc_id").cast("string")
    n = F.col("doc_id")
    path = F.when(n % 10 == 0, F.concat(F.lit("vendor/v"), i, F.lit("/Cargo.lock"))).otherwise(F.concat(F.lit("src/m"), (n % 4).cast("string"), F.lit("/f"), i, F.lit(".rs")))
    lines = F.transform(F.split("text", "\n"), lambda t, k: F.concat(F.when(k % 3 == 0, "+").when(k % 3 == 1, "-").otherwise(" "), t))
    header = F.when(n % 9 == 0, F.concat(F.lit("new file mode 100644\n--- /dev/null\n+++ b/"), path)).when(n % 9 == 1, F.concat(F.lit("deleted file mode 100644\n--- a/"), path, F.lit("\n+++ /dev/null"))).otherwise(F.concat(F.lit("--- a/"), path, F.lit("\n+++ b/"), path))
    body = F.when(n % 9 == 2, F.lit("rename from x\nrename to y")).otherwise(F.concat(header, F.lit("\n@@ -1 +1 @@\n"), F.array_join(lines, "\n")))
    piece = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n"), body)
    repo, pr = F.concat(F.lit("r"), F.expr(f"doc_id div {REPO}")).alias("repo"), F.expr(f"doc_id div {DIFF}").alias("pr")
    rows = table(spark, sf_dir, "documents").select(repo, pr, n.alias("doc_id"), piece.alias("piece"))
    whole = rows.groupBy("repo", "pr").agg(F.sort_array(F.collect_list(F.struct("doc_id", "piece"))).alias("p"))
    return whole.select("repo", "pr", F.array_join(F.transform("p", lambda x: x["piece"]), "\n").alias("diff"))


DIFFS_SQL = r"""
df AS (
  SELECT 'r' || (n // 1000) AS repo, n // 40 AS pr, n, path, n % 9 = 0 AS is_new, n % 9 = 1 AS is_deleted, n % 9 = 2 AS is_pure_rename,
    CASE WHEN n % 9 = 2 THEN '' ELSE body END AS body,
    'diff --git a/' || path || ' b/' || path || chr(10) || CASE WHEN n % 9 = 2 THEN 'rename from x' || chr(10) || 'rename to y' ELSE
      CASE n % 9 WHEN 0 THEN 'new file mode 100644' || chr(10) || '--- /dev/null' || chr(10) || '+++ b/' || path WHEN 1 THEN 'deleted file mode 100644' || chr(10) || '--- a/' || path || chr(10) || '+++ /dev/null' ELSE '--- a/' || path || chr(10) || '+++ b/' || path END
      || chr(10) || '@@ -1 +1 @@' || body END AS piece
  FROM (SELECT doc_id AS n, text, CASE WHEN doc_id % 10 = 0 THEN 'vendor/v' || doc_id || '/Cargo.lock' ELSE 'src/m' || (doc_id % 4) || '/f' || doc_id || '.rs' END AS path,
          chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda t, k: CASE (k - 1) % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE ' ' END || t), chr(10)) AS body FROM documents)),
dp AS (
  SELECT *, row_number() OVER (PARTITION BY pr ORDER BY n) - 1 AS pos,
    len(regexp_extract_all(body, '\n\+')) AS additions, len(regexp_extract_all(body, '\n-')) AS deletions FROM df)"""
