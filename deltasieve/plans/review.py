"""Queries on findings, the feedback corpus and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus as co
from ..operators import evals as ev
from ..operators import findings as fi
from ..options import GuidanceOptions, ScoreOptions
from . import fixtures as fx
from .core import _rounded

NOW = "2026-01-01T00:00:00Z"
FLOOR = 0.5


def _case(c: F.Column, *values) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (c % len(values) + 1).cast("int"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reviewer's raw response for each document: JSON with fences, prose and defects by modulus."""
    i = F.col("seq")
    item = F.struct("file", "line", _case(i, "High", "\tblocker ", "weird", None, "Trivial").alias("severity"), _case(i, "perf", "Logic", "zzz").alias("category"), F.when(i % 17 == 0, " ").otherwise(F.concat(F.lit("\t t"), i.cast("string"), F.lit("\r\n"))).alias("title"), F.concat(F.lit(" \n"), "rationale", F.lit("\u2003")).alias("rationale"), "suggestion")
    good = F.to_json(F.struct(F.array(item).alias("findings")))
    bad = F.when(i % 26 == 0, F.lit('{"findings":[{"title":7}]}')).otherwise(F.lit('{"findings":[{"title":"x","line":-1}]}'))
    text = F.when(i % 13 == 0, bad).otherwise(good)
    raw = F.when(i % 7 == 0, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).when(i % 5 == 0, F.concat(F.lit("Here it is: "), text, F.lit(" Done."))).otherwise(text)
    return fx.findings(spark, sf_dir).select("repo", "pr", i.alias("chunk_idx"), F.col("raised_by").alias("persona"), raw.alias("raw"), (i % 100).alias("duration_ms"), (i % 9).alias("prompt_tokens"), (i % 4).alias("completion_tokens"), F.when((i % 4 == 3) & (F.col("pr") % 3 == 1), F.lit("timeout")).alias("error"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("seq")
    verdict = F.when(s % 7 == 0, "drop").when(s % 7 == 1, "downgrade").otherwise("keep")
    return fx.findings(spark, sf_dir).withColumns({"verdict": verdict, "confidence": (s % 10) / 10})


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.parse_findings(responses(spark, sf_dir)).select("chunk_idx", "file", "line", "severity", "category", "title", F.md5("rationale").alias("rationale"), "suggestion", "raised_by")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.findings(spark, sf_dir).select("repo", "pr", (F.col("seq") % fx.REVIEW).alias("index"))
    item = F.struct("index", _case(F.col("index"), "Reject", "soften", "keep", "??").alias("verdict"), (F.col("index") % 30 / 10 - 0.5).alias("confidence"))
    told = c.where("index % 3 <> 0").groupBy("repo", "pr").agg(F.sort_array(F.collect_list(item)).alias("verdicts"))
    raw = told.select("repo", "pr", F.concat(F.lit("Sure. "), F.to_json(F.struct("verdicts"))).alias("raw"))
    return _rounded(fi.parse_verdicts(raw, c).select("pr", "index", "verdict", "confidence"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.near_duplicate_pairs(fx.findings(spark, sf_dir)).select("file", "a", "b")


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.merge_findings(fx.findings(spark, sf_dir)).withColumn("rationale", F.md5("rationale"))


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.rank_findings(fx.findings(spark, sf_dir)).select("pr", "seq", "rank")


def applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.apply_verdicts(judged(spark, sf_dir)).select("seq", "severity", "sev_rank")


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.shippable(judged(spark, sf_dir), FLOOR).select("pr", "seq", "place")


def critical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.has_critical(fi.shippable(judged(spark, sf_dir), FLOOR).where("pr % 3 <> 2 OR sev_rank < 3")).select("pr", "critical")


def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fx.findings(spark, sf_dir).select("repo", "pr", F.col("file").alias("path"), (F.col("seq") % 3 > 0).alias("kept"))
    return fi.review_summary(judged(spark, sf_dir), fx.findings(spark, sf_dir), responses(spark, sf_dir), files, FLOOR).drop("repo")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = fi.reviewer_telemetry(responses(spark, sf_dir), fx.findings(spark, sf_dir).where("raised_by <> 'security'"))
    return rows.drop("repo")


def degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.reviewer_telemetry(responses(spark, sf_dir), fx.findings(spark, sf_dir))[1].select("pr", F.array_join("failed", ",").alias("failed"))


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.category_counts(fi.shippable(judged(spark, sf_dir), FLOOR)).drop("repo")


def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.findings(spark, sf_dir).select("repo", "pr", (F.col("seq") % fx.REVIEW + 1).alias("index"), F.when(F.col("seq") % 8 == 0, "drop").when(F.col("seq") % 8 == 1, "keep").when(F.col("seq") % 50 == 2, "keep-rest").when(F.col("seq") % 50 == 28, "drop-rest").alias("action"), F.col("seq").alias("at")).where("action IS NOT NULL")
    return fi.apply_curation(judged(spark, sf_dir), d, FLOOR).select("pr", "seq", "verdict")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, pr, id, body, user_login, author_association, reactions, created_at from conversations, 40 to a review."""
    t, c = F.col("turn"), F.col("conv_id")
    body = F.when(t % 4 == 0, F.concat(F.lit("hello\n \tBOT: remember "), "text", F.lit(" \r\nbye"))).when(t % 4 == 1, F.concat(F.lit("@bot good catch on #"), t)).when(t % 4 == 2, F.concat(F.lit("bot: False positive on "), c % 90)).otherwise(F.concat(F.lit("<!-- marker -->"), "text"))
    reactions = F.struct(*[((c + k) % 3).cast("int").alias(n) for k, n in enumerate(("plus_one", "minus_one", "heart", "hooray", "rocket", "confused"))])
    rows = fx.table(spark, sf_dir, "conversations").withColumn("text", F.regexp_replace("text", "\n", " "))
    pr = F.expr("conv_id div 40")
    repo = F.concat(F.lit("r"), F.expr(f"conv_id div 40 div {fx.REPO // fx.REVIEW}"))
    return rows.select(repo.alias("repo"), pr.alias("pr"), (c * 100 + t).alias("id"), body.alias("body"), F.when(t % 5 == 4, "Robot").otherwise("ann").alias("user_login"), _case(c, "OWNER", "NONE", "member").alias("author_association"), reactions.alias("reactions"), F.when(c % 2 == 0, "2025-06-01T00:00:00Z").otherwise("").alias("created_at"))


def directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.parse_directives(co.trusted(comments(spark, sf_dir), bot="robot"), "bot").select("id", "at", "kind", "text", "index")


_ENTRY = ["repo", "id", "guidance", "file_glob", "category", "strongest_kind", "source_pr", "source_comment_id", "confirmations", "refutations", "first_seen", "last_seen"]


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = co.parse_directives(co.trusted(comments(spark, sf_dir), bot="robot"), "bot")
    return co.directives_to_entries(d, fi.shippable(judged(spark, sf_dir), FLOOR), NOW).select(*_ENTRY)


def reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    system, _ = co.split_comments(comments(spark, sf_dir), "<!-- marker -->")
    return co.reactions_to_entries(system, fi.shippable(judged(spark, sf_dir), FLOOR), NOW).select(*_ENTRY)


def _entries_of(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """Entries told by documents, with whole texts as guidance: those with the text of another one have its id.

    Of the new ones, two thirds are told again by the same text, the others are new.
    """
    i = F.col("doc_id")
    told = F.concat(F.lit("e"), F.md5("text"))
    return fx.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("r"), F.expr(f"doc_id div {fx.REPO}")).alias("repo"),
        F.when((i % 3 == 0) & F.lit(new), F.concat(F.lit("n"), i)).otherwise(told).alias("id"),
        F.when(i % 19 == 0, "\t").otherwise(F.concat(F.lit("again: " if new else ""), "text")).alias("guidance"),
        _case(i, None, "src/**", "*.rs", "src/m1/*").alias("file_glob"),
        _case(i, *fx.PERSONAS, None).alias("category"),
        _case(i, *co.AUTHORITY).alias("strongest_kind"),
        i.alias("source_pr"),
        F.when(i % 4 > 0, i).alias("source_comment_id"),
        (i % 4).cast("int").alias("confirmations"),
        (i % 3).cast("int").alias("refutations"),
        F.concat(F.lit("2025-01-01T00:00:"), F.lpad((i % 60).cast("string"), 2, "0"), F.lit("Z")).alias("first_seen"),
        F.when(i % 11 == 0, "bad").otherwise(F.concat(F.lit("2025-"), F.lpad((i % 12 + 1).cast("string"), 2, "0"), F.lit("-15T00:00:00Z"))).alias("last_seen"),
    )


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored corpus: of entries with one id in a repository, the first."""
    rows = _entries_of(spark, sf_dir, False)
    first = rows.groupBy("repo", "id").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("repo", "id")]), "source_pr").alias("e"))
    return first.select("repo", "id", "e.*")


def merged_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = co.merge_entries(_corpus(spark, sf_dir), _entries_of(spark, sf_dir, True))
    return m.withColumn("guidance", F.md5("guidance"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.score_entries(_corpus(spark, sf_dir), NOW)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_scored(spark, sf_dir).select("repo", "id", "score"), 6)


KEEP = ScoreOptions(keep=120)


def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = co.compact(_corpus(spark, sf_dir), NOW, KEEP)
    return kept.select("repo", "id", "place")


def evicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.compact(_corpus(spark, sf_dir), NOW, KEEP)[1]


def _guided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guidance for changes of each document's file; every third repository has none."""
    i = F.col("doc_id")
    repo = F.expr(f"doc_id div {fx.REPO}")
    path = F.concat(F.when(i % 2 == 0, "src/m1/f").otherwise("lib/f"), "doc_id", F.lit(".rs"))
    files = fx.table(spark, sf_dir, "documents").select(F.concat(F.lit("r"), F.when(repo % 3 == 2, F.lit(-1)).otherwise(repo)).alias("repo"), path.alias("path"))
    return co.select_guidance(_scored(spark, sf_dir), files, "security", GuidanceOptions(keep=12))


def guided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _guided(spark, sf_dir).select("repo", "id", "place")


def guided_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guidance for two reviews of each repository: one of some files, one of none that any glob names."""
    i = F.col("doc_id")
    path = F.when(i % 3 == 0, F.concat(F.lit("lib/f"), "doc_id", F.lit(".go"))).when(i % 3 == 1, F.concat(F.lit("src/m1/f"), "doc_id"))
    files = fx.table(spark, sf_dir, "documents").select(F.concat(F.lit("r"), F.expr(f"doc_id div {fx.REPO}")).alias("repo"), (i % 3).alias("pr"), path.alias("path"))
    return co.select_guidance(_scored(spark, sf_dir), files, "security", GuidanceOptions(keep=12)).select("repo", "pr", "id", "place")


def budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.budget_prefix(co.guidance_lines(_guided(spark, sf_dir)), GuidanceOptions(limit=6000))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(co.corpus_listing(_scored(spark, sf_dir), 20), 2)


def _eval(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Cases of 50 documents in two runs: good documents are labels, toxic ones name paths that must not be found."""
    i = F.col("doc_id")
    d = fx.table(spark, sf_dir, "documents").join(fx.table(spark, sf_dir, "labels"), "doc_id")
    keyed = lambda x: [F.concat(F.lit("run"), x % 2).alias("run"), F.floor(x / 50).alias("case")]
    expected = d.where("quality = 1").select(*keyed(i), i.alias("ord"), F.col("source").alias("file"), F.when(i % 3 > 0, i % 40 - 4).alias("line_lo"), F.when(i % 3 > 0, i % 40 + 4).alias("line_hi"), (i % 4).cast("int").alias("sev_rank"), F.when(i % 5 > 0, _case(F.expr("doc_id div 4"), *fx.PERSONAS)).alias("category"), (i % 2 == F.floor(i / 50) % 2).alias("must_catch"))
    forbidden = d.where("toxic = 1").select(*keyed(i), F.col("source").alias("path")).distinct()
    found = judged(spark, sf_dir).select(*keyed(F.col("seq")), "seq", "file", "line", "severity", "sev_rank", "category", "title", "verdict", "confidence")
    cases = fx.table(spark, sf_dir, "documents").groupBy(*keyed(i)).agg(F.sum(i % 100).alias("duration_ms"), F.sum(i % 9).alias("prompt_tokens"), F.sum(i % 4).alias("completion_tokens"))
    cases = cases.withColumns({"max_findings": F.when(F.col("case") % 4 == 0, 8), "judge_error": F.when(F.col("case") % 5 == 0, "timeout")})
    return {"cases": cases, "expected": expected, "forbidden": forbidden, "judged": found}


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _eval(spark, sf_dir)
    return ev.match_candidates(e["expected"], e["judged"])


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.score_cases(**_eval(spark, sf_dir), floor=FLOOR), 6)


def case_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ev.score_cases(**_eval(spark, sf_dir), floor=FLOOR)
    return c.select("run", "case", "expected_total", "findings_total", "findings_forbidden", "over_cap", *[f"{s}_total" for s in ev.SEVERITIES])


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.score_corpus(ev.score_cases(**_eval(spark, sf_dir), floor=FLOOR)), 6)


FLOORS = [0.3, 0.5, 0.8]
SWEPT = ["critical_recall", "judge_brier_score", "avg_false_positives_per_case"]


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _eval(spark, sf_dir)
    s = ev.recalibrate(ev.finding_records(e["judged"]), e["cases"], e["expected"], e["forbidden"], FLOORS)
    return _rounded(ev.sweep_table(s, SWEPT), 6)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.finding_records(_eval(spark, sf_dir)["judged"])


def _metric_rows(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    li = fx.table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag)
    a = li.agg(F.avg("l_discount").alias("critical_recall"), (F.avg("l_tax") * 10).alias("critical_f1"), (F.avg("l_quantity") / 25).alias("judge_brier_score"), F.count_if(F.col("l_linenumber") == 7).cast("double").alias("forbidden_path_findings"), (F.avg("l_extendedprice") / 1e4).alias("avg_false_positives_per_case"))
    return a.unpivot([], a.columns, "metric", "value")


def regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.eval_regressions(_metric_rows(spark, sf_dir, "R"), _metric_rows(spark, sf_dir, "N"), True, False), 6)


def run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.eval_diff(_metric_rows(spark, sf_dir, "R"), _metric_rows(spark, sf_dir, "A"), ["metric"]), 6)


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.samples(spark, sf_dir).select((F.col("l_partkey") % 5).alias("scenario"), F.col("l_partkey").alias("trial"), "side", "ns")
    return ev.gate_calibration(t)


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_rates(spark, sf_dir), 6)


def expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _rates(spark, sf_dir).withColumn("scenario", _case(F.col("scenario"), "gain", "null", "small", "borderline", "loss"))
    bounds = spark.createDataFrame([("null", None, 0.05, None, None, 0.9, None), ("borderline", 0.2, None, None, None, None, None), ("loss", 0.99, None, None, 0.0, None, 0.9)], "scenario string, min_regression_rate double, max_regression_rate double, min_improvement_rate double, max_improvement_rate double, min_neutral_rate double, min_too_noisy_rate double")
    return ev.check_expectations(names, bounds)


def expected_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expectations(spark, sf_dir).select("scenario", "passed", F.array_join("failures", ",").alias("failures"))


def calibration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.calibration_summary(expectations(spark, sf_dir)), 6)


QUERIES = {
    "parse_findings": parsed,
    "parse_verdicts": verdicts,
    "near_duplicate_pairs": pairs,
    "merge_findings": merged,
    "rank_findings": ranked,
    "apply_verdicts": applied,
    "shippable": shipped,
    "has_critical": critical,
    "review_summary": review_summary,
    "reviewer_telemetry": telemetry,
    "degraded_reviewers": degraded,
    "category_counts": categories,
    "apply_curation": curated,
    "parse_directives": directives,
    "directive_entries": entries,
    "reaction_entries": reactions,
    "merge_entries": merged_corpus,
    "score_entries": scored,
    "compact_corpus": compacted,
    "evicted_entries": evicted,
    "select_guidance": guided,
    "guidance_of_reviews": guided_reviews,
    "budget_prefix": budgeted,
    "corpus_listing": listing,
    "match_candidates": candidates,
    "score_cases": cases,
    "case_findings": case_findings,
    "eval_summary": eval_summary,
    "recalibrate": sweep,
    "finding_records": records,
    "eval_regressions": regressions,
    "eval_diff": run_diff,
    "gate_calibration": calibration,
    "check_expectations": expected_failures,
    "calibration_summary": calibration_summary,
}

_F = f"WITH RECURSIVE {fx.FINDINGS_SQL}, ju AS (SELECT *, CASE seq % 7 WHEN 0 THEN 'drop' WHEN 1 THEN 'downgrade' ELSE 'keep' END AS verdict, (seq % 10) / 10 AS confidence FROM fi), sh AS (SELECT *, row_number() OVER (PARTITION BY pr ORDER BY sev_rank DESC, category, title, seq) - 1 AS place FROM ju WHERE verdict <> 'drop' AND confidence >= 0.5)"
_SEV = "['nit', 'minor', 'major', 'critical']"
_CM = r"""cm AS (SELECT conv_id AS c, turn AS t, conv_id // 40 AS pr, 'r' || (conv_id // 200) AS repo, conv_id * 100 + turn AS id, replace(text, chr(10), ' ') AS text FROM conversations),
di AS (
  SELECT *, CASE t % 4 WHEN 0 THEN 1 ELSE 0 END AS "at", CASE t % 4 WHEN 0 THEN 'remember' WHEN 1 THEN 'good' ELSE 'bad' END AS kind,
    CASE WHEN t % 4 = 0 THEN trim(text) END AS txt, CASE t % 4 WHEN 1 THEN t WHEN 2 THEN c % 90 END AS idx,
    CASE WHEN c % 2 = 0 THEN '2025-06-01T00:00:00Z' ELSE '2026-01-01T00:00:00Z' END AS seen
  FROM cm WHERE t % 4 < 3 AND t % 5 <> 4 AND c % 3 IN (0, 2))"""
_GLOB = "CASE WHEN strpos(file, '/') = 0 THEN file ELSE split_part(file, '/', 1) || '/**' END"
_CO = r"""WITH en AS (
  SELECT doc_id AS i, 'r' || (doc_id // 1000) AS repo, text, CASE WHEN doc_id % 19 = 0 THEN chr(9) ELSE text END AS guidance,
    [NULL, 'src/**', '*.rs', 'src/m1/*'][doc_id % 4 + 1] AS gl, ['correctness', 'security', 'performance', 'maintainability', NULL][doc_id % 5 + 1] AS cat,
    ['user-directive', 'confirmed', 'inferred-applied', 'refuted', 'inferred-ignored'][doc_id % 5 + 1] AS kind, [100, 50, 25, 5, 10][doc_id % 5 + 1] AS rk,
    CASE WHEN doc_id % 4 > 0 THEN doc_id END AS cid, doc_id % 4 AS conf, doc_id % 3 AS ref, '2025-01-01T00:00:' || lpad((doc_id % 60)::VARCHAR, 2, '0') || 'Z' AS born,
    CASE WHEN doc_id % 11 = 0 THEN 'bad' ELSE '2025-' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') || '-15T00:00:00Z' END AS seen, doc_id % 12 + 1 AS mon FROM documents),
co AS (SELECT *, 'e' || md5(text) AS id FROM en QUALIFY row_number() OVER (PARTITION BY repo, md5(text) ORDER BY i) = 1),
sc AS (SELECT *, greatest(0, ([5.0, 2.0, 1.0, 0.0, 0.5][i % 5 + 1]::DOUBLE + conf - 2 * ref)
    * CASE WHEN seen = 'bad' THEN 0.1 ELSE pow(0.5, (epoch(TIMESTAMP '2026-01-01') - epoch(make_timestamp(2025, mon, 15, 0, 0, 0))) / 86400.0 / 60.0) END) AS score FROM co)"""
_G = _CO + r""", ch AS (SELECT 'r' || (doc_id // 1000) AS repo, max((doc_id % 2 = 0)::INT) AS m1 FROM documents WHERE doc_id // 1000 % 3 <> 2 GROUP BY 1), gu AS (
  SELECT sc.*, row_number() OVER (PARTITION BY sc.repo ORDER BY score DESC, id) AS place FROM sc LEFT JOIN ch ON sc.repo = ch.repo
  WHERE (cat IS NULL OR cat = 'security') AND (m1 IS NULL OR gl IS NULL OR gl = '*.rs' OR m1 = 1)), gk AS (SELECT * FROM gu WHERE place <= 12)"""
_FLAT = "trim(regexp_replace(replace(regexp_replace(guidance, '[\\x00-\\x08\\x0a-\\x1f\\x7f-\\x9f]', ' ', 'g'), '```', '`' || chr(8203) || '`' || chr(8203) || '`'), '[\\s\\x0b\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{a0}\\x{85}]+', ' ', 'g'))"
_EV = f"""{_F}, la AS (SELECT d.doc_id AS i, source, quality, toxic FROM documents d JOIN labels USING (doc_id)),
ex AS (SELECT 'run' || (i % 2) AS run, i // 50 AS "case", i AS ord, source AS file, CASE WHEN i % 3 > 0 THEN i % 40 - 4 END AS lo, CASE WHEN i % 3 > 0 THEN i % 40 + 4 END AS hi, i % 4 AS sev, CASE WHEN i % 5 > 0 THEN ['correctness', 'security', 'performance', 'maintainability'][(i // 4) % 4 + 1] END AS cat, i % 2 = i // 50 % 2 AS must FROM la WHERE quality = 1),
fo AS (SELECT DISTINCT 'run' || (i % 2) AS run, i // 50 AS "case", source AS path FROM la WHERE toxic = 1),
fj AS (SELECT 'run' || (seq % 2) AS run, seq // 50 AS "case", * EXCLUDE (repo, pr) FROM ju),
kc AS (SELECT 'run' || (doc_id % 2) AS run, doc_id // 50 AS "case", sum(doc_id % 100) AS duration_ms, sum(doc_id % 9) AS prompt_tokens, sum(doc_id % 4) AS completion_tokens FROM documents GROUP BY 1, 2),
fl AS (SELECT unnest([0.0, 0.3, 0.5, 0.8]::DOUBLE[]) AS floor),
ca AS (SELECT e.run, e."case", ord, seq, must, sev FROM ex e JOIN fj f ON e.run = f.run AND e."case" = f."case" AND (suffix(e.file, f.file) OR suffix(f.file, e.file)) AND (lo IS NULL OR (line >= lo AND line <= hi)) AND (cat IS NULL OR cat = f.category))"""
# Labels in order take their first finding that none before has taken: a step for each label of a case.
_AS = _EV + """, sf AS (SELECT floor, fj.* FROM fj, fl WHERE verdict <> 'drop' AND confidence >= floor),
cl AS (SELECT floor, c.run, c."case", c.ord, list(c.seq ORDER BY c.seq) AS seqs, row_number() OVER (PARTITION BY floor, c.run, c."case" ORDER BY c.ord) AS nth FROM ca c JOIN sf USING (run, "case", seq) GROUP BY floor, c.run, c."case", c.ord),
st AS (SELECT floor, run, "case", 0::BIGINT AS nth, NULL::BIGINT AS ord, NULL::BIGINT AS seq, []::BIGINT[] AS used FROM (SELECT DISTINCT floor, run, "case" FROM cl)
  UNION ALL SELECT st.floor, st.run, st."case", cl.nth, cl.ord, list_filter(cl.seqs, lambda s: NOT list_contains(st.used, s))[1], CASE WHEN list_filter(cl.seqs, lambda s: NOT list_contains(st.used, s))[1] IS NULL THEN st.used ELSE list_append(st.used, list_filter(cl.seqs, lambda s: NOT list_contains(st.used, s))[1]) END
  FROM st JOIN cl ON cl.floor = st.floor AND cl.run = st.run AND cl."case" = st."case" AND cl.nth = st.nth + 1),
pa AS (SELECT floor, run, "case", ord, seq FROM st WHERE seq IS NOT NULL),
le AS (SELECT fl.floor, ex.*, p.seq, f.sev_rank AS model FROM ex CROSS JOIN fl LEFT JOIN pa p ON p.floor = fl.floor AND p.run = ex.run AND p."case" = ex."case" AND p.ord = ex.ord LEFT JOIN fj f ON f.run = p.run AND f."case" = p."case" AND f.seq = p.seq),
pl AS (SELECT floor, run, "case", count(*) FILTER (WHERE must) AS expected_total, count(*) FILTER (WHERE must AND seq IS NOT NULL) AS expected_caught, count(*) FILTER (WHERE NOT must AND seq IS NOT NULL) AS bonus_caught,
  coalesce(sum(abs(model - sev)) FILTER (WHERE must AND seq IS NOT NULL), 0) AS severity_distance_sum, count(*) FILTER (WHERE must AND seq IS NOT NULL) AS severity_distance_n, """ + ", ".join(f"count(*) FILTER (WHERE must AND sev = {i}) AS {n}_total, count(*) FILTER (WHERE must AND sev = {i} AND seq IS NOT NULL) AS {n}_caught" for i, n in enumerate(ev.SEVERITIES)) + """ FROM le GROUP BY floor, run, "case"),
mk AS (SELECT sf.floor, sf.run, sf."case", sf.sev_rank, confidence, p.seq IS NOT NULL AS hit, coalesce(ex.sev = 3, false) AS told, EXISTS (SELECT 1 FROM fo WHERE fo.run = sf.run AND fo."case" = sf."case" AND (suffix(sf.file, path) OR suffix(path, sf.file))) AS bad
  FROM sf LEFT JOIN pa p ON p.floor = sf.floor AND p.run = sf.run AND p."case" = sf."case" AND p.seq = sf.seq LEFT JOIN ex ON ex.run = p.run AND ex."case" = p."case" AND ex.ord = p.ord),
pf AS (SELECT floor, run, "case", count(*) AS findings_total, count(*) FILTER (WHERE bad) AS findings_forbidden, count(*) FILTER (WHERE NOT bad AND NOT hit) AS findings_unmatched, sum((confidence - hit::INT) ^ 2) AS brier_sum, count(*) FILTER (WHERE sev_rank = 3) AS critical_shipped, count(*) FILTER (WHERE sev_rank = 3 AND told) AS critical_right FROM mk GROUP BY floor, run, "case"),
re AS (SELECT fl.floor, kc.run, kc."case", duration_ms, prompt_tokens, completion_tokens, CASE WHEN kc."case" % 4 = 0 THEN 8 END AS max_findings, CASE WHEN kc."case" % 5 = 0 THEN 'timeout' END AS judge_error, """ + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("expected_total", "expected_caught", "bonus_caught", "severity_distance_sum", "severity_distance_n", *(f"{n}_{k}" for n in ev.SEVERITIES for k in ("total", "caught")), "findings_total", "findings_forbidden", "findings_unmatched", "brier_sum", "critical_shipped", "critical_right")) + """, kc."case" % 4 = 0 AND coalesce(findings_total, 0) > 8 AS over_cap
  FROM kc CROSS JOIN fl LEFT JOIN pl ON pl.floor = fl.floor AND pl.run = kc.run AND pl."case" = kc."case" LEFT JOIN pf ON pf.floor = fl.floor AND pf.run = kc.run AND pf."case" = kc."case")"""
_ABOVE = {n: ("(" + " + ".join(f"sum({x}_caught)" for x in ev.SEVERITIES[i:]) + ")", "(" + " + ".join(f"sum({x}_total)" for x in ev.SEVERITIES[i:]) + ")") for i, n in enumerate(ev.SEVERITIES)}
_RECALL = {n: f"CASE WHEN {t} = 0 THEN 1.0 ELSE {c} / {t} END" for n, (c, t) in _ABOVE.items()}
_MEAN = {"severity_calibration_mae": "coalesce(sum(severity_distance_sum) / nullif(sum(severity_distance_n), 0), 0)", "judge_brier_score": "coalesce(sum(brier_sum) / nullif(sum(findings_total), 0), 0)", "avg_false_positives_per_case": "sum(findings_unmatched + findings_forbidden) / count(*)"}
_METRICS = "m AS (SELECT l_returnflag AS flag, unnest(['critical_recall', 'critical_f1', 'judge_brier_score', 'forbidden_path_findings', 'avg_false_positives_per_case']) AS metric, unnest([avg(l_discount), avg(l_tax) * 10, avg(l_quantity) / 25, (count(*) FILTER (WHERE l_linenumber = 7))::DOUBLE, avg(l_extendedprice) / 1e4]) AS value FROM lineitem GROUP BY l_returnflag)"
_CAL = f"WITH {fx.SAMPLES_SQL}, {fx.SUMMARY_SQL.format(src='s')}, {fx.MANN_WHITNEY_SQL.format(src='s')}, {fx.COMPARE_SQL.format(scoped='false')}, g AS (SELECT (substr(bench, 2)::BIGINT) % 5 AS scenario, count(*) AS trials, avg((verdict = 'regression')::INT) AS regression_rate, avg((verdict = 'improvement')::INT) AS improvement_rate, avg((verdict = 'neutral')::INT) AS neutral_rate, avg((coalesce(neutral_reason, '') = 'too-noisy')::INT) AS too_noisy_rate, avg(p_value) AS mean_p FROM d GROUP BY 1), x AS (SELECT ['gain', 'null', 'small', 'borderline', 'loss'][scenario + 1] AS scenario, * EXCLUDE (scenario) FROM g WHERE scenario IN (1, 3, 4)), y AS (SELECT *, concat_ws(',', CASE WHEN scenario = 'borderline' AND regression_rate < 0.2 OR scenario = 'loss' AND regression_rate < 0.99 THEN 'min_regression_rate' END, CASE WHEN scenario = 'null' AND regression_rate > 0.05 THEN 'max_regression_rate' END, CASE WHEN scenario = 'loss' AND improvement_rate > 0 THEN 'max_improvement_rate' END, CASE WHEN scenario = 'null' AND neutral_rate < 0.9 THEN 'min_neutral_rate' END, CASE WHEN scenario = 'loss' AND too_noisy_rate < 0.9 THEN 'min_too_noisy_rate' END) AS failures FROM x)"

_BLANKS = _FLAT[_FLAT.rindex("'["):_FLAT.rindex("]+'") + 3]


def _with_id(tables: str, select: str) -> str:
    """A query of entries with their ids: a digest of scope and wording."""
    words = f"trim(regexp_replace(lower(guidance), {_BLANKS}, ' ', 'g'))"
    return f"{tables}, told AS ({select}) SELECT *, 'e' || left(sha256(coalesce(file_glob, '') || chr(31) || coalesce(category, '') || chr(31) || {words}), 16) AS id FROM told"


ORACLE_SQL = {
    "parse_findings": f"{_F} SELECT seq AS chunk_idx, file, line, ['major', 'critical', 'minor', 'minor', 'nit'][seq % 5 + 1] AS severity, CASE seq % 3 WHEN 0 THEN 'performance' WHEN 1 THEN 'correctness' ELSE category END AS category, 't' || seq AS title, md5(trim(rationale, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160) || chr(5760) || chr(8195) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288))) AS rationale, suggestion, category AS raised_by FROM fi WHERE seq % 13 <> 0 AND seq % 17 <> 0",
    "parse_verdicts": "WITH x AS (SELECT doc_id // 200 AS pr, doc_id % 200 AS index FROM documents) SELECT pr, index, CASE WHEN index % 3 = 0 THEN 'keep' ELSE ['drop', 'downgrade', 'keep', 'keep'][index % 4 + 1] END AS verdict, round(CASE WHEN index % 3 = 0 THEN 0.6 ELSE greatest(0, least(1, index % 30 / 10 - 0.5)) END, 5) AS confidence FROM x",
    "near_duplicate_pairs": f"{_F}, t AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(title, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS tk FROM fi) SELECT a.file, a.seq AS a, b.seq AS b FROM t a JOIN t b ON a.pr = b.pr AND a.file = b.file AND a.seq < b.seq AND (a.line IS NULL OR b.line IS NULL OR abs(a.line - b.line) <= 3) WHERE a.title = b.title OR len(a.tk) + len(b.tk) = 0 OR len(list_intersect(a.tk, b.tk)) >= 0.55 * (len(a.tk) + len(b.tk) - len(list_intersect(a.tk, b.tk)))",
    "rank_findings": f"{_F} SELECT pr, seq, row_number() OVER (PARTITION BY pr ORDER BY sev_rank DESC, file, coalesce(line, 0), title, seq) AS rank FROM fi",
    "apply_verdicts": f"{_F}, a AS (SELECT seq, CASE WHEN verdict = 'downgrade' THEN greatest(0, sev_rank - 1) ELSE sev_rank END AS sev_rank FROM ju) SELECT seq, {_SEV}[sev_rank + 1] AS severity, sev_rank FROM a",
    "shippable": f"{_F} SELECT pr, seq, place FROM sh",
    "has_critical": f"{_F} SELECT pr, max((sev_rank = 3)::INT) = 1 AS critical FROM sh WHERE pr % 3 <> 2 OR sev_rank < 3 GROUP BY pr",
    "review_summary": f"{_F} SELECT pr, count(*) AS files_total, count(*) FILTER (WHERE seq % 3 > 0) AS files_reviewed, sum(seq % 9) AS prompt_tokens, sum(seq % 4) AS completion_tokens, sum(seq % 100) AS duration_ms, count(*) AS raw, count(*) AS merged, count(*) FILTER (WHERE verdict = 'drop') AS dropped, count(*) FILTER (WHERE verdict = 'downgrade') AS downgraded, count(*) FILTER (WHERE verdict <> 'drop' AND confidence < 0.5) AS hidden FROM ju GROUP BY pr",
    "reviewer_telemetry": f"{_F} SELECT pr, category AS persona, sum(seq % 100) AS duration_ms, sum(seq % 9) AS prompt_tokens, max(CASE WHEN seq % 4 = 3 AND pr % 3 = 1 THEN 'timeout' END) AS error, CASE WHEN category = 'security' THEN 0 ELSE count(*) END AS findings FROM fi GROUP BY pr, category",
    "degraded_reviewers": f"{_F} SELECT pr, string_agg(DISTINCT category, ',' ORDER BY category) AS failed FROM fi WHERE seq % 4 = 3 AND pr % 3 = 1 GROUP BY pr",
    "category_counts": f"{_F} SELECT pr, category, " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in ev.SEVERITIES) + " FROM sh GROUP BY pr, category",
    "apply_curation": f"{_F}, dc AS (SELECT pr, seq % 200 + 1 AS idx, CASE WHEN seq % 8 = 0 THEN 'drop' WHEN seq % 8 = 1 THEN 'keep' END AS one, CASE WHEN seq % 8 > 1 AND seq % 50 = 2 THEN 'keep' WHEN seq % 8 > 1 AND seq % 50 = 28 THEN 'drop' END AS rest FROM fi), y AS (SELECT sh.pr, seq, coalesce(one, last_value(rest IGNORE NULLS) OVER (PARTITION BY sh.pr ORDER BY place ROWS UNBOUNDED PRECEDING)) AS told FROM sh LEFT JOIN dc ON sh.pr = dc.pr AND dc.idx = place + 1) SELECT ju.pr, ju.seq, CASE WHEN told = 'drop' THEN 'drop' ELSE verdict END AS verdict FROM ju LEFT JOIN y ON y.seq = ju.seq",
    "parse_directives": f"WITH {_CM} SELECT id, \"at\", kind, txt AS text, idx AS \"index\" FROM di WHERE txt IS NULL OR txt <> ''",
    "directive_entries": _with_id(f"{_F}, {_CM}", f"SELECT repo, CASE WHEN length(txt) > 2000 THEN left(txt, 1999) || '…' ELSE txt END AS guidance, NULL::VARCHAR AS file_glob, NULL::VARCHAR AS category, 'user-directive' AS strongest_kind, pr AS source_pr, id AS source_comment_id, 1 AS confirmations, 0 AS refutations, seen AS first_seen, seen AS last_seen FROM di WHERE kind = 'remember' AND txt <> '' UNION ALL SELECT di.repo, 'On `' || file || '`, the council finding `' || title || '` was ' || CASE di.kind WHEN 'good' THEN 'confirmed' ELSE 'refuted' END || ' by a human reviewer on PR #' || di.pr || '.', {_GLOB}, category, CASE di.kind WHEN 'good' THEN 'confirmed' ELSE 'refuted' END, di.pr, id, (di.kind = 'good')::INT, (di.kind = 'bad')::INT, seen, seen FROM di JOIN sh ON di.pr = sh.pr AND di.repo = sh.repo AND di.idx = sh.place WHERE di.kind <> 'remember'"),
    "merge_entries": f"{_CO}, b AS (SELECT 0 AS o, repo, id, guidance, gl, cat, kind, rk, i, cid, conf, ref, born, seen FROM co UNION ALL SELECT 1, repo, CASE WHEN i % 3 = 0 THEN 'n' || i ELSE 'e' || md5(text) END, CASE WHEN i % 19 = 0 THEN guidance ELSE 'again: ' || text END, gl, cat, kind, rk, i, cid, conf, ref, born, seen FROM en), w AS (SELECT *, row_number() OVER (PARTITION BY repo, id ORDER BY o, seen, i) AS rn, row_number() OVER (PARTITION BY repo, id ORDER BY trim(guidance, chr(9) || chr(10) || chr(13) || ' ') = '', o, seen, i) AS rg, row_number() OVER (PARTITION BY repo, id ORDER BY cid IS NULL, o, seen, i) AS rc, row_number() OVER (PARTITION BY repo, id ORDER BY rk DESC, o) AS rr FROM b) SELECT repo, id, md5(max(guidance) FILTER (WHERE rg = 1)) AS guidance, max(gl) FILTER (WHERE rn = 1) AS file_glob, max(cat) FILTER (WHERE rn = 1) AS category, max(kind) FILTER (WHERE rr = 1) AS strongest_kind, max(i) FILTER (WHERE rn = 1) AS source_pr, max(cid) FILTER (WHERE rc = 1) AS source_comment_id, sum(conf) AS confirmations, sum(ref) AS refutations, max(born) FILTER (WHERE rn = 1) AS first_seen, max(seen) AS last_seen, count(*) FILTER (WHERE o = 1) AS hits, min(o) = 1 AS added FROM w GROUP BY repo, id",
    "score_entries": f"{_CO} SELECT repo, id, round(score, 6) AS score FROM sc",
    "compact_corpus": f"{_CO} SELECT repo, id, row_number() OVER (PARTITION BY repo ORDER BY score DESC, seen DESC, id) AS place FROM sc WHERE score >= 0.1 QUALIFY row_number() OVER (PARTITION BY repo ORDER BY score DESC, seen DESC, id) <= 120",
    "evicted_entries": f"{_CO} SELECT repo, count(*) - least(120, count(*) FILTER (WHERE score >= 0.1)) AS evicted FROM sc GROUP BY repo",
    "select_guidance": f"{_G} SELECT repo, id, place FROM gk",
    "guidance_of_reviews": f"{_CO}, rv AS (SELECT DISTINCT 'r' || (doc_id // 1000) AS repo, doc_id % 3 AS pr FROM documents) SELECT repo, pr, id, row_number() OVER (PARTITION BY repo, pr ORDER BY score DESC, id) AS place FROM sc JOIN rv USING (repo) WHERE (cat IS NULL OR cat = 'security') AND (gl IS NULL OR pr = 2 OR (pr = 1 AND gl <> '*.rs')) QUALIFY place <= 12",
    "corpus_listing": f"{_CO} SELECT repo, id, kind, coalesce(nullif(concat_ws(' · ', gl, cat), ''), 'all') AS scope, CASE WHEN length(guidance) > 20 THEN left(guidance, 19) || '…' ELSE guidance END AS guidance, round(score, 2) AS score, conf AS confirmations, ref AS refutations FROM sc",
    "match_candidates": f"{_EV} SELECT run, \"case\", ord, seq FROM ca",
    "case_findings": f"{_AS} SELECT run, \"case\", expected_total, findings_total, findings_forbidden, over_cap, " + ", ".join(f"{s}_total" for s in ev.SEVERITIES) + " FROM re WHERE floor = 0.5",
    "finding_records": f"{_EV}, c AS (SELECT *, list_filter(range(1, 81), lambda n: strlen(left(title, n)) <= 80) AS fits FROM fj WHERE verdict <> 'drop') SELECT run, \"case\", seq, file, line, severity, sev_rank, category, confidence, verdict, CASE WHEN strlen(title) <= 80 THEN title ELSE left(title, fits[-1]) END AS title FROM c",
    "eval_regressions": f"WITH {_METRICS} SELECT a.metric, round(a.value, 6) AS baseline, round(b.value, 6) AS current, round(CASE WHEN a.metric LIKE 'critical%' THEN a.value - b.value ELSE b.value - a.value END, 6) AS delta_worse, CASE a.metric WHEN 'forbidden_path_findings' THEN 0.0 WHEN 'avg_false_positives_per_case' THEN 1.0 ELSE 0.1 END AS tolerance FROM m a JOIN m b ON a.metric = b.metric AND a.flag = 'R' AND b.flag = 'N' WHERE CASE WHEN a.metric LIKE 'critical%' THEN a.value - b.value ELSE b.value - a.value END > CASE a.metric WHEN 'forbidden_path_findings' THEN 0 WHEN 'avg_false_positives_per_case' THEN 1.0 ELSE 0.1 END UNION ALL SELECT 'real_model', 1.0, 0.0, 1.0, 0.0",
    "eval_diff": f"WITH {_METRICS} SELECT a.metric, round(a.value, 6) AS a, round(b.value, 6) AS b, round(b.value - a.value, 6) AS delta FROM m a JOIN m b ON a.metric = b.metric AND a.flag = 'R' AND b.flag = 'A'",
    "gate_calibration": f"{_CAL} SELECT scenario, trials, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("regression_rate", "improvement_rate", "neutral_rate", "too_noisy_rate", "mean_p")) + " FROM g",
    "check_expectations": f"{_CAL} SELECT scenario, failures = '' AS passed, failures FROM y",
    "calibration_summary": f"{_CAL} SELECT round(avg((failures = '')::INT), 6) AS pass_rate, round(max(regression_rate) FILTER (WHERE scenario = 'null'), 6) AS observed_null_fpr, round(max(regression_rate) FILTER (WHERE scenario = 'borderline'), 6) AS observed_borderline_tpr FROM y",
    "reaction_entries": _with_id(f"{_F}, {_CM}, sy AS (SELECT *, (c % 3) + ((c + 2) % 3) + ((c + 3) % 3) + ((c + 4) % 3) AS pos, ((c + 1) % 3) + ((c + 5) % 3) AS neg FROM cm WHERE t % 4 = 3 QUALIFY row_number() OVER (PARTITION BY repo, pr ORDER BY id) = 1), re AS (SELECT *, true AS good, pos AS n FROM sy UNION ALL SELECT *, false, neg FROM sy)", f"SELECT re.repo, 'Council finding `' || title || '` in `' || file || CASE WHEN good THEN '` was reinforced by ' ELSE '` was refuted by ' END || n || CASE WHEN good THEN ' positive' ELSE ' negative' END || ' reaction(s) on PR #' || re.pr || CASE WHEN good THEN '.' ELSE ' — likely a false positive pattern.' END AS guidance, {_GLOB} AS file_glob, category, CASE WHEN good THEN 'confirmed' ELSE 'refuted' END AS strongest_kind, re.pr AS source_pr, re.id AS source_comment_id, CASE WHEN good THEN n ELSE 0 END AS confirmations, CASE WHEN good THEN 0 ELSE n END AS refutations, '2026-01-01T00:00:00Z' AS first_seen, '2026-01-01T00:00:00Z' AS last_seen FROM re JOIN sh ON sh.pr = re.pr AND sh.repo = re.repo AND place = 0 WHERE n > 0"),
    "budget_prefix": f"{_G}, li AS (SELECT repo, place, place || '. ' || CASE kind WHEN 'user-directive' THEN '📌 directive' WHEN 'confirmed' THEN '✅ confirmed' WHEN 'inferred-applied' THEN '↪ likely-relevant' WHEN 'refuted' THEN '🚫 false-positive pattern' ELSE '≈ low-signal' END || CASE WHEN gl IS NULL AND cat IS NULL THEN '' ELSE ' [scope: ' || concat_ws(' · ', '`' || gl || '`', cat) || ']' END || ': ' || {_FLAT} || ' (+' || conf || '/-' || ref || ')' || chr(10) AS line FROM gk), up AS (SELECT *, strlen($h${co.HEADER}$h$) + sum(strlen(line)) OVER (PARTITION BY repo ORDER BY place) > 6000 AS over FROM li), ov AS (SELECT *, sum(over::INT) OVER (PARTITION BY repo ORDER BY place) AS nth FROM up) SELECT repo, place, CASE WHEN over THEN '…' || chr(10) ELSE line END AS line FROM ov WHERE nth <= 1 UNION ALL SELECT DISTINCT repo, 0, $h${co.HEADER}$h$ FROM li",
    "score_cases": f"{_AS} SELECT * EXCLUDE (floor) REPLACE (round(brier_sum, 6) AS brier_sum) FROM re WHERE floor = 0.5",
    "eval_summary": f"{_AS}, y AS (SELECT run, count(*) AS cases_total, count(*) FILTER (WHERE expected_total = expected_caught) AS cases_fully_recalled, count(*) FILTER (WHERE over_cap) AS cases_over_cap, " + ", ".join(f"{e} AS recall_{n}" for n, e in _RECALL.items()) + ", " + ", ".join(f"{e} AS {n}" for n, e in _MEAN.items()) + ", sum(findings_forbidden) AS forbidden_path_findings, CASE WHEN sum(critical_shipped) = 0 THEN 1.0 ELSE sum(critical_right) / sum(critical_shipped) END AS measured_critical_precision, count(judge_error) AS cases_with_judge_error, sum(duration_ms) // count(*) AS avg_latency_ms, sum(prompt_tokens) AS total_prompt_tokens, sum(completion_tokens) AS total_completion_tokens FROM re WHERE floor = 0.5 GROUP BY run) SELECT run, cases_total, cases_fully_recalled, cases_over_cap, " + ", ".join(f"round({n}, 6) AS {n}" for n in (*(f"recall_{x}" for x in ev.SEVERITIES), *_MEAN, "measured_critical_precision")) + ", forbidden_path_findings, cases_with_judge_error, avg_latency_ms, total_prompt_tokens, total_completion_tokens, 1.0::DOUBLE AS critical_precision, round(recall_critical, 6) AS critical_recall, round(2 * recall_critical / (1 + recall_critical), 6) AS critical_f1 FROM y",
    "recalibrate": f"{_AS}, y AS (SELECT run, floor, {_RECALL['critical']} AS critical_recall, " + ", ".join(f"{_MEAN[n]} AS {n}" for n in SWEPT[1:]) + " FROM re WHERE floor > 0 GROUP BY run, floor), z AS (" + " UNION ALL ".join(f"SELECT run, floor, '{n}' AS metric, {n} AS value FROM y" for n in SWEPT) + ") SELECT run, metric, floor, round(value, 6) AS value, round(value - first_value(value) OVER (PARTITION BY run, metric ORDER BY floor), 6) AS delta FROM z",
}
