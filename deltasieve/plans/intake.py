"""Queries on sources and on events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare
from ..sources import reports as rp
from ..sources.shared import settled, shared_dir
from ..streaming import live
from . import fixtures as fx
from .core import _rounded


def _report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A captured report for each bench file, side and hundred parts: status lines, then its JSON."""
    block = F.expr("l_partkey div 100").alias("block")
    s = fx.samples(spark, sf_dir).groupBy("file", "side", block, "bench").agg(F.array_sort(F.collect_list("ns")).alias("samples"))
    run = F.struct(F.col("bench").alias("name"), "file", F.lit(0).alias("iterations"), F.lit(1).alias("batchSize"), F.lit(0.0).alias("elapsedNs"), "samples", F.array(F.struct(F.lit("alloc").alias("name"), F.size("samples").cast("double").alias("value"))).alias("metrics"), F.array(F.lit("t")).alias("tags"))
    whole = s.groupBy("file", "side", "block").agg(F.sort_array(F.collect_list(run)).alias("runs"))
    finished = F.concat(F.lit("2025-"), F.col("block") % 12)
    body = F.to_json(F.struct(F.when(F.col("file") == "mod_5.rs", "cobol").otherwise("rust").alias("language"), F.col("file").alias("service"), F.col("side").alias("ref"), finished.alias("finishedAt"), F.when(F.col("file") == "mod_6.rs", F.array().cast("array<struct<name:string>>")).alias("none"), "runs"))
    return whole.select(F.concat("file", F.lit("/"), "side", F.lit("/"), "block").alias("run_id"), F.concat(F.lit("compiling {x}\n"), body).alias("value"))


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = rp.validate_reports(rp.read_captured_reports(_report_texts(spark, sf_dir)))
    rows = rp.explode_samples(rp.bench_runs(good))
    return _rounded(rows.select("run_id", "bench", "file", "idx", "ns"))


def rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.validate_reports(rp.read_captured_reports(_report_texts(spark, sf_dir)))[1]


def merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = rp.validate_reports(rp.read_captured_reports(_report_texts(spark, sf_dir)))
    return rp.merge_runs(rp.bench_runs(good), ["service", "ref"]).select("service", "ref", "bench", "pos", "finished_at")


def go_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = fx.table(spark, sf_dir, "lineitem")
    n = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    out = F.when(F.col("l_linenumber") == 3, F.concat(F.lit("noise "), "l_quantity")).otherwise(F.concat(F.when(F.col("l_linenumber") == 1, "").otherwise(F.concat(F.lit("BenchmarkB"), F.col("l_partkey") % 50, F.lit("-8  "))), F.lit("1000  "), F.col("l_quantity"), F.lit(" ns/op\n")))
    event = F.to_json(F.struct(F.when(F.col("l_linenumber") == 5, "run").otherwise("output").alias("Action"), F.concat(F.lit("T"), F.col("l_partkey") % 20).alias("Test"), out.alias("Output"), F.concat(F.lit("pkg"), F.col("l_suppkey") % 7).alias("Package")))
    lines = li.select(n.alias("line_no"), F.when(F.col("l_linenumber") == 6, "PASS").otherwise(event).alias("value"))
    # Some lines have one number, so that their places aren't compared, but how many there are.
    rows = settled(rp.go_events_to_samples(lines), "samples")
    return rows.join(rows.groupBy("bench").agg(F.count_distinct("idx").alias("places"), F.max("idx").alias("last")), "bench").drop("idx")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("METRIC k"), F.col("p_partkey") % 10, F.lit("="), F.col("p_size"))).when(F.col("p_partkey") % 3 == 1, F.lit("METRIC bad=x")).otherwise(F.lit("other"))
    rows = rp.metric_lines(fx.table(spark, sf_dir, "part").select(value.alias("value")))
    return rows.join(rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "name")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored corpus for each document: good, old, newer, broken and partly broken ones, with the whole text as guidance.

    Of the entries' fields some are missing, unknown or of another type, by modulus.
    """
    i = F.col("doc_id")
    pick = lambda by, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    guidance = F.regexp_extract(F.to_json(F.struct("text")), r'(?s)^\{"text":(.*)\}$', 1)
    fields = (
        F.when(i % 4 > 0, F.concat(F.lit('"id":"a'), i.cast("string"), F.lit('",'))).otherwise(""),
        F.concat(F.lit('"guidance":'), guidance),
        pick(i, ',"fileGlob":"src/**"', "", ',"fileGlob":3'),
        pick(i, ',"category":"\\tSecurity "', ',"category":"zzz"', "", ',"category":"judge"', ',"category":["security"]'),
        pick(F.expr("doc_id div 6"), ',"strongestKind":"weird"', "", ',"strongestKind":"Directive"', ',"strongestKind":"refuted"', ',"strongestKind":" inferred-ignored"'),
        pick(F.expr("doc_id div 5"), ',"sourcePr":"1"', ',"sourcePr":7', ',"sourcePr":-2', ""),
        pick(F.expr("doc_id div 2"), ',"sourceCommentId":12', ',"sourceCommentId":1.5', ',"sourceCommentId":null'),
        pick(F.expr("doc_id div 3"), ',"confirmations":-3', ',"confirmations":2,"refutations":"4"', ',"confirmations":4294967297,"refutations":5'),
        F.when(i % 7 > 0, ',"firstSeen":"2026-01-01"').otherwise(""),
        pick(F.expr("doc_id div 4"), ',"lastSeen":"2026-02-02"', ',"lastSeen":5'),
    )
    entry = F.concat(F.lit("{"), *fields, F.lit("}"))
    version = F.when(i % 6 == 1, "").when(i % 6 == 2, '"schemaVersion":9,').when(i % 6 == 3, '"schemaVersion":"1",').otherwise('"schemaVersion":1,')
    value = F.when(i % 6 == 4, "{oops").when(i % 6 == 5, " \t\r\n").otherwise(F.concat(F.lit("\n{"), version, F.lit('"entries":['), entry, F.lit(',{"guidance":7,"firstSeen":"x"},{},42]}')))
    return fx.table(spark, sf_dir, "documents").where("text IS NOT NULL").select(i.cast("string").alias("repo"), value.alias("value"))


def stored_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.load_corpus(_stored(spark, sf_dir))[1]


def stored_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.load_corpus(_stored(spark, sf_dir))[0].withColumn("guidance", F.md5("guidance"))


def baseline_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head against a stored baseline: the base is saved under a name and loaded again."""
    rows = fx.samples(spark, sf_dir)
    table = rp.BaselineTable(spark, f"{shared_dir(spark)}/baselines-{uuid.uuid4().hex}")
    table.save("main", rows.where("side = 'base'"))
    both = table.load("main").unionByName(rows.where("side = 'head'"))
    return _rounded(compare.compare_summary(compare.compare_samples(both, ["bench"]).withColumn("service", F.lit("svc")), ["service"]), 6)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id (its log's folder) and lines of logs of sessions, as they are written: JSON, and some that is broken."""
    i = F.col("event_id")
    kind = F.when(F.col("event_type") == "signup", "agentSpawned").when(F.col("event_type") == "click", "iterationCompare").when(F.col("event_type") == "view", "agentOutput").when(F.col("event_type") == "purchase", "councilVerdict").otherwise(F.when(i % 2 == 0, "iterationStarted").otherwise("notice"))
    only = lambda *types: lambda c: F.when(F.col("type").isin(*types), c)
    spawn, comp, out, verdict = only("agentSpawned"), only("iterationCompare"), only("agentOutput"), only("councilVerdict")
    side = lambda v: F.struct(F.lit("b").alias("name"), v.alias("median"))
    median = (100 + i % 21).cast("double")
    diffs = F.array(
        F.struct(F.lit("b0").alias("name"), side(F.lit(108.0)).alias("base"), side(median).alias("head"), (i % 7 / 8).alias("deltaPct"), F.lit("neutral").alias("verdict")),
        F.struct(F.lit("b1").alias("name"), F.when(i % 3 > 0, side(F.lit(50.0))).alias("base"), F.when(i % 3 < 2, side(median / 2)).alias("head"), F.when(i % 3 == 1, 0.25).alias("deltaPct"), F.lit("neutral").alias("verdict")),
    )
    report = F.struct(F.struct((i % 4).alias("regressions"), (i % 5).alias("improvements"), F.lit(0).alias("neutrals")).alias("summary"), diffs.alias("diffs"))
    e = fx.table(spark, sf_dir, "events").withColumn("type", kind)
    body = F.to_json(F.struct(
        i.alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("tsMs"), "type", F.when(F.col("type") != "notice", F.concat(F.lit("a"), "user_id")).alias("agentId"),
        spawn(F.concat(F.lit("n"), i)).alias("name"), spawn(F.concat(F.lit("t"), F.col("user_id") % 3)).alias("tournamentId"), out(F.concat(F.lit("o"), i)).alias("text"), out(F.lit("stdout")).alias("kind"),
        only("notice")(F.concat(F.lit("m"), i)).alias("message"), only("iterationStarted", "iterationCompare")(i).alias("iteration"), comp(report).alias("report"), verdict(i % 3).alias("critical"),
    ))
    line = F.when(i % 10 == 0, "{broken").when(i % 10 == 1, '{"seq":"x","type":"notice"}').otherwise(body)
    return e.select(F.concat(F.lit("s"), F.col("user_id") % 10).alias("session_id"), line.alias("value"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.parse_events(log_lines(spark, sf_dir))


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.agent_state(live.dedupe_events(events(spark, sf_dir)))


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.standings(live.agent_state(events(spark, sf_dir)))


def tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.output_tail(events(spark, sf_dir), 3)


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.notice_tail(events(spark, sf_dir), 4)


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against one base for each session and bench: the least median of its comparisons' heads, and a margin."""
    e = events(spark, sf_dir)
    points = e.select("session_id", F.explode("diffs").alias("d")).groupBy("session_id", F.col("d.bench").alias("bench")).agg((F.min("d.head_median") * 1.05).alias("base_median"))
    return live.trajectory(e, points)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.session_list(live.since(events(spark, sf_dir), 100))


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewers' starts and ends by session, persona and chunk: some end at once, some after minutes, some too late, some never."""
    i = F.col("event_id")
    e = fx.table(spark, sf_dir, "events").select(F.concat(F.lit("s"), F.col("user_id") % 10).alias("session_id"), F.concat(F.lit("p"), i % 4).alias("persona"), F.expr("event_id div 40").alias("chunk_idx"), F.timestamp_millis(1_700_000_000_000 + i * 977).alias("ts"), i.alias("i"))
    dones = e.where("i % 5 > 0").withColumn("ts", F.timestamp_millis(1_700_000_000_000 + _done()))
    return live.reviewer_latency(e, dones).groupBy("session_id", "persona", "chunk_idx").agg(F.count(F.lit(1)).alias("pairs"), F.sum("latency_ms").alias("latency_ms"), F.max("latency_ms").alias("longest_ms"))


def _done() -> F.Column:
    """When the review that began with event i ended, in milliseconds: up to 70 minutes later."""
    return F.col("i") * 977 + F.col("i") % 7 * 700_000


_COUNTERS = {"findings_count": 5, "n_raw": 7, "n_deduped": 3, "n_keep": 4, "n_downgrade": 2, "n_drop": 6, "total_prompt_tokens": 11, "shippable_count": 9, "critical_count": 8}


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews' events as they are written, a line each."""
    e = fx.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "proposer_done").when(F.col("event_type") == "view", "synthesize_done").when(F.col("event_type") == "purchase", "judge_done").otherwise("done")
    of = {"proposer_done": ("findings_count",), "synthesize_done": ("n_raw", "n_deduped"), "judge_done": ("n_keep", "n_downgrade", "n_drop"), "done": ("total_prompt_tokens", "shippable_count", "critical_count")}
    i = F.col("event_id")
    body = F.to_json(F.struct(kind.alias("kind"), *[F.when(kind == k, i % _COUNTERS[c]).alias(c) for k, names in of.items() for c in names]))
    lines = e.select(F.concat(F.lit("s"), F.col("user_id") % 10).alias("session_id"), F.when(i % 10 == 0, "{broken").otherwise(body).alias("value"))
    return live.review_progress(rp.parse_review_events(lines))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events")
    states = e.select(F.concat(F.lit("s"), F.col("user_id") % 10).alias("session_id"), F.concat(F.lit("a"), "user_id").alias("agent_id"), F.col("event_id").alias("seq"), F.expr("event_id div 50").cast("string").alias("fingerprint"))
    return live.change_points(states).select("agent_id", "seq", "iteration")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    diffs = F.transform("diffs", lambda d: F.concat_ws(":", d["bench"], d["base_median"].cast("int").cast("string"), d["head_median"].cast("int").cast("string")))
    columns = ["session_id", "seq", "ts_ms", "type", "agent_id", "name", "tournament_id", "text", "message", "iteration", "critical", "regressions", "improvements", "delta_sum"]
    return events(spark, sf_dir).select(*columns, F.array_join(diffs, ",").alias("diffs"))


QUERIES = {
    "captured_reports": captured,
    "rejected_reports": rejected,
    "merge_runs": merged_runs,
    "go_events_to_samples": go_log,
    "metric_lines": metrics,
    "load_corpus": stored_corpus,
    "load_corpus_entries": stored_entries,
    "compare_to_baseline": baseline_compare,
    "agent_state": agents,
    "standings": ranks,
    "output_tail": tails,
    "notice_tail": notices,
    "trajectory": trajectories,
    "session_list": sessions,
    "reviewer_latency": latencies,
    "review_progress": progress,
    "change_points": changes,
    "parse_events": event_lines,
}

_E = """WITH e AS (SELECT 's' || (user_id % 10) AS session_id, event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, user_id,
  CASE event_type WHEN 'signup' THEN 'agentSpawned' WHEN 'click' THEN 'iterationCompare' WHEN 'view' THEN 'agentOutput' WHEN 'purchase' THEN 'councilVerdict' ELSE CASE WHEN event_id % 2 = 0 THEN 'iterationStarted' ELSE 'notice' END END AS type,
  CASE WHEN event_type IN ('signup', 'click', 'view', 'purchase') OR event_id % 2 = 0 THEN 'a' || user_id END AS agent_id FROM events WHERE event_id % 10 > 1)"""
_DS = "seq % 7 / 8 + CASE WHEN seq % 3 = 1 THEN 0.25 ELSE 0 END"
_L = lambda v, *t: f"arg_max({v}, seq) FILTER (WHERE type IN ({', '.join(repr(x) for x in t)}))"
_A = f"""{_E}, st AS (SELECT session_id, agent_id, {_L("'n' || seq", 'agentSpawned')} AS name, {_L("'t' || (user_id % 3)", 'agentSpawned')} AS tournament_id,
  count(*) FILTER (WHERE type = 'agentOutput') AS outputs, count(*) FILTER (WHERE type = 'iterationCompare') AS iterations, 0 AS failures,
  coalesce({_L("type = 'iterationStarted'", 'iterationStarted', 'iterationCompare')}, false) AS benching,
  {_L('seq % 4', 'iterationCompare')} AS regressions, {_L('seq % 5', 'iterationCompare')} AS improvements, {_L(_DS, 'iterationCompare')} AS delta_sum,
  CASE WHEN count(*) FILTER (WHERE type = 'councilVerdict') > 0 THEN 'done' END AS council_state, {_L('seq % 3', 'councilVerdict')} AS criticals, false AS ended, max(seq) AS last_seq
  FROM e WHERE agent_id IS NOT NULL GROUP BY session_id, agent_id)"""
_R = f"WITH {fx.SAMPLES_SQL}"
_B = _R + ", " + fx.SUMMARY_SQL.format(src="s") + ", " + fx.MANN_WHITNEY_SQL.format(src="s") + ", " + fx.COMPARE_SQL.format(scoped="false")

ORACLE_SQL = {
    "captured_reports": f"{_R} SELECT file || '/' || side || '/' || (l_partkey // 100) AS run_id, bench, file, row_number() OVER (PARTITION BY bench, side ORDER BY ns) - 1 AS idx, round(ns, 5) AS ns FROM s WHERE file <> 'mod_5.rs'",
    "rejected_reports": f"{_R} SELECT DISTINCT file || '/' || side || '/' || (l_partkey // 100) AS run_id, 'language' AS reason FROM s WHERE file = 'mod_5.rs'",
    "merge_runs": f"{_R}, b AS (SELECT DISTINCT side, file, bench, l_partkey // 100 AS k FROM s WHERE file <> 'mod_5.rs'), o AS (SELECT *, row_number() OVER w - 1 AS pos, '2025-' || last_value(k) OVER (PARTITION BY file, side ORDER BY file || '/' || side || '/' || k, bench ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) % 12 AS finished_at FROM b WINDOW w AS (PARTITION BY file, side ORDER BY file || '/' || side || '/' || k, bench)) SELECT file AS service, side AS ref, bench, pos, finished_at FROM o",
    "go_events_to_samples": "WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS n, CASE WHEN l_linenumber IN (1, 3) THEN 'T' || (l_partkey % 20) ELSE 'BenchmarkB' || (l_partkey % 50) || '-8' END AS bench, 'pkg' || (l_suppkey % 7) AS pkg, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS ns FROM lineitem WHERE l_linenumber NOT IN (5, 6)), f AS (SELECT bench, arg_min(pkg, n) AS file FROM l GROUP BY bench) SELECT bench, file, ns::DOUBLE AS ns, count(*) OVER (PARTITION BY bench) AS places, count(*) OVER (PARTITION BY bench) - 1 AS last FROM l JOIN f USING (bench) WHERE ns IS NOT NULL",
    "metric_lines": "WITH m AS (SELECT 'k' || (p_partkey % 10) AS name, p_size::DOUBLE AS value FROM part WHERE p_partkey % 3 = 0), g AS (SELECT name, count(*) AS n, sum(value) AS total FROM m GROUP BY name) SELECT name, value, n, total FROM m JOIN g USING (name)",
    "load_corpus": "SELECT doc_id::VARCHAR AS repo, doc_id % 6 IN (3, 4) AS invalid, CASE WHEN doc_id % 6 = 2 THEN 9 END AS future, CASE WHEN doc_id % 6 = 1 THEN 0 END AS upgraded_from, CASE WHEN doc_id % 6 IN (0, 1) AND told THEN 1 ELSE 0 END AS entries_loaded, CASE WHEN doc_id % 6 IN (0, 1) THEN 3 + (NOT told)::INT ELSE 0 END AS entries_dropped FROM (SELECT *, doc_id % 7 > 0 AND trim(text, chr(9) || chr(10) || chr(13) || ' ') <> '' AS told FROM documents WHERE text IS NOT NULL)",
    "compare_to_baseline": f"{_B} SELECT 'svc' AS service, " + ", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS {v.replace('-', '_')}" for v in compare.VERDICTS) + ", round(coalesce(sum(delta), 0), 6) AS delta_sum, count(*) FILTER (WHERE verdict = 'regression') > 0 AS failed FROM d",
    "agent_state": f"{_A} SELECT * FROM st",
    "standings": f"{_A}, x AS (SELECT session_id, tournament_id, agent_id, coalesce(improvements, 0) - 2.0 * coalesce(regressions, 0) - 1.5 * coalesce(criticals, 0) AS score, coalesce(delta_sum, 0)::DOUBLE AS delta_sum FROM st WHERE tournament_id IS NOT NULL) SELECT session_id, tournament_id, agent_id, score::DOUBLE AS score, delta_sum, row_number() OVER (PARTITION BY session_id, tournament_id ORDER BY score DESC, delta_sum, agent_id) AS rank FROM x",
    "output_tail": f"{_E} SELECT session_id, agent_id, seq, 'o' || seq AS text FROM e WHERE type = 'agentOutput' QUALIFY row_number() OVER (PARTITION BY session_id, agent_id ORDER BY seq DESC) <= 3",
    "notice_tail": f"{_E} SELECT session_id, seq, 'm' || seq AS message FROM e WHERE type = 'notice' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 4",
    "trajectory": f"{_E}, d AS (SELECT session_id, agent_id, seq, 'b0' AS bench, (100 + seq % 21)::DOUBLE AS median FROM e WHERE type = 'iterationCompare' UNION ALL SELECT session_id, agent_id, seq, 'b1', (100 + seq % 21) / 2 FROM e WHERE type = 'iterationCompare' AND seq % 3 < 2), b AS (SELECT session_id, bench, min(median) * 1.05::DOUBLE AS m FROM d GROUP BY session_id, bench) SELECT session_id, agent_id, seq AS iteration, bench, median, CASE WHEN (median - m) / m > 0.05::DOUBLE THEN 'regression' WHEN (median - m) / m < -0.05::DOUBLE THEN 'improvement' ELSE 'neutral' END AS verdict FROM d JOIN b USING (session_id, bench)",
    "session_list": f"{_E} SELECT session_id, count(*) AS events, arg_min(ts_ms, seq) AS started_ms FROM e WHERE seq > 100 GROUP BY session_id",
    "reviewer_latency": """WITH e AS (SELECT 's' || (user_id % 10) AS session_id, 'p' || (event_id % 4) AS persona, event_id // 40 AS chunk_idx, event_id * 977 AS ms, event_id * 977 + event_id % 7 * 700000 AS done, event_id AS i FROM events),
      x AS (SELECT a.session_id, a.persona, a.chunk_idx, b.done - a.ms AS latency FROM e a JOIN e b ON a.session_id = b.session_id AND a.persona = b.persona AND a.chunk_idx = b.chunk_idx WHERE b.i % 5 > 0 AND b.done BETWEEN a.ms AND a.ms + 3600000)
      SELECT session_id, persona, chunk_idx, count(*) AS pairs, sum(latency)::BIGINT AS latency_ms, max(latency) AS longest_ms FROM x GROUP BY ALL""",
    "review_progress": "SELECT 's' || (user_id % 10) AS session_id, count(*) FILTER (WHERE event_type = 'click') AS reviewers_done, coalesce(sum(event_id % 5) FILTER (WHERE event_type = 'click'), 0) AS findings, " + ", ".join(f"coalesce(sum(event_id % {m}) FILTER (WHERE {c}), 0) AS {n}" for n, m, c in (("n_raw", 7, "event_type = 'view'"), ("n_deduped", 3, "event_type = 'view'"), ("n_keep", 4, "event_type = 'purchase'"), ("n_downgrade", 2, "event_type = 'purchase'"), ("n_drop", 6, "event_type = 'purchase'"), ("prompt_tokens", 11, "event_type NOT IN ('click', 'view', 'purchase')"), ("shippable", 9, "event_type NOT IN ('click', 'view', 'purchase')"), ("criticals", 8, "event_type NOT IN ('click', 'view', 'purchase')"))) + " FROM events WHERE event_id % 10 > 0 GROUP BY 1",
    "change_points": "WITH c AS (SELECT 'a' || user_id AS agent_id, event_id AS seq, event_id // 50 <> lag(event_id // 50) OVER (PARTITION BY user_id ORDER BY event_id) AS ch FROM events), d AS (SELECT *, sum(coalesce(ch, false)::INT) OVER (PARTITION BY agent_id ORDER BY seq) AS iteration FROM c) SELECT agent_id, seq, iteration FROM d WHERE ch",
    "parse_events": f"{_E}, x AS (SELECT *, type = 'iterationCompare' AS c FROM e) SELECT session_id, seq, ts_ms, type, agent_id, CASE WHEN type = 'agentSpawned' THEN 'n' || seq END AS name, CASE WHEN type = 'agentSpawned' THEN 't' || (user_id % 3) END AS tournament_id, CASE WHEN type = 'agentOutput' THEN 'o' || seq END AS text, CASE WHEN type = 'notice' THEN 'm' || seq END AS message, CASE WHEN type IN ('iterationStarted', 'iterationCompare') THEN seq END AS iteration, CASE WHEN type = 'councilVerdict' THEN seq % 3 END AS critical, CASE WHEN c THEN seq % 4 END AS regressions, CASE WHEN c THEN seq % 5 END AS improvements, CASE WHEN c THEN {_DS} END AS delta_sum, CASE WHEN c THEN 'b0:108:' || (100 + seq % 21) || ',' || concat_ws(':', 'b1', CASE WHEN seq % 3 > 0 THEN '50' END, CASE WHEN seq % 3 < 2 THEN ((100 + seq % 21) // 2)::VARCHAR END) END AS diffs FROM x",
    "load_corpus_entries": """WITH g AS (
      SELECT doc_id AS i, CASE WHEN length(text) > 2000 THEN left(text, 1999) || '…' ELSE text END AS guidance, CASE WHEN doc_id % 3 = 0 THEN 'src/**' END AS file_glob,
        CASE doc_id % 5 WHEN 0 THEN 'security' WHEN 3 THEN 'judge' END AS category
      FROM documents WHERE doc_id % 6 IN (0, 1) AND doc_id % 7 > 0 AND trim(text, chr(9) || chr(10) || chr(13) || ' ') <> '')
    SELECT i::VARCHAR AS repo, CASE WHEN i % 4 > 0 THEN 'a' || i ELSE 'e' || left(sha256(coalesce(file_glob, '') || chr(31) || coalesce(category, '') || chr(31) || trim(regexp_replace(lower(guidance), '\\s+', ' ', 'g'))), 16) END AS id,
      md5(guidance) AS guidance, file_glob, category, CASE i // 6 % 5 WHEN 2 THEN 'user-directive' WHEN 3 THEN 'refuted' WHEN 4 THEN 'inferred-ignored' ELSE 'confirmed' END AS strongest_kind,
      CASE WHEN i // 5 % 4 = 1 THEN 7 ELSE 0 END AS source_pr, CASE WHEN i // 2 % 3 = 0 THEN 12 END AS source_comment_id, CASE i // 3 % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS confirmations,
      CASE WHEN i // 3 % 3 = 2 THEN 5 ELSE 0 END AS refutations, '2026-01-01' AS first_seen, CASE WHEN i // 4 % 2 = 0 THEN '2026-02-02' ELSE '2026-01-01' END AS last_seen
    FROM g""",
}
