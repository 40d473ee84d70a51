"""Readers and writers: run reports, captured output, benchmark logs, source trees, comments, corpora, events, baselines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .shared import settled

_HEADER = ("language", "service", "ref", "runner", "startedAt", "finishedAt")
_NUMBERS = ("mean", "median", "trimmedMean", "stddev", "cv", "mad", "iqr", "min", "max", "p50", "p95", "p99")
_RUN = {"name": "STRING", "file": "STRING", "iterations": "BIGINT", "batchSize": "BIGINT", "elapsedNs": "DOUBLE", "samples": "ARRAY<DOUBLE>"}
_RUN |= {n: "DOUBLE" for n in _NUMBERS}
_RUN |= {"metrics": "ARRAY<STRUCT<name: STRING, value: DOUBLE, unit: STRING, lowerIsBetter: BOOLEAN>>", "tags": "ARRAY<STRING>"}
REPORT = f"schemaVersion INT, {', '.join(f'{h} STRING' for h in _HEADER)}, runs ARRAY<STRUCT<{', '.join(f'{k}: {v}' for k, v in _RUN.items())}>>, affectedScope STRUCT<base: STRING, changedFiles: ARRAY<STRING>, benchFiles: ARRAY<STRING>, skippedBenchFiles: ARRAY<STRING>>"
COMMENT = "id BIGINT, body STRING, user_login STRING, author_association STRING, reactions STRUCT<plus_one: INT, minus_one: INT, heart: INT, hooray: INT, rocket: INT, confused: INT>, created_at STRING"
EVENT = "seq BIGINT, tsMs BIGINT, type STRING, sessionId STRING, repoRoot STRING, baseRef STRING, baseSha STRING, benchLabel STRING, agentId STRING, name STRING, task STRING, worktree STRING, branch STRING, tournamentId STRING, agentIds ARRAY<STRING>, kind STRING, text STRING, iteration BIGINT, iterations BIGINT, exitCode BIGINT, error STRING, critical BIGINT, major BIGINT, shippable BIGINT, markdown STRING, message STRING, source STRING, report STRING"
#: What is read of the comparison that some events carry.
COMPARISON = "summary STRUCT<regressions: BIGINT, improvements: BIGINT>, diffs ARRAY<STRUCT<name: STRING, deltaPct: DOUBLE, verdict: STRING, base: STRUCT<median: DOUBLE>, head: STRUCT<median: DOUBLE>>>"
#: Events of a review, a line each; a review is a file.
REVIEW_EVENT = "kind STRING, repo STRING, pr BIGINT, model STRING, files_total BIGINT, files_reviewed BIGINT, n_chunks BIGINT, persona STRING, chunk_idx BIGINT, findings_count BIGINT, duration_ms BIGINT, error STRING, prompt_tokens BIGINT, completion_tokens BIGINT, n_raw BIGINT, n_deduped BIGINT, n_candidates BIGINT, n_keep BIGINT, n_downgrade BIGINT, n_drop BIGINT, index BIGINT, file STRING, line BIGINT, severity STRING, category STRING, title STRING, confidence DOUBLE, total_duration_ms BIGINT, shippable_count BIGINT, critical_count BIGINT, total_prompt_tokens BIGINT, total_completion_tokens BIGINT"
SCHEMA_VERSION = 2
LANGUAGES = ("ts", "go", "rust")
CORPUS_VERSION = 1


def _snake(name: str) -> str:
    return re.sub(r"(?<!^)([A-Z])", r"_\1", name).lower()


def bench_runs(reports: DataFrame) -> DataFrame:
    """One row for each run of a report (struct column report, run_id): header columns and the run's fields, snake case."""
    head = [F.col(f"report.{c}").alias(_snake(c)) for c in _HEADER]
    rows = reports.select("run_id", *head, F.posexplode("report.runs").alias("pos", "r"))
    own = [F.col(f"r.{f}").alias("bench" if f == "name" else _snake(f)) for f in _RUN]
    return rows.select("run_id", *map(_snake, _HEADER), "pos", *own)


def read_run_reports(spark: SparkSession, path: str) -> DataFrame:
    """bench_runs of a folder of reports, one JSON object in each file; run_id is the file."""
    raw = spark.read.schema(REPORT).option("multiLine", True).json(path)
    return bench_runs(raw.select(F.col("_metadata.file_path").alias("run_id"), F.struct(*raw.columns).alias("report")))


def read_captured_reports(texts: DataFrame) -> DataFrame:
    """run_id and report of texts (run_id, value) in which a report follows status lines: it begins at a line's brace."""
    body = F.regexp_extract("value", r"(?s)(?:^|\n)(\{.*)", 1)
    return texts.select("run_id", F.from_json(body, REPORT).alias("report")).where("report.runs IS NOT NULL")


def explode_samples(runs: DataFrame) -> DataFrame:
    """run_id, bench, file, idx, ns."""
    return runs.select("run_id", "bench", "file", F.posexplode("samples").alias("idx", "ns"))


def validate_reports(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports with a version, rejects with a reason): the language must be known and there must be runs."""
    reason = F.when(~F.col("report.language").isin(*LANGUAGES) | F.col("report.language").isNull(), "language").when(F.coalesce(F.size("report.runs"), F.lit(0)) <= 0, "no runs")
    version = F.when(F.coalesce("report.schemaVersion", F.lit(0)) == 0, SCHEMA_VERSION).otherwise(F.col("report.schemaVersion"))
    marked = reports.withColumns({"reason": reason, "schema_version": version})
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL").select("run_id", "reason")


def merge_runs(runs: DataFrame, by: list[str], order: str = "run_id") -> DataFrame:
    """Reports of a key as one: all their rows, numbered on, with the finish of the last."""
    whole = Window.partitionBy(*by).orderBy(order, "pos")
    last = F.last_value("finished_at").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return runs.withColumns({"finished_at": last, "pos": F.row_number().over(whole) - 1})


def go_events_to_samples(lines: DataFrame) -> DataFrame:
    """bench, file, idx, ns from lines (line_no, value) of a benchmark log of JSON events.

    Only output events count. The name is the output's first word if it begins with Benchmark, else the event's
    test; a name's file is the first package seen with it; lines that aren't such JSON are skipped.
    """
    # Generated, not projected, so that a line is stripped and parsed once, whatever is asked of it; and written, as it is used thrice.
    once = lambda c: F.explode(F.array(c))
    texts = lines.select("line_no", once(strip(F.col("value"))).alias("text")).where("startswith(text, '{')")
    event = F.from_json("text", "Action STRING, Test STRING, Output STRING, Package STRING")
    rows = texts.select("line_no", once(event).alias("e")).where("e.Action = 'output' AND e.Output IS NOT NULL")
    outs = rows.select("line_no", "e.Test", "e.Package", once(strip(F.col("e.Output"))).alias("out"))
    name = F.coalesce(F.when(F.col("out").startswith("Benchmark"), F.regexp_extract("out", r"^(\S+)", 1)), F.col("Test"))
    ns = F.regexp_extract("out", r"(?:^|\s)(\S+)\s+ns/op(?:\s|$)", 1).try_cast("double")
    named = settled(outs.select("line_no", once(F.struct(name.alias("bench"), ns.alias("ns"))).alias("r"), F.col("Package").alias("package")).select("line_no", "r.bench", "r.ns", "package").where("bench IS NOT NULL"), "events")
    files = named.groupBy("bench").agg(F.coalesce(F.min_by("package", F.when(F.col("package").isNotNull(), F.col("line_no"))), F.lit("")).alias("file"))
    # A name's samples are numbered in ranges of lines, moved on by those of the ranges before.
    ranges = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = settled(named.where("ns IS NOT NULL").select("bench", "line_no", "ns").repartitionByRange(ranges, "bench", "line_no").withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("bench").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("bench", "_range").agg(F.count(F.lit(1)).alias("_n")).select("bench", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")).join(files, "bench")
    within = F.row_number().over(Window.partitionBy("bench", "_range").orderBy("line_no"))
    return cut.withColumn("_at", within).join(offsets, ["bench", "_range"]).select("bench", "file", (F.col("_before") + F.col("_at") - 1).cast("int").alias("idx"), "ns")


def metric_lines(lines: DataFrame) -> DataFrame:
    """name, value of lines (column value) of the form METRIC name=number; others are skipped."""
    name, number = (F.regexp_extract("value", r"^METRIC\s+([^=\s]+)=(\S+)\s*$", i) for i in (1, 2))
    return lines.select(name.alias("name"), number.try_cast("double").alias("value")).where("name <> '' AND value IS NOT NULL")


def read_repo_files(spark: SparkSession, root: str) -> DataFrame:
    """path (from root) and content of a tree of text files, each read whole."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(root)
    top = root.rstrip("/").split("://")[-1].lstrip("/")
    return raw.select(F.regexp_replace(F.col("_metadata.file_path"), f"^[a-z]+:/+{re.escape(top)}/", "").alias("path"), F.col("value").alias("content"))


def read_diffs(spark: SparkSession, path: str) -> DataFrame:
    """pr (from the file's name) and diff of a folder of diffs."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)[^/]*$", 1).try_cast("bigint").alias("pr"), F.col("value").alias("diff"))


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """Comments of JSON arrays, with no association and no reactions where these are missing."""
    return comments_with_defaults(spark.read.schema(COMMENT).option("multiLine", True).json(path))


def comments_with_defaults(raw: DataFrame) -> DataFrame:
    names = ("plus_one", "minus_one", "heart", "hooray", "rocket", "confused")
    zero = F.struct(*[F.coalesce(F.col(f"reactions.{n}"), F.lit(0)).alias(n) for n in names])
    return raw.withColumns({"author_association": F.coalesce("author_association", F.lit("NONE")), "reactions": zero, "created_at": F.coalesce("created_at", F.lit(""))})


CASE = "name STRING, description STRING, diff STRING, filesDir STRING, expected ARRAY<STRUCT<file: STRING, lineRange: ARRAY<BIGINT>, severity: STRING, category: STRING, description: STRING, mustCatch: BOOLEAN>>, forbidden ARRAY<STRUCT<path: STRING, reason: STRING>>, maxFindings BIGINT"


def read_cases(spark: SparkSession, root: str, index: str | None = None) -> dict[str, DataFrame]:
    """cases, expected and forbidden of a folder of labelled cases, of those that the index (a JSON text of names) lists.

    Spark passes over files whose names begin with an underscore, so the index must be named otherwise.
    """
    kept = spark.read.schema(CASE).option("multiLine", True).option("pathGlobFilter", "*.json").json(root).where("name IS NOT NULL")
    if index is not None:
        names = F.regexp_extract_all("value", F.lit(r'"([^"]+?)(?:\.json)?"'), 1)
        kept = kept.join(spark.read.option("wholetext", True).text(index).select(F.explode(names).alias("name")).distinct(), "name", "left_semi")
    expected = kept.select(F.col("name").alias("case"), F.posexplode("expected").alias("ord", "e"))
    return {
        "cases": kept.select(F.col("name").alias("case"), "diff", "filesDir", F.col("maxFindings").alias("max_findings")),
        "expected": expected.select("case", F.col("ord").cast("bigint").alias("ord"), "e.file", F.col("e.lineRange")[0].alias("line_lo"), F.col("e.lineRange")[1].alias("line_hi"), "e.severity", "e.category", F.coalesce("e.mustCatch", F.lit(True)).alias("must_catch")),
        "forbidden": kept.select(F.col("name").alias("case"), F.explode("forbidden").alias("f")).select("case", "f.path", "f.reason"),
    }


# Kinds and categories of a stored entry, and another spelling of a kind.
_STORED_KINDS = {"user-directive": "user-directive", "directive": "user-directive", "confirmed": "confirmed", "refuted": "refuted", "inferred-applied": "inferred-applied", "inferred-ignored": "inferred-ignored"}
_STORED_CATEGORIES = {c: c for c in ("correctness", "security", "performance", "maintainability", "judge")}


def load_corpus(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, summary) of stored corpora (repo, value), whatever their state; never fails.

    A text that isn't JSON, or whose version isn't a whole number, is invalid; a newer version is refused; an older or
    missing one is upgraded.

    An entry without guidance or without firstSeen is dropped and counted; all else has a default, also where it is of
    another type: no glob, no category, kind confirmed, source_pr 0, no comment, counters 0 (whole numbers from 0 on, by their
    lowest 32 bits), last seen when first seen, and the id of its scope and wording. Kinds and categories are read in any case, with
    blanks around them; unknown ones count as missing. Long guidance is cut.
    """
    from ..operators.corpus import clamp_guidance, entry_id

    doc = texts.select("repo", strip(F.coalesce("value", F.lit(""))).alias("value")).withColumn("doc", F.try_parse_json("value"))
    kind = F.schema_of_variant(F.try_variant_get("doc", "$.schemaVersion", "variant"))
    number = F.try_variant_get("doc", "$.schemaVersion", "bigint")
    bad = (F.col("value") != "") & (F.col("doc").isNull() | (kind.isNotNull() & ((kind != "BIGINT") | (number < 0))))
    version = F.when(kind.isNull(), 0).otherwise(number)
    state = doc.withColumns({"invalid": F.coalesce(bad, F.lit(False)), "version": version})
    state = state.withColumn("future", F.when(~F.col("invalid") & (F.col("version") > CORPUS_VERSION), F.least(F.col("version"), F.lit(2**32 - 1))))
    state = state.withColumn("upgraded_from", F.when(~F.col("invalid") & (F.col("value") != "") & (F.col("version") < CORPUS_VERSION), F.col("version")))
    usable = ~F.col("invalid") & F.col("future").isNull()
    items = F.when(usable, F.try_variant_get("doc", "$.entries", "array<variant>"))
    rows = state.select("repo", F.explode(items).alias("x"))

    def kind_of(field: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("x", f"$.{field}", "variant"))

    def text(field: str) -> Column:
        return F.when(kind_of(field) == "STRING", F.try_variant_get("x", f"$.{field}", "string"))

    def whole(field: str) -> Column:
        number = F.when(kind_of(field) == "BIGINT", F.try_variant_get("x", f"$.{field}", "bigint"))
        return F.when(number >= 0, number)

    def known(field: str, names: dict[str, str]) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(n) for pair in names.items() for n in pair]), F.lower(strip(text(field))))

    rows = rows.withColumn("ok", F.coalesce((strip(text("guidance")) != "") & text("firstSeen").isNotNull(), F.lit(False)))
    kept = rows.where("ok").select(
        "repo",
        text("id").alias("id"),
        clamp_guidance(text("guidance")).alias("guidance"),
        text("fileGlob").alias("file_glob"),
        known("category", _STORED_CATEGORIES).alias("category"),
        F.coalesce(known("strongestKind", _STORED_KINDS), F.lit("confirmed")).alias("strongest_kind"),
        F.coalesce(whole("sourcePr"), F.lit(0)).alias("source_pr"),
        whole("sourceCommentId").alias("source_comment_id"),
        *[(F.coalesce(whole(n), F.lit(0)) % (1 << 32)).alias(n) for n in ("confirmations", "refutations")],
        text("firstSeen").alias("first_seen"),
        F.coalesce(text("lastSeen"), text("firstSeen")).alias("last_seen"),
    )
    entries = kept.withColumn("id", F.coalesce("id", entry_id(F.col("file_glob"), F.col("category"), F.col("guidance"))))
    counts = rows.groupBy("repo").agg(F.count_if("ok").alias("entries_loaded"), F.count_if(~F.col("ok")).alias("entries_dropped"))
    summary = state.join(counts, "repo", "left").select("repo", "invalid", "future", "upgraded_from", F.coalesce("entries_loaded", F.lit(0)).alias("entries_loaded"), F.coalesce("entries_dropped", F.lit(0)).alias("entries_dropped"))
    return entries, summary


def _json_lines(lines: DataFrame, shape: str, needed: list[str]) -> DataFrame:
    """The fields of JSON lines (column value), beside the other columns; lines that don't have the shape are dropped."""
    e = F.from_json("value", shape + ", bad STRING", {"columnNameOfCorruptRecord": "bad"})
    there = " AND ".join(f"e.{n} IS NOT NULL" for n in needed)
    rows = lines.select(*[c for c in lines.columns if c != "value"], e.alias("e")).where(f"e.bad IS NULL AND {there}")
    names = [p.split()[0] for p in re.sub(r"<[^>]*>", "", shape).split(", ")]
    return rows.select(*[c for c in rows.columns if c != "e"], *[F.col(f"e.{n}").alias(_snake(n)) for n in names])


def parse_events(lines: DataFrame) -> DataFrame:
    """Events from JSON lines (column value); lines that aren't events are dropped.

    Only the first event of a session names it, so that session_id is the lines' own column of that name where they have
    one (the log's folder, see event_lines). Of a comparison's report there are regressions, improvements, delta_sum (the
    sum of its changes) and diffs (bench, delta_pct, verdict, base_median, head_median).
    """
    named = "session_id" in lines.columns
    rows = _json_lines(lines.withColumnRenamed("session_id", "_session") if named else lines, EVENT, ["seq", "type"])
    if named:
        rows = rows.withColumn("session_id", F.col("_session")).drop("_session")
    told = F.from_json(F.when(F.col("type").isin("iterationCompare", "externalCompare"), F.col("report")), COMPARISON)
    rows = rows.withColumn("_c", told)
    change = F.aggregate(F.transform("_c.diffs", lambda d: F.coalesce(d["deltaPct"], F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    diffs = F.transform("_c.diffs", lambda d: F.struct(d["name"].alias("bench"), d["deltaPct"].alias("delta_pct"), d["verdict"].alias("verdict"), d["base"]["median"].alias("base_median"), d["head"]["median"].alias("head_median")))
    return rows.withColumns({"regressions": F.col("_c.summary.regressions"), "improvements": F.col("_c.summary.improvements"), "delta_sum": change, "diffs": diffs}).drop("_c")


def parse_review_events(lines: DataFrame) -> DataFrame:
    """A review's events from JSON lines (column value); lines that aren't such events are dropped."""
    return _json_lines(lines, REVIEW_EVENT, ["kind"])


def event_lines(raw: DataFrame) -> DataFrame:
    """Lines of logs (as Spark's text source reads them) with session_id, the name of the folder that a log is in."""
    return raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("session_id"), "value")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of all logs below a folder of sessions."""
    return parse_events(event_lines(spark.read.option("recursiveFileLookup", True).text(path)))


def write_table(df: DataFrame, path: str, form: str = "parquet", mode: str = "error") -> None:
    """A result as a folder of Parquet or JSON files; mode append adds to a log."""
    df.write.mode(mode).format(form).save(path)


class BaselineTable:
    """Named runs in one Parquet table, a partition for each name."""

    NAME = re.compile(r"[A-Za-z0-9._-]+")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _check(self, name: str) -> str:
        if not self.NAME.fullmatch(name) or name in (".", ".."):
            raise ValueError(f"not a baseline name: {name!r}")
        return name

    def save(self, name: str, runs: DataFrame) -> None:
        """Store runs under a name, in place of what it named."""
        out = runs.withColumn("baseline", F.lit(self._check(name)))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("baseline").parquet(self.path)

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path).where(F.col("baseline") == self._check(name)).drop("baseline")

    def list(self) -> DataFrame:
        """baseline, rows and whether it can be read, of all that are named; no rows where the table isn't there yet."""
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = []
        for name in [f.getPath().getName() for f in fs.listStatus(top)] if fs.exists(top) else []:
            if name.startswith("baseline="):
                try:
                    found.append((name.removeprefix("baseline="), self.spark.read.parquet(f"{self.path}/{name}").count(), True))
                except Exception:  # noqa: BLE001 - whatever is wrong with it, it is listed
                    found.append((name.removeprefix("baseline="), None, False))
        return self.spark.createDataFrame(found, "baseline string, rows bigint, valid boolean")

    def remove(self, name: str) -> None:
        """Delete a baseline's partition through the file system that holds the table."""
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/baseline={self._check(name)}")
        fs = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(target):
            raise KeyError(name)
        fs.delete(target, True)
