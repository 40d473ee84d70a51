"""Live sessions: states, tails, standings and progress folded from ordered events, in batch and as streams.

The folds are by sequence number, never by arrival, so that they are the same functions for a table and for a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources.reports import REPORT, event_lines, parse_events

SESSION = ["session_id"]
AGENT = ["session_id", "agent_id"]
TAIL = 800
NOTICES = 50


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of all logs below a folder of sessions as a stream; lines that aren't events are dropped."""
    return parse_events(event_lines(spark.readStream.option("recursiveFileLookup", True).text(path)))


def _reports(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("_metadata.file_path").alias("run_id"), F.col("_metadata.file_modification_time").alias("changed_at"), *raw.columns)


def stream_reports(spark: SparkSession, path: str, start: str) -> DataFrame:
    """run_id, changed_at and the fields of reports written to a folder after start; older files are passed over.

    Each file is read once; where reports are written again under their old names, see watch_reports.
    """
    rows = _reports(spark.readStream.schema(REPORT).option("multiLine", True).json(path))
    return rows.where(F.col("changed_at") > F.lit(start).cast("timestamp"))


def changed_reports(spark: SparkSession, path: str, since: str, until: str) -> DataFrame:
    """run_id, changed_at and the fields of reports last written from since on and before until; others aren't opened."""
    rows = _reports(spark.read.schema(REPORT).option("multiLine", True).json(path))
    at = F.col("changed_at")
    return rows.where((at >= F.lit(since).cast("timestamp")) & (at < F.lit(until).cast("timestamp")))


def watch_reports(spark: SparkSession, path: str, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = "10 seconds") -> StreamingQuery:
    """Start a query that hands reports that are new or written again to sink, as events, batch by batch.

    A clock of one tick a second, which the checkpoint remembers, cuts time into batches; each looks up the files of its own
    span, so that a repeated batch has the same one and none is passed over.
    """

    def batch(ticks: DataFrame, n: int) -> None:
        span = ticks.agg(F.min("timestamp").cast("string").alias("a"), (F.max("timestamp") + F.expr("INTERVAL 1 second")).cast("string").alias("b")).first()
        if span.a is not None:
            sink(reports_as_events(changed_reports(ticks.sparkSession, path, span.a, span.b)), n)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(batch).start()


def reports_as_events(reports: DataFrame) -> DataFrame:
    """type, ts_ms, source, report (JSON) for each report that came in."""
    fields = [c for c in reports.columns if c not in ("run_id", "changed_at")]
    return reports.select(F.lit("runIngested").alias("type"), F.unix_millis("changed_at").alias("ts_ms"), F.col("run_id").alias("source"), F.to_json(F.struct(*fields)).alias("report"))


def dedupe_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each (session, seq) once. In a stream, what is remembered is bounded by delay in event time."""
    if events.isStreaming:
        timed = events.withColumn("_ts", F.timestamp_millis("ts_ms")).withWatermark("_ts", delay)
        return timed.dropDuplicatesWithinWatermark([*SESSION, "seq"]).drop("_ts")
    return events.dropDuplicates([*SESSION, "seq"])


def since(events: DataFrame, seq: int) -> DataFrame:
    """What came strictly after a sequence number."""
    return events.where(F.col("seq") > seq)


def _last(value: str, *types: str):
    """The value of an agent's last event of some types."""
    return F.max_by(value, F.when(F.col("type").isin(*types), F.col("seq")))


def agent_state(events: DataFrame) -> DataFrame:
    """One row for each session and agent: name, what it is doing, counts, its latest comparison and review."""
    is_ = lambda *t: F.col("type").isin(*t)
    rows = events.where("agent_id IS NOT NULL").withColumn("_bench", F.col("type") == "iterationStarted").withColumn(
        "_council", F.when(is_("councilStarted"), "running").when(is_("councilVerdict"), "done").when(is_("councilFailed"), "failed")
    )
    return rows.groupBy(*AGENT).agg(
        _last("name", "agentSpawned").alias("name"),
        _last("tournament_id", "agentSpawned").alias("tournament_id"),
        F.count_if(is_("agentOutput")).alias("outputs"),
        F.count_if(is_("iterationCompare")).alias("iterations"),
        F.count_if(is_("iterationFailed")).alias("failures"),
        F.coalesce(_last("_bench", "iterationStarted", "iterationCompare", "iterationFailed"), F.lit(False)).alias("benching"),
        _last("regressions", "iterationCompare").alias("regressions"),
        _last("improvements", "iterationCompare").alias("improvements"),
        _last("delta_sum", "iterationCompare").alias("delta_sum"),
        _last("_council", "councilStarted", "councilVerdict", "councilFailed").alias("council_state"),
        _last("critical", "councilVerdict").alias("criticals"),
        F.max(is_("agentExited", "agentFailed")).alias("ended"),
        F.max("seq").alias("last_seq"),
    )


def standings(state: DataFrame) -> DataFrame:
    """tournament_id, agent_id, score, rank 1..n: improvements less twice regressions less 1.5 criticals; ties by delta sum."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    score = zero("improvements") - 2.0 * zero("regressions") - 1.5 * zero("criticals")
    rows = state.where("tournament_id IS NOT NULL").select("session_id", "tournament_id", "agent_id", score.alias("score"), F.coalesce("delta_sum", F.lit(0.0)).alias("delta_sum"))
    order = Window.partitionBy("session_id", "tournament_id").orderBy(F.col("score").desc(), "delta_sum", "agent_id")
    return rows.withColumn("rank", F.row_number().over(order))


class Standings(StatefulProcessor):
    """Keeps what standings need of each agent of a session, by sequence number, and ranks the tournaments that a batch changed.

    Of every field the value with the highest number counts, so that the order in which events come doesn't matter.
    """

    FIELDS = (("agentSpawned", "tournament_id", "string"), ("iterationCompare", "regressions", "bigint"), ("iterationCompare", "improvements", "bigint"), ("iterationCompare", "delta_sum", "double"), ("councilVerdict", "critical", "bigint"))

    FORMS = {"string": str, "bigint": int, "double": float}

    def init(self, handle: StatefulProcessorHandle) -> None:
        values = ", ".join(f"{c}_seq bigint, {c} {kind}" for _, c, kind in self.FIELDS)
        self.agents = handle.getMapState("agents", "agent_id string", values)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = {k[0]: list(v) for k, v in self.agents.iterator()}
        changed = set()
        for pdf in rows:
            pdf = pdf.astype(object).where(pdf.notna(), None)
            for row in pdf.to_dict("records"):
                now = held.setdefault(row["agent_id"], [None] * (2 * len(self.FIELDS)))
                before = list(now)
                for i, (kind, field, form) in enumerate(self.FIELDS):
                    if row["type"] == kind and (now[2 * i] is None or row["seq"] > now[2 * i]):
                        now[2 * i : 2 * i + 2] = [int(row["seq"]), None if row[field] is None else self.FORMS[form](row[field])]
                if now != before:
                    self.agents.updateValue((row["agent_id"],), tuple(now))
                if now[1::2] != before[1::2]:
                    changed |= {before[1], now[1]} - {None}
        out = []
        for tournament in sorted(changed):
            agents = [(a, v) for a, v in held.items() if v[1] == tournament]
            scored = [(a, (v[5] or 0) - 2.0 * (v[3] or 0) - 1.5 * (v[9] or 0), float(v[7] or 0.0)) for a, v in agents]
            scored.sort(key=lambda x: (-x[1], x[2], x[0]))
            out += [(*key, tournament, a, score, delta, n) for n, (a, score, delta) in enumerate(scored, 1)]
        yield pd.DataFrame(out, columns=["session_id", "tournament_id", "agent_id", "score", "delta_sum", "rank"])

    def close(self) -> None:
        pass


def stream_standings(events: DataFrame) -> DataFrame:
    """standings() as a stream: an update has the whole ranking of each tournament that it changes, and of no other.

    State is a row for each agent, in a map for each session, from which nothing is rewritten but what changes.
    """
    kinds = [kind for kind, _, _ in Standings.FIELDS]
    rows = events.where(F.col("type").isin(*kinds) & F.col("agent_id").isNotNull()).select(*AGENT, "seq", "type", *[c for _, c, _ in Standings.FIELDS])
    schema = "session_id string, tournament_id string, agent_id string, score double, delta_sum double, rank int"
    return rows.groupBy(*SESSION).transformWithStateInPandas(Standings(), schema, "Update", "None")


class Numbers(StatefulProcessor):
    """Gives a session's events their numbers, going on from those given before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = self.last.get()[0] if self.last.exists() else 0
        batch = pd.concat(list(rows)).sort_values(["ts_ms", "value"], kind="stable")
        batch["seq"] = range(first + 1, first + 1 + len(batch))
        self.last.update((first + len(batch),))
        yield batch[["session_id", "seq", "ts_ms", "value"]]

    def close(self) -> None:
        pass


def number_events(raw: DataFrame) -> DataFrame:
    """session_id, seq, ts_ms, value (JSON) of a stream of events without numbers (session_id, ts_ms, value): 1, 2, .. in each session.

    Within a batch, events are in order of time, and those of one time in order of their text. Any number of writers may
    feed the stream, as one task at a time numbers a session.
    """
    rows = raw.select("session_id", F.col("ts_ms").cast("bigint").alias("ts_ms"), "value")
    return rows.groupBy(*SESSION).transformWithStateInPandas(Numbers(), "session_id string, seq bigint, ts_ms bigint, value string", "Append", "None")


def append_log(raw: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that numbers events and appends them to the log at path, each once, whatever is started again.

    The log is a folder of JSON files for each session. Numbers are state under the checkpoint, and the sink notes which
    files of a batch are whole, so that a batch that is run again replaces what it left.
    """
    return number_events(raw).writeStream.outputMode("append").format("json").partitionBy("session_id").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, path: str, after: int = 0) -> DataFrame:
    """session_id, seq, ts_ms, value of an appended log: what came strictly after a number."""
    return since(spark.read.schema("seq bigint, ts_ms bigint, value string, session_id string").json(path), after).select("session_id", "seq", "ts_ms", "value")


def output_tail(events: DataFrame, n: int = TAIL) -> DataFrame:
    """The last n outputs of each agent."""
    newest = F.row_number().over(Window.partitionBy(*AGENT).orderBy(F.col("seq").desc()))
    return events.where("type = 'agentOutput'").withColumn("_n", newest).where(F.col("_n") <= n).select(*AGENT, "seq", "text")


def notice_tail(events: DataFrame, n: int = NOTICES) -> DataFrame:
    """The last n notices of each session."""
    newest = F.row_number().over(Window.partitionBy(*SESSION).orderBy(F.col("seq").desc()))
    return events.where("type = 'notice'").withColumn("_n", newest).where(F.col("_n") <= n).select(*SESSION, "seq", "message")


class Tail(StatefulProcessor):
    """Keeps the last n outputs of a key, whatever the order in which they come."""

    def __init__(self, n: int = TAIL):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "seq bigint, text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = {int(r[0]): r[1] for r in self.rows.get()} if self.rows.exists() else {}
        for pdf in rows:
            held |= dict(zip(pdf["seq"].astype(int), pdf["text"], strict=True))
        kept = sorted(held.items())[-self.n :]
        self.rows.put([(s, t) for s, t in kept])
        yield pd.DataFrame({"session_id": key[0], "agent_id": key[1], "seq": [s for s, _ in kept], "text": [t for _, t in kept]})

    def close(self) -> None:
        pass


def stream_tail(events: DataFrame, n: int = TAIL) -> DataFrame:
    """output_tail as a stream: an update has an agent's whole tail, which is at most n rows of state."""
    rows = events.where("type = 'agentOutput'").select(*AGENT, "seq", "text")
    schema = "session_id string, agent_id string, seq bigint, text string"
    return rows.groupBy(*AGENT).transformWithStateInPandas(Tail(n), schema, "Update", "None")


def trajectory(events: DataFrame, base: DataFrame) -> DataFrame:
    """session_id, agent_id, iteration, bench, median, verdict of each comparison's benches, against the session's base.

    base: session_id, bench, base_median, one measurement for all agents of a session. Benches that the head lacks have
    no point.
    """
    rows = events.where("type = 'iterationCompare'").select(*AGENT, "seq", "iteration", F.explode("diffs").alias("d")).where("d.head_median IS NOT NULL")
    rows = rows.select(*AGENT, "iteration", "d.bench", F.col("d.head_median").alias("median")).join(base.select(*SESSION, "bench", "base_median"), [*SESSION, "bench"])
    change = F.try_divide(F.col("median") - F.col("base_median"), F.col("base_median"))
    return rows.select(*AGENT, "iteration", "bench", "median", F.when(change > 0.05, "regression").when(change < -0.05, "improvement").otherwise("neutral").alias("verdict"))


class Trajectory(StatefulProcessor):
    """Keeps a bench's base measurement, and the points that came before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.base = handle.getValueState("base", "median double")
        self.waiting = handle.getListState("waiting", "agent_id string, iteration bigint, median double")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        for median in initialState["base_median"]:
            self.base.update((float(median),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        points = []
        for pdf in rows:
            told = pdf["base_median"].dropna()
            if len(told) and not self.base.exists():
                self.base.update((float(told.iloc[0]),))
            points += [(r.agent_id, int(r.iteration), float(r.median)) for r in pdf[pdf["base_median"].isna()].itertuples()]
        if not self.base.exists():
            if points:
                self.waiting.appendList(points)
            points = []
        elif self.waiting.exists():
            points = [tuple(p) for p in self.waiting.get()] + points
            self.waiting.clear()
        base = self.base.get()[0] if self.base.exists() else None
        out = [(key[0], agent, iteration, key[1], median, _verdict(median, base)) for agent, iteration, median in points]
        yield pd.DataFrame(out, columns=["session_id", "agent_id", "iteration", "bench", "median", "verdict"])

    def close(self) -> None:
        pass


def _verdict(median: float, base: float) -> str:
    change = (median - base) / base if base else 0.0
    return "regression" if change > 0.05 else "improvement" if change < -0.05 else "neutral"


def stream_trajectory(events: DataFrame, known: DataFrame, late: DataFrame | None = None) -> DataFrame:
    """trajectory() as a stream: known base measurements (session_id, bench, base_median) are its first state.

    late: a stream of measurements like these, of sessions that begin afterwards. A point whose base hasn't come waits for
    it; of several measurements of one bench the first that comes stays.
    """
    rows = events.where("type = 'iterationCompare'").select(*AGENT, "iteration", F.explode("diffs").alias("d")).where("d.head_median IS NOT NULL")
    points = rows.select(*SESSION, F.col("d.bench").alias("bench"), "agent_id", "iteration", F.col("d.head_median").alias("median"), F.lit(None).cast("double").alias("base_median"))
    if late is not None:
        empty = {"agent_id": "string", "iteration": "bigint", "median": "double"}
        points = points.unionByName(late.select(*SESSION, "bench", "base_median", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()]))
    schema = "session_id string, agent_id string, iteration bigint, bench string, median double, verdict string"
    first = known.select(*SESSION, "bench", F.col("base_median").cast("double").alias("base_median")).groupBy(*SESSION, "bench")
    return points.groupBy(*SESSION, "bench").transformWithStateInPandas(Trajectory(), schema, "Append", "None", initialState=first)


def session_list(events: DataFrame) -> DataFrame:
    """session_id, events, started_ms; sort by started_ms for the newest first."""
    return events.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("events"), F.min_by("ts_ms", "seq").alias("started_ms"))


def reviewer_latency(starts: DataFrame, dones: DataFrame, within: str = "1 hour") -> DataFrame:
    """session_id, persona, chunk_idx, latency_ms of reviewers' starts and ends (ts) that belong together; also for streams."""
    s = starts.select("session_id", "persona", "chunk_idx", F.col("ts").alias("start"))
    d = dones.select(F.col("session_id").alias("_s"), F.col("persona").alias("_p"), F.col("chunk_idx").alias("_c"), F.col("ts").alias("done"))
    if s.isStreaming:
        s, d = s.withWatermark("start", within), d.withWatermark("done", within)
    same = F.expr(f"session_id = _s AND persona = _p AND chunk_idx = _c AND done >= start AND done <= start + INTERVAL {within}")
    return s.join(d, same).select("session_id", "persona", "chunk_idx", (F.unix_millis("done") - F.unix_millis("start")).alias("latency_ms"))


def review_progress(events: DataFrame) -> DataFrame:
    """One row for each session of council events (kind and counters): what has come in so far."""
    of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0))
    return events.groupBy(*SESSION).agg(
        F.count_if(F.col("kind") == "proposer_done").alias("reviewers_done"),
        of("proposer_done", "findings_count").alias("findings"),
        of("synthesize_done", "n_raw").alias("n_raw"),
        of("synthesize_done", "n_deduped").alias("n_deduped"),
        of("judge_done", "n_keep").alias("n_keep"),
        of("judge_done", "n_downgrade").alias("n_downgrade"),
        of("judge_done", "n_drop").alias("n_drop"),
        of("done", "total_prompt_tokens").alias("prompt_tokens"),
        of("done", "shippable_count").alias("shippable"),
        of("done", "critical_count").alias("criticals"),
    )


def change_points(states: DataFrame) -> DataFrame:
    """session_id, agent_id, seq, iteration: where a fingerprint differs from the one before, numbered from 1; the first is the start."""
    order = Window.partitionBy(*AGENT).orderBy("seq")
    changed = F.coalesce(F.col("fingerprint") != F.lag("fingerprint").over(order), F.lit(False))
    rows = states.select(*AGENT, "seq", "fingerprint").withColumn("_changed", changed)
    numbered = rows.withColumn("iteration", F.sum(F.col("_changed").cast("int")).over(order))
    return numbered.where("_changed").select(*AGENT, "seq", "iteration")


class ChangePoints(StatefulProcessor):
    """Holds an agent's states back until no earlier one can come, then compares each with the one before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "seq bigint", "at bigint, fingerprint string")
        self.last = handle.getValueState("last", "fingerprint string, n bigint, any boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            for seq, ts, mark in zip(pdf["seq"], pdf["at"], pdf["fingerprint"], strict=True):
                at = int(ts.value // 1_000_000)
                self.held.updateValue((int(seq),), (at, mark))
                self.handle.registerTimer(at + 1)
        yield self._released(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._released(key, timerValues)

    def _released(self, key, timer_values) -> pd.DataFrame:
        """Changes among the held states whose time is past, in order of seq, up to the first one whose time isn't."""
        upto = timer_values.getCurrentWatermarkInMs()
        mark, n, any_ = self.last.get() if self.last.exists() else (None, 0, False)
        out = []
        for seq, at, new in sorted((k[0], *v) for k, v in self.held.iterator()):
            if at >= upto:
                break
            if any_ and None not in (mark, new) and new != mark:
                n += 1
                out.append((*key, seq, n))
            mark, any_ = new, True
            self.held.removeKey((seq,))
        self.last.update((mark, n, any_))
        return pd.DataFrame(out, columns=[*AGENT, "seq", "iteration"])

    def close(self) -> None:
        pass


def stream_change_points(states: DataFrame, delay: str = "1 minute") -> DataFrame:
    """change_points as a stream: events (with ts) may come in any order, as far as delay in event time allows.

    A state is held until the stream's watermark has passed its time; a timer then lets it go. What comes later than that
    is lost, as in dedupe_events. A null fingerprint changes nothing, and nothing changes after it, as in the batch.
    """
    rows = states.select(*AGENT, "seq", "fingerprint", F.col("ts").cast("timestamp").alias("at")).withWatermark("at", delay)
    schema = "session_id string, agent_id string, seq bigint, iteration bigint"
    return rows.groupBy(*AGENT).transformWithStateInPandas(ChangePoints(), schema, "Append", "EventTime")
