"""Streams equal their batch twins, however the events are dealt over files."""

import json
import random

import pytest

from deltasieve.plans import intake
from deltasieve.sources import reports as rp
from deltasieve.streaming import live


@pytest.fixture(scope="module")
def log(tmp_path_factory):
    """A session's log as it is written: only its first event names it."""
    folder = tmp_path_factory.mktemp("sessions") / "s"
    folder.mkdir()
    rng = random.Random(4)
    events = [{"seq": i, "tsMs": 1_000_000 + 1000 * i, "type": "agentOutput", "agentId": f"a{rng.randint(0, 2)}", "kind": "stdout", "text": f"t{i}"} for i in range(60)]
    events[0] |= {"type": "sessionStarted", "sessionId": "s"}
    rng.shuffle(events)
    for k in range(3):
        lines = [json.dumps(e) for e in events[k * 20 : k * 20 + 20]] + ["{broken", ""]
        (folder / f"part{k}.jsonl").write_text("\n".join(lines))
    return str(folder.parent)


def report(regressions, improvements, *changes):
    diffs = [{"name": f"b{i}", "base": {"name": "b", "median": 100.0}, "head": None if c is None else {"name": "b", "median": 100.0 * (1 + c)}, "deltaPct": c, "verdict": "neutral"} for i, c in enumerate(changes)]
    return {"base": {"ref": "a", "service": "s"}, "threshold": 0.05, "diffs": diffs, "summary": {"regressions": regressions, "improvements": improvements, "neutrals": 0}}


@pytest.fixture(scope="module")
def sessions(tmp_path_factory):
    """Two sessions' logs: agents of a tournament with comparisons and reviews, one without data."""
    root = tmp_path_factory.mktemp("logs")
    spawn = lambda a: {"type": "agentSpawned", "agentId": a, "name": a, "task": "t", "worktree": "/w", "branch": "b", "tournamentId": "t1"}
    compare = lambda a, i, r: {"type": "iterationCompare", "agentId": a, "iteration": i, "report": r}
    told = lambda a, c: {"type": "councilVerdict", "agentId": a, "critical": c, "major": 0, "shippable": 1, "markdown": "m"}
    one = [{"type": "sessionStarted", "sessionId": "one", "repoRoot": "/r", "baseRef": "main", "baseSha": "1", "benchLabel": "b"}]
    one += [spawn(a) for a in ("win", "regressed", "flagged", "slower", "idle")]
    one += [compare("win", 1, report(5, 0, 0.5)), compare("win", 2, report(0, 2, -0.10, None)), compare("regressed", 1, report(1, 2, 0.05)), compare("flagged", 1, report(0, 2, -0.08)), told("flagged", 2), compare("slower", 1, report(0, 2, 0.02))]
    one += [{"type": "agentExited", "agentId": "win", "exitCode": 0, "iterations": 2}, {"type": "notice", "message": "n"}]
    two = [{"type": "sessionStarted", "sessionId": "two"}, spawn("x"), {"type": "iterationStarted", "agentId": "x", "iteration": 1}]
    for name, events in (("one", one), ("two", two)):
        (root / name).mkdir()
        (root / name / "events.jsonl").write_text("\n".join(json.dumps({"seq": i, "tsMs": 10 * i} | e) for i, e in enumerate(events)))
    return str(root)


def test_states_and_standings_from_logs(spark, sessions):
    events = rp.read_events(spark, sessions)
    assert {r["session_id"]: r["events"] for r in live.session_list(events).collect()} == {"one": 14, "two": 3}
    state = {r["agent_id"]: r for r in live.agent_state(events).collect()}
    assert (state["win"]["iterations"], state["win"]["regressions"], state["win"]["ended"], state["x"]["benching"]) == (2, 0, True, True)
    assert state["win"]["delta_sum"] == pytest.approx(-0.10) and state["idle"]["improvements"] is None
    ranks = [r["agent_id"] for r in live.standings(live.agent_state(events)).where("session_id = 'one'").orderBy("rank").collect()]
    assert ranks == ["win", "slower", "idle", "regressed", "flagged"]
    base = spark.createDataFrame([("one", "b0", 100.0)], "session_id string, bench string, base_median double")
    got = {(r["agent_id"], r["iteration"]): r["verdict"] for r in live.trajectory(events, base).collect()}
    assert got == {("win", 1): "regression", ("win", 2): "improvement", ("regressed", 1): "neutral", ("flagged", 1): "improvement", ("slower", 1): "neutral"}


@pytest.fixture
def stateful(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def in_files(spark, df, path, order):
    """A stream of df's rows, a file for each part of their numbers in order, in that order."""
    import os

    path.mkdir()
    rows = df.collect()
    for k, part in enumerate(order):
        spark.createDataFrame([rows[i] for i in part], df.schema).coalesce(1).write.parquet(str(path / f"w{k}"))
        file = next((path / f"w{k}").glob("part-*.parquet"))
        file.rename(path / f"{k:03}.parquet")
        os.utime(path / f"{k:03}.parquet", (1_000_000_000 + k, 1_000_000_000 + k))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(path))


def batches(df, mode, checkpoint):
    """What each batch of a stream hands on."""
    out = []
    query = df.writeStream.outputMode(mode).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).foreachBatch(lambda d, n: out.append(d.collect())).start()
    query.awaitTermination(180)
    return [b for b in out if b]


def test_standings_stream_from_logs(stateful, sessions, tmp_path):
    spark = stateful
    got = batches(live.stream_standings(live.stream_events(spark, sessions)), "update", tmp_path / "cp")
    assert {(r["session_id"], r["agent_id"], r["score"], r["rank"]) for r in got[-1]} == {(r["session_id"], r["agent_id"], r["score"], r["rank"]) for r in live.standings(live.agent_state(rp.read_events(spark, sessions))).collect()}


def test_review_events(spark):
    lines = [{"kind": "start", "repo": "r", "pr": 1, "model": "m", "files_total": 2, "files_reviewed": 1, "n_chunks": 1}, {"kind": "proposer_done", "persona": "p", "chunk_idx": 0, "findings_count": 3, "duration_ms": 5}, {"kind": "synthesize_done", "n_raw": 3, "n_deduped": 2}, {"kind": "judge_done", "n_keep": 1, "n_downgrade": 1, "n_drop": 0, "duration_ms": 1}, {"kind": "done", "total_duration_ms": 9, "shippable_count": 2, "critical_count": 1, "total_prompt_tokens": 7, "total_completion_tokens": 8}]
    table = spark.createDataFrame([("s", json.dumps(x)) for x in lines] + [("s", "nothing"), ("s", "{}")], "session_id string, value string")
    r = live.review_progress(rp.parse_review_events(table)).first()
    assert (r["reviewers_done"], r["findings"], r["n_raw"], r["n_deduped"], r["n_keep"], r["n_downgrade"], r["prompt_tokens"], r["shippable"], r["criticals"]) == (1, 3, 3, 2, 1, 1, 7, 2, 1)


def test_reports_written_again_are_read_again(spark, tmp_path):
    import time

    (tmp_path / "in").mkdir()
    write = lambda ref: (tmp_path / "in" / "r.json").write_text(json.dumps({"language": "rust", "ref": ref, "runs": []}))
    seen = []
    query = live.watch_reports(spark, str(tmp_path / "in"), lambda df, n: seen.extend(json.loads(r["report"])["ref"] for r in df.collect()), str(tmp_path / "cp"), "1 second")
    try:
        for ref in ("first", "second"):
            time.sleep(4)
            write(ref)
        deadline = time.time() + 60
        while "second" not in seen and time.time() < deadline:
            time.sleep(0.5)
    finally:
        query.stop()
    assert seen == ["first", "second"]


def test_changed_reports_after_restarts(spark, tmp_path):
    """Each start reads what was written since the last one: new files, and old names written again; nothing twice."""
    import os

    from deltasieve.sources import report_source as rs

    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)

    def write(name, ref, at):
        (folder / name).write_text(json.dumps({"language": "rust", "ref": ref, "runs": []}) if ref else "{nothing")
        os.utime(folder / name, (at, at))

    def started():
        stream = rs.stream_changed_reports(spark, str(folder), start=1_000_000)
        events = live.reports_as_events(stream)
        return sorted(json.loads(r["report"])["ref"] for b in batches(events, "append", tmp_path / "cp") for r in b)

    write("old.json", "old", 999_999)
    write("a.json", "a1", 2_000_000)
    write("deep/b.json", "b1", 2_000_000)
    write("bad.json", None, 2_000_001)
    write("c.txt", "c", 2_000_001)
    assert started() == ["a1", "b1"]
    assert started() == []
    write("a.json", "a2", 2_000_005)
    write("d.json", "d1", 2_000_005)
    assert started() == ["a2", "d1"]
    write("d.json", "d2", 2_000_006)
    assert started() == ["d2"]
    assert live.reports_as_events(rs.stream_changed_reports(spark, str(folder))).isStreaming


def finished(df, mode, spark, tmp_path, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_events_skip_malformed_lines(spark, log):
    assert rp.read_events(spark, log).count() == 60
    assert live.since(rp.read_events(spark, log), 49).count() == 10


def test_stream_intake_and_dedupe(spark, log, tmp_path):
    stream = live.dedupe_events(live.stream_events(spark, log).unionByName(live.stream_events(spark, log)))
    assert finished(stream, "append", spark, tmp_path, "dedupe").count() == 60


def test_stream_tail_equals_batch(spark, log, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = live.stream_tail(spark.readStream.option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).text(log).transform(rp.event_lines).transform(rp.parse_events), 4)
    rows = finished(stream, "update", spark, tmp_path, "tail").collect()
    want = {(r["agent_id"], r["seq"]) for r in live.output_tail(rp.read_events(spark, log), 4).collect()}
    assert want <= {(r["agent_id"], r["seq"]) for r in rows}


def test_standings_in_batches(stateful, tmp_path):
    """In any order of files the last ranking of each tournament is the batch's; a batch hands on no tournament it didn't change."""
    spark = stateful
    cols = "session_id string, agent_id string, seq bigint, type string, name string, tournament_id string, regressions bigint, improvements bigint, delta_sum double, critical bigint"
    rows = [("s", f"a{a}", 10 * a + k, t, "n", f"t{a % 2}", a % 3, (a + k) % 4, 0.1 * a, a % 2) for a in range(6) for k, t in enumerate(("agentSpawned", "iterationCompare", "councilVerdict", "iterationCompare"))]
    rows += [("s", "a1", 100, "iterationCompare", None, None, None, None, None, None), ("s", "a3", 101, "notice", None, None, 9, 9, 9.0, 9)]
    events = spark.createDataFrame(rows, cols)
    shuffled = list(range(len(rows)))
    random.Random(3).shuffle(shuffled)
    order = [shuffled[:9], shuffled[9:18], shuffled[18:], [i for i, r in enumerate(rows) if r[1] == "a2"]]
    got = batches(live.stream_standings(in_files(spark, events, tmp_path / "in", order)), "update", tmp_path / "cp")
    last = {}
    for batch in got:
        for tournament in {r["tournament_id"] for r in batch}:
            last[tournament] = {(r["agent_id"], r["score"], r["rank"]) for r in batch if r["tournament_id"] == tournament}
    want = live.standings(live.agent_state(events)).collect()
    assert last == {t: {(r["agent_id"], r["score"], r["rank"]) for r in want if r["tournament_id"] == t} for t in ("t0", "t1")}
    assert len(got) <= 3  # the last file repeats events, and changes nothing


def test_change_points(stateful, tmp_path):
    spark = stateful
    rows = [("s", "a", i, f, 100 * i) for i, f in enumerate("xxyyxzz")] + [("s", "b", i, f, 70 * i) for i, f in enumerate(["p", None, "q", "q", "r"])]
    df = spark.createDataFrame(rows, "session_id string, agent_id string, seq bigint, fingerprint string, t bigint").selectExpr("session_id", "agent_id", "seq", "fingerprint", "timestamp_seconds(t) AS ts")
    want = [("a", 2, 1), ("a", 4, 2), ("a", 5, 3), ("b", 4, 1)]
    batch = sorted((r["agent_id"], r["seq"], r["iteration"]) for r in live.change_points(df).collect())
    assert batch == want
    far = spark.createDataFrame([("s", "z", 0, "x", 10**7)], "session_id string, agent_id string, seq bigint, fingerprint string, t bigint").selectExpr("session_id", "agent_id", "seq", "fingerprint", "timestamp_seconds(t) AS ts")
    shuffled = list(range(len(rows)))
    random.Random(5).shuffle(shuffled)
    order = [shuffled[:4], shuffled[4:8], shuffled[8:], [len(rows)]]  # the last event of all brings the watermark past the others
    stream = live.stream_change_points(in_files(spark, df.unionByName(far), tmp_path / "in", order), "20 minutes")
    got = batches(stream, "append", tmp_path / "cp")
    assert sorted((r["agent_id"], r["seq"], r["iteration"]) for b in got for r in b) == want


def test_numbered_log_of_two_writers_and_a_restart(stateful, tmp_path):
    spark = stateful
    rows = [(f"s{i % 2}", 1000 - i // 3, json.dumps({"writer": i % 3, "i": i})) for i in range(40)]
    events = spark.createDataFrame(rows, "session_id string, ts_ms bigint, value string")
    one = in_files(spark, events, tmp_path / "one", [range(0, 10), range(10, 15)])
    in_files(spark, events, tmp_path / "two", [range(20, 28)])
    two = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "two"))
    log, cp = str(tmp_path / "log"), str(tmp_path / "cp")
    live.append_log(one.unionByName(two), log, cp).awaitTermination(180)
    first = {(r["session_id"], r["seq"]): r["value"] for r in live.read_log(spark, log).collect()}
    assert len(first) == 23 and {v for v in first.values()} == {rows[i][2] for i in (*range(15), *range(20, 28))}
    # Started again: what is there stays, and numbers go on.
    spark.createDataFrame([rows[i] for i in range(28, 40)], events.schema).coalesce(1).write.parquet(str(tmp_path / "more"))
    next((tmp_path / "more").glob("part-*.parquet")).rename(tmp_path / "two" / "more.parquet")
    live.append_log(one.unionByName(two), log, cp).awaitTermination(180)
    got = {(r["session_id"], r["seq"]): r["value"] for r in live.read_log(spark, log).collect()}
    assert first.items() <= got.items() and len(got) == 35 and live.read_log(spark, log).count() == 35
    for session in ("s0", "s1"):
        numbers = sorted(n for s, n in got if s == session)
        assert numbers == list(range(1, len(numbers) + 1))
    assert live.read_log(spark, log, after=10).count() == 35 - 20


def test_trajectory_stream_with_known_and_late_bases(stateful, tmp_path):
    spark = stateful
    diff = "array<struct<bench:string,head_median:double>>"
    rows = [("s", "a", i, "iterationCompare", i, [("b0", 100.0 + 10 * i), ("b1", 50.0), ("none", 1.0)][: 2 + i % 2] + [("b2", None)]) for i in range(6)] + [("s", "a", 9, "notice", None, [])]
    events = spark.createDataFrame(rows, f"session_id string, agent_id string, seq bigint, type string, iteration bigint, diffs {diff}")
    known = spark.createDataFrame([("s", "b0", 110.0), ("other", "b0", 1.0)], "session_id string, bench string, base_median double")
    late = spark.createDataFrame([("s", "b1", 40.0)], known.schema)
    stream = live.stream_trajectory(in_files(spark, events, tmp_path / "in", [[3, 1], [5, 6, 0], [2, 4]]), known, in_files(spark, late, tmp_path / "late", [[0]]))
    got = sorted(tuple(r) for b in batches(stream, "append", tmp_path / "cp") for r in b)
    want = sorted(tuple(r) for r in live.trajectory(events, known.unionByName(late)).select("session_id", "agent_id", "iteration", "bench", "median", "verdict").collect())
    assert got == want and len(want) == 12


def test_reports_and_baselines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    report = {"language": "rust", "service": "s", "ref": "main", "finishedAt": "t", "runs": [{"name": "b", "file": "f.rs", "samples": [1.0, 2.0], "tags": ["x"]}]}
    (tmp_path / "in" / "r1.json").write_text(json.dumps(report, indent=1))
    runs = rp.read_run_reports(spark, str(tmp_path / "in"))
    assert rp.explode_samples(runs).count() == 2 and runs.first()["bench"] == "b"
    table = rp.BaselineTable(spark, str(tmp_path / "base"))
    table.save("main", runs)
    table.save("main", runs)
    table.save("other", runs)
    assert table.load("main").count() == 1 and table.list().count() == 2
    table.remove("other")
    assert [tuple(r) for r in table.list().collect()] == [("main", 1, True)]
    (tmp_path / "base" / "baseline=bad").mkdir()
    (tmp_path / "base" / "baseline=bad" / "part.parquet").write_text("no parquet")
    assert {r["baseline"]: r["valid"] for r in table.list().collect()} == {"main": True, "bad": False}
    assert rp.BaselineTable(spark, str(tmp_path / "none")).list().count() == 0
    with pytest.raises(ValueError):
        table.save("../x", runs)
    events = finished(live.reports_as_events(live.stream_reports(spark, str(tmp_path / "in"), "2020-01-01")), "append", spark, tmp_path, "reports")
    assert events.first()["type"] == "runIngested"
    assert finished(live.stream_reports(spark, str(tmp_path / "in"), "2999-01-01"), "append", spark, tmp_path, "late").count() == 0


def test_trees_cases_and_comments(spark, tmp_path):
    for name, text in {"a/x.ts": "import 'y'", "b.rs": "mod a;"}.items():
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text(text)
    assert {r["path"] for r in rp.read_repo_files(spark, str(tmp_path / "tree")).collect()} == {"a/x.ts", "b.rs"}
    (tmp_path / "diffs").mkdir()
    (tmp_path / "diffs" / "pr-17.diff").write_text("diff --git a/x b/x")
    assert rp.read_diffs(spark, str(tmp_path / "diffs")).first()["pr"] == 17
    cases = tmp_path / "cases"
    cases.mkdir()
    (tmp_path / "index.json").write_text(json.dumps({"cases": ["one.json"]}))
    for name in ("one", "two"):
        (cases / f"{name}.json").write_text(json.dumps({"name": name, "diff": "d", "expected": [{"file": "f", "lineRange": [1, 3], "severity": "major"}], "forbidden": [{"path": "p"}], "maxFindings": 2}))
    got = rp.read_cases(spark, str(cases), str(tmp_path / "index.json"))
    assert [r["case"] for r in got["cases"].collect()] == ["one"]
    assert got["expected"].first()["line_hi"] == 3 and got["forbidden"].first()["path"] == "p"
    (tmp_path / "comments.json").write_text(json.dumps([{"id": 1, "body": "b", "reactions": {"heart": 2}}]))
    row = rp.read_comments(spark, str(tmp_path / "comments.json")).first()
    assert (row["author_association"], row["reactions"]["heart"], row["reactions"]["confused"]) == ("NONE", 2, 0)
    lines = spark.createDataFrame([("METRIC a=1.5",), ("METRIC b=x",), ("other",)], "value string")
    assert [tuple(r) for r in rp.metric_lines(lines).collect()] == [("a", 1.5)]


def test_metric_query_counts_and_adds_up_names(spark, tmp_path):
    spark.createDataFrame([(k, k % 50) for k in range(31)], "p_partkey bigint, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = sorted(tuple(r) for r in intake.metrics(spark, str(tmp_path)).collect())
    parts = [k for k in range(31) if k % 3 == 0]
    of = lambda k: [float(p) for p in parts if p % 10 == k % 10]
    assert got == sorted((f"k{k % 10}", float(k), len(of(k)), sum(of(k))) for k in parts)


def test_log_lines_are_parsed_once_and_numbered_over_ranges(spark):
    event = lambda i: json.dumps({"Action": "output", "Test": "T", "Package": f"p{i}", "Output": f"Benchmark{i % 2} {i} ns/op" if i % 3 else " 5 ns/op "})
    lines = spark.createDataFrame([(i, f" {event(i)} ") for i in range(60)] + [(99, "PASS"), (100, None)], "line_no bigint, value string").repartition(3)
    got = rp.go_events_to_samples(lines)
    assert "from_json" not in got._jdf.queryExecution().toString()
    want = []
    for bench, own in (("T", range(0, 60, 3)), ("Benchmark0", [i for i in range(0, 60, 2) if i % 3]), ("Benchmark1", [i for i in range(1, 60, 2) if i % 3])):
        want += [(bench, f"p{own[0]}", k, float(i) if bench != "T" else 5.0) for k, i in enumerate(own)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_latency_stream_equals_batch(spark, tmp_path):
    rows = [("s", "p", i, 1_700_000_000 + i * 10 + d, d) for i in range(6) for d in (0, 3)]
    df = spark.createDataFrame(rows, "session_id string, persona string, chunk_idx bigint, t bigint, d int").selectExpr("session_id", "persona", "chunk_idx", "timestamp_seconds(t) AS ts", "d")
    want = sorted(map(tuple, live.reviewer_latency(df.where("d = 0"), df.where("d = 3")).collect()))
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = finished(live.reviewer_latency(stream().where("d = 0"), stream().where("d = 3")), "append", spark, tmp_path, "latency")
    assert sorted(map(tuple, got.collect())) == want and want[0][3] == 3000
