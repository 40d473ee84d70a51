"""Findings, feedback and evaluation against plain folds."""

import json
import random

from pyspark.sql import functions as F

from deltasieve.operators import corpus as co
from deltasieve.operators import evals as ev
from deltasieve.operators import findings as fi
from deltasieve.options import GuidanceOptions

SCHEMA = "repo string, pr bigint, seq bigint, file string, line bigint, severity string, sev_rank int, category string, title string, rationale string, suggestion string, raised_by string"


def absorbed(rows, window=3, least=0.55):
    """The merge, told anew: rows in order look back over survivors, as far as lines are near, for one alike."""
    import re

    survivors = []
    for row in rows:
        words = set(re.findall(r"[^\W_]+", row["title"]))
        for old in survivors[::-1]:
            known = old["line"] is not None and row["line"] is not None
            if known and abs(old["line"] - row["line"]) > window:
                survivors.append(dict(row))
                break
            other = set(re.findall(r"[^\W_]+", old["title"]))
            share = len(words & other) / len(words | other) if words | other else 1.0
            if old["title"] == row["title"] or share >= least:
                if row["sev_rank"] > old["sev_rank"]:
                    old.update(sev_rank=row["sev_rank"], severity=row["severity"])
                names = (old["raised_by"] or "").split("+") if old["raised_by"] else []
                if row["raised_by"] and row["raised_by"] not in names:
                    old["raised_by"] = "+".join([*names, row["raised_by"]])
                if len(row["rationale"].encode()) > len(old["rationale"].encode()):
                    old["rationale"] = row["rationale"]
                if old["suggestion"] is None:
                    old["suggestion"] = row["suggestion"]
                old["merged"] += 1
                break
        else:
            survivors.append(dict(row))
    return survivors


def test_merge_equals_the_whole_file_fold(spark):
    rng = random.Random(11)
    words = ["null", "check", "loop", "slow"]
    rows = []
    for i in range(300):
        rank = rng.randint(0, 3)
        rows.append(("r", 1, i, rng.choice("ab"), rng.choice([None, *range(0, 60)]), list(fi.SEVERITY_RANK)[rank], rank, "c", " ".join(rng.choices(words, k=rng.randint(0, 3))), "x" * rng.randint(0, 9), rng.choice([None, "s"]), rng.choice(["p", "q", None])))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    want = []
    for file in "ab":
        some = sorted((dict(zip(names, r, strict=True)) | {"merged": 1} for r in rows if r[3] == file), key=lambda r: (r["line"] is None, r["line"] or 0, r["title"], r["seq"]))
        want += absorbed(some)
    key = lambda r: (r["seq"], r["merged"], r["sev_rank"], r["raised_by"], r["rationale"], r["suggestion"])
    got = fi.merge_findings(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, map(key, got))) == sorted(str(key(r)) for r in want)
    assert sum(r["merged"] for r in got) == 300


def merged_by_fold(rows):
    """The plain fold of rows, file by file, by the words that title_tokens() has."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    some = sorted((dict(zip(names, r, strict=True)) | {"merged": 1} for r in rows), key=lambda r: (r["line"] is None, r["line"] or 0, r["title"], r["seq"]))
    return sorted((r["seq"], r["merged"]) for r in absorbed(some))


def test_merge_of_a_large_file_without_lines(spark):
    """Many alike titles (taken in by one), many unlike ones with common words, and copies of one."""
    alike = [f"unused variable in x{i}" for i in range(400)]
    unlike = [f"check number {i} of loop{i}" for i in range(400)]
    titles = alike + unlike + ["same title"] * 300 + [f"a b{i % 7} c{i % 5} d{i % 3}" for i in range(200)]
    random.Random(2).shuffle(titles)
    rows = [("r", 1, i, "f", None, "nit", 0, "c", t, "", None, None) for i, t in enumerate(titles)]
    got = fi.merge_findings(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["seq"], r["merged"]) for r in got) == merged_by_fold(rows)


def test_merge_along_the_lines_of_a_file(spark):
    """A finding on every line: a chain, of which each survivor follows from the one before."""
    rows = [("r", 1, i, "f", i, "nit", 0, "c", "missing doc", "", None, None) for i in range(200)]
    got = fi.merge_findings(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["seq"], r["merged"]) for r in got) == [(i, 4) for i in range(0, 200, 4)]


def test_titles_of_all_scripts_and_none(spark):
    titles = ["भाषा", "भूषि", "漢字 検査", "漢字  検査!", None, None, "--", "été_x"]
    rows = [("r", 1, i, "f", None, "nit", 0, "c", t, None, None, "p+q" if i % 2 else "p") for i, t in enumerate(titles)]
    d = spark.createDataFrame(rows, SCHEMA)
    assert {(r["a"], r["b"]) for r in fi.near_duplicate_pairs(d).collect()} == {(2, 3), (4, 5), (4, 6), (5, 6)}
    got = {r["seq"]: (r["merged"], r["title"], r["raised_by"], r["rationale"]) for r in fi.merge_findings(d).collect()}
    assert got == {0: (1, titles[0], "p", None), 1: (1, titles[1], "p+q", None), 3: (2, titles[3], "p+q", None), 4: (3, None, "p+p+q", None), 7: (1, titles[7], "p+q", None)}
    assert fi.merge_findings(d.limit(0)).count() == 0


def test_pairs_equal_all_pairs(spark):
    import re

    rng = random.Random(12)
    words = ["null", "check", "loop", "slow", "index", "off"]
    rows = [("r", 1, i, rng.choice("ab"), rng.choice([None, None, *range(0, 30)]), "nit", 0, "c", " ".join(rng.choices(words, k=rng.randint(0, 5))), "", None, None) for i in range(150)]
    want = set()
    for x in rows:
        for y in rows:
            if x[2] < y[2] and x[3] == y[3] and (None in (x[4], y[4]) or abs(x[4] - y[4]) <= 3):
                s, t = (set(re.findall(r"[^\W_]+", z[8])) for z in (x, y))
                if x[8] == y[8] or not s | t or len(s & t) / len(s | t) >= 0.55:
                    want.add((x[3], x[2], y[2]))
    got = [(r["file"], r["a"], r["b"]) for r in fi.near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_responses(spark):
    texts = [
        '```json\n{"findings":[{"title":" a ","severity":"BLOCKER","line":3}]}\n```',
        'So: {"findings":[{"title":"b","category":"perf"},{"title":" "}]} done',
        '{"findings":[{"title":"c"},{"title":5}]}',
        '{"findings":[{"title":"d","line":-1}]}',
        "no json",
        '{"other":1}',
        None,
    ]
    d = spark.createDataFrame([("r", 1, i, "security", t) for i, t in enumerate(texts)], "repo string, pr bigint, chunk_idx int, persona string, raw string")
    got = {(r["title"], r["severity"], r["category"], r["line"]) for r in fi.parse_findings(d).collect()}
    assert got == {("a", "critical", "security", 3), ("b", "minor", "performance", None)}


def judged(spark, rows):
    """(pr, seq, severity rank, title, verdict, confidence) as judged findings."""
    full = [("r", p, s, f"f{s}", 1, list(fi.SEVERITY_RANK)[k], k, "c", t, v, c) for p, s, k, t, v, c in rows]
    return spark.createDataFrame(full, "repo string, pr bigint, seq bigint, file string, line bigint, severity string, sev_rank int, category string, title string, verdict string, confidence double")


def curated(spark, rows, decisions):
    table = spark.createDataFrame([("r", p, i, a, at) for at, (p, i, a) in enumerate(decisions)], "repo string, pr bigint, index bigint, action string, at bigint")
    return {(r["pr"], r["seq"]): r["verdict"] for r in fi.apply_curation(judged(spark, rows), table).collect()}


def test_curation_numbers_what_would_ship(spark):
    rows = [(1, 0, 3, "was dropped", "drop", 0.9), (1, 1, 3, "unsure", "keep", 0.2), (1, 2, 2, "major", "keep", 0.9), (1, 3, 1, "minor", "downgrade", 0.9), (1, 4, 0, "nit", "keep", 0.9)]
    same = {(1, 0): "drop", (1, 1): "keep", (1, 2): "keep", (1, 3): "downgrade", (1, 4): "keep"}
    assert curated(spark, rows, [(1, 1, "keep")]) == same
    assert curated(spark, rows, [(1, 1, "keep"), (1, 2, "drop")]) == same | {(1, 3): "drop"}
    assert curated(spark, rows, [(1, 1, "keep-rest")]) == same
    assert curated(spark, rows, [(1, 1, "drop-rest")]) == same | {(1, 2): "drop", (1, 3): "drop", (1, 4): "drop"}
    assert curated(spark, rows, [(1, 1, "drop"), (1, 2, "keep-rest")]) == same | {(1, 2): "drop"}
    assert curated(spark, rows, [(1, 2, "drop-rest"), (1, 3, "keep")]) == same | {(1, 3): "drop"}
    assert curated(spark, rows, [(1, 9, "drop"), (2, 1, "drop")]) == same
    assert curated(spark, rows, [(1, 1, "drop"), (1, 1, "keep")]) == same


def test_white_space_in_responses(spark):
    texts = ['\n\t```json\n{"findings":[{"title":"\\n\\t ","severity":"\\tblocker"}]}\n```\r\n', '{"findings":[{"title":"\\ta\\r\\n","severity":"\\tblocker\\u2003","rationale":"\\n"}]}']
    d = spark.createDataFrame([("r", 1, i, "security", t) for i, t in enumerate(texts)], "repo string, pr bigint, chunk_idx int, persona string, raw string")
    assert [(r["title"], r["severity"], r["rationale"]) for r in fi.parse_findings(d).collect()] == [("a", "critical", "")]


def test_guidance_block_counts_its_header_and_marks_the_overflow(spark):
    lines = spark.createDataFrame([("r", i, f"{i}. " + "é" * 20 + "\n") for i in range(1, 6)] + [("q", 1, "1. short\n")], "repo string, place int, line string")
    size = len(co.HEADER.encode())
    got = {}
    for r in co.budget_prefix(lines, GuidanceOptions(limit=size + 100)).orderBy("repo", "place").collect():
        got.setdefault(r["repo"], []).append(r["line"])
    assert got["q"] == [co.HEADER, "1. short\n"]
    assert got["r"][:3] == [co.HEADER, "1. " + "é" * 20 + "\n", "2. " + "é" * 20 + "\n"] and got["r"][3:] == ["…\n"]
    assert co.budget_prefix(lines.limit(0)).count() == 0


def test_globs_found_by_index_as_by_all_pairs(spark):
    rng = random.Random(4)
    parts = ["src", "src2", "a", "b.rs", "x.test.ts", "", "*", "**"]
    globs = {"/".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(120)} | {"src/**", "src/*", "**/x.test.ts", "**/a/b.rs", "**/", "*", "*.rs", "sr*", "src/a*", "s*/b.rs", "src*.ts", "", "a/*/b.rs"}
    paths = {"/".join(rng.choices([p for p in parts if "*" not in p], k=rng.randint(1, 4))) for _ in range(120)} | {"src", "b.rs", "src/a/b.rs", "", "é/ü.rs"}
    g = spark.createDataFrame([("r", x) for x in globs], "repo string, file_glob string")
    p = spark.createDataFrame([("r", x) for x in paths] + [("q", "src/a"), ("r", None)], "repo string, path string")
    want = {tuple(r) for r in g.join(p, "repo").where(co.glob_matches(F.col("file_glob"), F.col("path"))).select("path", "file_glob").collect()}
    got = [tuple(r) for r in co.matching_globs(g, p, ["repo"]).select("path", "file_glob").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def test_guidance_of_two_reviews(spark):
    corpus = spark.createDataFrame([("r", "a", "g", "src/**", None, "confirmed", 1, 0, 2.0), ("r", "b", "g", "*.go", "security", "confirmed", 1, 0, 3.0), ("r", "c", "g", None, "performance", "confirmed", 1, 0, 1.0), ("s", "d", "g", "x", None, "confirmed", 1, 0, 1.0)], "repo string, id string, guidance string, file_glob string, category string, strongest_kind string, confirmations int, refutations int, score double")
    changed = spark.createDataFrame([("r", 1, "src/x"), ("r", 2, "m.go"), ("r", 3, None)], "repo string, pr bigint, path string")
    chosen = co.select_guidance(corpus, changed)
    assert {(r["repo"], r["pr"], r["id"], r["place"]) for r in chosen.collect()} == {("r", 1, "a", 1), ("r", 1, "c", 2), ("r", 2, "b", 1), ("r", 2, "c", 2), ("r", 3, "b", 1), ("r", 3, "a", 2), ("r", 3, "c", 3), ("s", None, "d", 1)}
    block = co.budget_prefix(co.guidance_lines(chosen))
    assert {(r["repo"], r["pr"], r["place"]) for r in block.where("repo = 'r' AND pr < 3").collect()} == {("r", p, n) for p in (1, 2) for n in range(3)}
    assert {r["id"] for r in co.select_guidance(corpus, None, "security", GuidanceOptions(keep=1)).collect()} == {"b", "d"}


def test_a_run_without_records_is_refused(spark):
    import pytest

    cases = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "run string, case bigint").withColumns({c: F.lit(None).cast("bigint") for c in ("max_findings", "duration_ms", "prompt_tokens", "completion_tokens")}).withColumn("judge_error", F.lit(None).cast("string"))
    record = "run string, case bigint, seq bigint, file string, line bigint, severity string, sev_rank int, category string, confidence double, verdict string, title string"
    some = [("x", 1, 1, "f", 3, "major", 2, "security", 0.9, "keep", "t")]
    expected = spark.createDataFrame([("x", 1, 0, "f", None, None, 2, None, True)], "run string, case bigint, ord bigint, file string, line_lo bigint, line_hi bigint, sev_rank int, category string, must_catch boolean")
    forbidden = spark.createDataFrame([], "run string, case bigint, path string")
    with pytest.raises(ValueError, match="y"):
        ev.recalibrate(spark.createDataFrame(some, record), cases, expected, forbidden, [0.5])
    with pytest.raises(ValueError):
        ev.recalibrate(spark.createDataFrame([], record), cases, expected, forbidden, [0.5])
    with pytest.raises(ValueError, match="unknown"):
        ev.recalibrate(spark.createDataFrame([*some, ("y", 9, *some[0][2:])], record), cases, expected, forbidden, [0.5])
    ok = ev.recalibrate(spark.createDataFrame(some, record), cases.where("run = 'x'"), expected, forbidden, [0.5, 0.95])
    assert {(r["floor"], r["critical_recall"], r["recall_major"]) for r in ok.collect()} == {(0.5, 1.0, 1.0), (0.95, 1.0, 0.0)}


def test_stored_corpora_heal(spark):
    from deltasieve.sources import reports as rp

    good = {"id": "a", "guidance": "g", "strongestKind": "confirmed", "sourcePr": 1, "firstSeen": "x", "lastSeen": "y"}
    odd = [
        good,
        good | {"id": None, "strongestKind": "\tDirective ", "category": "SECURITY", "fileGlob": "src/**", "lastSeen": 3, "sourcePr": "1", "confirmations": -3, "refutations": 2**32 + 1},
        good | {"strongestKind": "weird", "category": "zzz", "sourceCommentId": 1.5, "guidance": "z" * 5000},
        {k: v for k, v in good.items() if k not in ("strongestKind", "sourcePr", "lastSeen")},
        {k: v for k, v in good.items() if k != "firstSeen"},
        good | {"guidance": " \t"},
        good | {"guidance": 7},
        42,
        [good],
        None,
    ]
    texts = {"odd": json.dumps({"schemaVersion": 1, "entries": odd}), "text": '{"schemaVersion": "9999999999999999999", "entries": []}', "big": '{"schemaVersion": 5000000000}', "minus": '{"schemaVersion": -1}', "object": '{"schemaVersion": {"v": 1}}', "old": json.dumps({"entries": [good]}), "empty": ""}
    entries, summary = rp.load_corpus(spark.createDataFrame(list(texts.items()), "repo string, value string"))
    got = [r for r in entries.where("repo = 'odd'").collect()]
    assert sorted((r["strongest_kind"], r["category"] or "", r["source_pr"], r["confirmations"], r["refutations"], r["last_seen"], len(r["guidance"])) for r in got) == [
        ("confirmed", "", 0, 0, 0, "x", 1), ("confirmed", "", 1, 0, 0, "y", 1), ("confirmed", "", 1, 0, 0, "y", 2000), ("user-directive", "security", 0, 0, 1, "x", 1)]
    made = spark.range(1).select(co.entry_id(F.lit("src/**"), F.lit("security"), F.lit("g"))).first()[0]
    assert {r["id"] for r in got} == {"a", made}
    s = {r["repo"]: (r["invalid"], r["future"], r["upgraded_from"], r["entries_loaded"], r["entries_dropped"]) for r in summary.collect()}
    assert s == {"odd": (False, None, None, 4, 6), "text": (True, None, None, 0, 0), "big": (False, 2**32 - 1, None, 0, 0), "minus": (True, None, None, 0, 0), "object": (True, None, None, 0, 0), "old": (False, None, 0, 1, 0), "empty": (False, None, None, 0, 0)}


def test_verdicts_default(spark):
    c = spark.createDataFrame([("r", 1, i) for i in range(3)], "repo string, pr bigint, index bigint")
    raw = json.dumps({"verdicts": [{"index": 0, "verdict": "keep"}, {"index": 0, "verdict": "reject", "confidence": 7}, {"index": 9}]})
    got = {r["index"]: (r["verdict"], r["confidence"]) for r in fi.parse_verdicts(spark.createDataFrame([("r", 1, raw)], "repo string, pr bigint, raw string"), c).collect()}
    assert got == {0: ("drop", 1.0), 1: ("keep", 0.6), 2: ("keep", 0.6)}


def test_score_and_globs(spark):
    rows = [("user-directive", 1, 0, "2026-01-01T00:00:00Z"), ("confirmed", 1, 0, "2025-11-02T00:00:00Z"), ("refuted", 0, 3, "2026-01-01T00:00:00Z"), ("confirmed", 0, 0, "??"), ("confirmed", 0, 0, "2027-01-01T00:00:00Z")]
    d = spark.createDataFrame(rows, "strongest_kind string, confirmations int, refutations int, last_seen string")
    assert [round(r["score"], 6) for r in co.score_entries(d, "2026-01-01T00:00:00Z").collect()] == [6.0, 1.5, 0.0, 0.2, 2.0]
    g = spark.createDataFrame([("src/**", "src/a/b", True), ("src/**", "srcx", False), ("src/*", "src/a", True), ("src/*", "src/a/b", False), ("**/x.rs", "a/x.rs", True), ("a*c", "abc", True), ("a*c", "ac", True), ("p", "q", False)], "g string, p string, want boolean")
    assert all(r[0] == r[1] for r in g.select(co.glob_matches(F.col("g"), F.col("p")), "want").collect())


def test_assignment_equals_the_plain_fold(spark):
    rng = random.Random(8)
    pairs = {(o, s) for o in range(30) for s in range(30) if rng.random() < 0.12}
    want, used = {}, set()
    for o in range(30):
        for s in sorted(s for x, s in pairs if x == o):
            if s not in used:
                want[o] = s
                used.add(s)
                break
    d = spark.createDataFrame([("a", 1, o, s) for o, s in pairs], "run string, case bigint, ord bigint, seq bigint")
    assert {r["ord"]: r["seq"] for r in ev.assign_matches(d).collect()} == want


def test_merge_entries_idempotent(spark):
    cols = "repo string, id string, guidance string, file_glob string, category string, strongest_kind string, source_pr bigint, source_comment_id bigint, confirmations int, refutations int, first_seen string, last_seen string"
    old = spark.createDataFrame([("r", "x", " ", None, None, "refuted", 1, 5, 1, 1, "a", "m")], cols)
    new = spark.createDataFrame([("r", "x", "g", None, None, "confirmed", 1, 5, 1, 0, "b", "c"), ("r", "y", "h", None, None, "confirmed", 2, 6, 1, 0, "b", "z")], cols)
    got = {r["id"]: r for r in co.merge_entries(old, new).collect()}
    assert (got["x"]["guidance"], got["x"]["strongest_kind"], got["x"]["confirmations"], got["x"]["last_seen"]) == ("g", "confirmed", 2, "m")
    assert got["y"]["added"] and not got["x"]["added"]
    again = {r["id"]: r for r in co.merge_entries(old, new, idempotent=True).collect()}
    assert again["x"]["confirmations"] == 1


def test_titles_are_dealt_out_as_hashes(spark):
    titles = ["Slow \u00fcber query", "slow", "", None, "query Slow \u00fcber", "Slow Slow"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "node bigint, title string").withColumn("tokens", fi.word_keys(F.col("title")))
    assert dict(rows.dtypes)["tokens"] == "array<bigint>"
    got = {r["node"]: set(r["tokens"]) for r in rows.collect()}
    assert [len(got[i]) for i in range(6)] == [3, 1, 0, 0, 3, 1] and got[0] == got[4] and got[5] < got[0] and not got[1] & got[0]
    met = fi._meeting(rows.withColumn("k", F.lit(1)), ["k"], 0.55)
    assert dict(met.dtypes)["block"] == "bigint" and not {"low", "high", "word"} & set(met.columns)
    at = {i: {r["block"] for r in met.collect() if r["node"] == i} for i in range(6)}
    assert at[0] & at[4] and at[2] == at[3] and not at[0] & at[2]
