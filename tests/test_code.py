"""Imports, closures, symbols and diffs."""

import random

import pytest
from pyspark.sql import functions as F

from deltasieve.functions import text as tx
from deltasieve.operators import codegraph as cg
from deltasieve.operators import diffs as df
from deltasieve.operators import impact as im
from deltasieve.options import ChunkPolicy


def files(spark, table):
    ext = {"ts": "ts", "go": "go", "rs": "rust", "js": "ts"}
    rows = [("r", p, ext.get(p.rsplit(".", 1)[-1]), c) for p, c in table.items()]
    return spark.createDataFrame(rows, "repo string, path string, language string, content string")


def test_imports_resolve(spark):
    f = files(spark, {
        "a/x.ts": "import y from './y'\nimport './sub'\nconst z = require('../b/z.js'); // from './no'\nimport q from 'lib'",
        "a/y.ts": "", "a/y.js": "", "a/sub/index.ts": "", "b/z.js": "",
        "g/m.go": 'import (\n "fmt"\n p "./pkg"\n)', "g/pkg/one.go": "", "g/pkg/two.go": "",
        "s/lib.rs": 'pub mod inner;\nmod deep;\n#[path = "odd.rs"]\ninclude!("inc.rs");', "s/inner.rs": "", "s/deep/mod.rs": "", "s/odd.rs": "", "s/inc.rs": "",
    })
    got = {(r["src"], r["dst"]) for r in im.import_edges(f).collect()}
    assert got == {("a/x.ts", "a/y.ts"), ("a/x.ts", "a/sub/index.ts"), ("a/x.ts", "b/z.js"), ("g/m.go", "g/pkg/one.go"), ("g/m.go", "g/pkg/two.go"), ("s/lib.rs", "s/inner.rs"), ("s/lib.rs", "s/deep/mod.rs"), ("s/lib.rs", "s/odd.rs"), ("s/lib.rs", "s/inc.rs")}


def test_another_extractor(spark):
    f = files(spark, {"a.ts": "b.ts", "b.ts": ""})
    own = lambda d: d.where("content <> ''").select("repo", "path", "language", F.concat(F.lit("./"), "content").alias("spec"))
    assert [(r["src"], r["dst"]) for r in im.import_edges(f, own).collect()] == [("a.ts", "b.ts")]


def test_closure_with_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("e", "c")], "src string, dst string")
    entries = spark.createDataFrame([("a",), ("d",), ("e",)], "entry string")
    got = {(r["entry"], r["node"]) for r in im.reachable(edges, entries).collect()}
    assert got == {("a", "a"), ("a", "b"), ("a", "c"), ("d", "d"), ("e", "e"), ("e", "c"), ("e", "a"), ("e", "b")}
    changed = spark.createDataFrame([("b",)], "node string")
    assert {r["entry"] for r in im.affected_entries(edges, entries, changed).collect()} == {"a", "e"}


def test_paths_and_globs(spark):
    d = spark.createDataFrame([("a/./b/../c",), ("../x",), ("/r//s",)], "p string")
    assert [r[0] for r in d.select(tx.normalize_path(F.col("p"))).collect()] == ["a/c", "x", "/r/s"]
    assert tx.glob_to_regex("**/*.bench.ts") == r"^.*[^/]*\.bench\.ts$"


def test_symbols_and_calls(spark):
    src = "export function f(a) {\n  g(a);\n}\nclass K {}\nfunc g() { if (x) f(1) }\npub struct S;"
    f = files(spark, {"a.ts": src})
    s = cg.extract_symbols(f)
    assert {(r["kind"], r["name"], r["line"], r["exported"]) for r in s.collect()} == {("fn", "f", 1, True), ("cls", "K", 4, False), ("fn", "g", 5, False), ("type", "S", 6, True)}
    assert {r["to"] for r in cg.call_edges(f, s).collect()} == {"fn:f", "fn:g"}
    assert {(r["caller"], r["name"]) for r in cg.attribute_calls(cg.calls_by_line(f), s).collect()} == {("f", "g"), ("g", "f")}


DIFF = """diff --git a/src/a.rs b/src/a.rs
index 1..2
--- a/src/a.rs
+++ b/src/a.rs
@@ -1,2 +1,2 @@
-old
+new
++++odd
diff --git a/gone.go b/gone.go
deleted file mode 100644
--- a/gone.go
+++ /dev/null
@@ -1 +0,0 @@
-x
diff --git a/p b/q
rename from p
rename to q
diff --git a/img.png b/img.png
Binary files a/img.png and b/img.png differ
diff --git a/w/Cargo.lock b/w/Cargo.lock
--- a/w/Cargo.lock
+++ b/w/Cargo.lock
@@ -1 +1 @@
+z"""


@pytest.mark.parametrize("text", [DIFF, DIFF.replace("\n", "\r\n")])
def test_parse_diff(spark, text):
    d = spark.createDataFrame([("r", 1, text)], "repo string, pr bigint, diff string")
    parsed = df.parse_diff_files(df.split_diffs(d))
    rows = {r["path"]: r for r in parsed.collect()}
    assert list(rows) == ["src/a.rs", "gone.go", "q", "img.png", "w/Cargo.lock"]
    assert (rows["src/a.rs"]["additions"], rows["src/a.rs"]["deletions"]) == (2, 1)
    assert rows["gone.go"]["is_deleted"] and rows["q"]["is_pure_rename"] and not rows["img.png"]["is_pure_rename"]
    kept, dropped = df.filter_ignored(parsed)
    assert [r["path"] for r in dropped.collect()] == ["w/Cargo.lock"] and kept.count() == 4


def pack(sizes, policy):
    chunk, body, any_, ctx, out = 0, 0, False, 0, []
    for pos, (b, c) in enumerate(sizes):
        keep = c is not None and ctx + c <= policy.chunk_context_bytes
        ctx += c if keep else 0
        if any_ and body + b + 1 > policy.chunk_bytes:
            chunk, body, ctx = chunk + 1, 0, 0
        body += (body > 0) + b
        any_ = True
        out.append((pos, chunk, keep))
    return out


def test_packing_equals_the_plain_fold(spark):
    rng = random.Random(3)
    policy = ChunkPolicy(chunk_bytes=60, chunk_context_bytes=50)
    rows, want = [], {}
    for pr in range(15):
        sizes = [(rng.randint(1, 50), rng.choice([None, rng.randint(0, 40)])) for _ in range(rng.randint(1, 20))]
        want[pr] = pack(sizes, policy)
        rows += [("r", pr, i, f"f{i}", False, "x" * b, None if c is None else "y" * c) for i, (b, c) in enumerate(sizes)]
    t = spark.createDataFrame(rows, "repo string, pr bigint, pos int, path string, is_deleted boolean, body string, context string")
    got = {}
    for r in df.pack_chunks(t, policy).orderBy("pr", "pos").collect():
        got.setdefault(r["pr"], []).append((r["pos"], r["chunk_idx"], r["context"] is not None))
    assert got == want


@pytest.mark.parametrize("limit", [1, 30])
def test_packing_with_empty_bodies_and_gaps(spark, limit):
    rng = random.Random(limit)
    policy = ChunkPolicy(chunk_bytes=limit, chunk_context_bytes=20)
    rows, want = [], {}
    for pr in range(40):
        sizes = [(rng.choice([0, 0, 1, limit - 1, limit, rng.randint(0, limit + 9)]), rng.choice([None, rng.randint(0, 25)])) for _ in range(rng.randint(1, 12))]
        want[pr] = [(100 * pos, chunk, keep) for pos, chunk, keep in pack(sizes, policy)]
        rows += [("r", pr, 100 * i, f"f{i}", False, "x" * b or None, None if c is None else "y" * c) for i, (b, c) in enumerate(sizes)]
    t = spark.createDataFrame(rows, "repo string, pr bigint, pos int, path string, is_deleted boolean, body string, context string")
    got = {}
    for r in df.pack_chunks(t, policy).orderBy("pr", "pos").collect():
        got.setdefault(r["pr"], []).append((r["pos"], r["chunk_idx"], r["context"] is not None))
    assert got == want


def test_packing_of_a_hundred_thousand_files(spark):
    policy = ChunkPolicy(chunk_bytes=50_000, chunk_context_bytes=2_000)
    n = 100_000
    body, context = (F.col("id") * 7919) % 211 + 1, (F.col("id") * 104729) % 97
    t = spark.range(n).select(F.lit("r").alias("repo"), F.lit(1).cast("bigint").alias("pr"), F.col("id").cast("int").alias("pos"), F.repeat(F.lit("x"), body.cast("int")).alias("body"), F.repeat(F.lit("y"), context.cast("int")).alias("context"))
    got = [tuple(r) for r in df.pack_chunks(t, policy).orderBy("pos").select("pos", "chunk_idx", F.col("context").isNotNull()).collect()]
    assert got == pack([((i * 7919) % 211 + 1, (i * 104729) % 97) for i in range(n)], policy)


def cut(text, limit):
    """The plain version: whole characters whose bytes fit in half the limit, then to the line feeds."""
    data = text.encode()
    if len(data) <= limit:
        return text
    half = limit // 2
    head = data[:half].decode(errors="ignore")
    head = head[: head.rfind("\n")] if "\n" in head else head
    begin = len(data) - half
    while data[begin] & 0xC0 == 0x80:
        begin += 1
    tail = data[begin:].decode()
    tail = tail[tail.find("\n") + 1 :]
    elided = len(data) - len(head.encode()) - len(tail.encode())
    return f"{head}\n... [truncated {elided} bytes — file too large] ...\n{tail}"


@pytest.mark.parametrize("limit", [20, 21, 22, 23, 100])
def test_truncation_counts_bytes_and_keeps_characters_whole(spark, limit):
    rng = random.Random(limit)
    texts = ["é" * 80, "a" * 9 + "漢字" * 40, "😀" * 40, "short", "", "x\n" * 10_000] + ["".join(rng.choices("aé漢😀\n ", k=rng.randint(0, 120))) for _ in range(80)]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = d.select("t", tx.truncate_middle(F.col("t"), limit).alias("c")).collect()
    assert all(r["c"] == cut(r["t"], limit) for r in got)
    assert all(" -" not in r["c"] for r in got)


def test_white_space_of_all_kinds(spark):
    d = spark.createDataFrame([("a.rs\r\n\t b.rs \u00a0\n\n\u2003",)], "value string")
    assert {r["path"] for r in im.changed_files(d).collect()} == {"a.rs", "b.rs"}
    f = files(spark, {"a.rs": "\tpub fn f() {\r\n\u3000export class K {}"})
    got = {(r["name"], r["exported"], r["signature"]) for r in cg.extract_symbols(f).collect()}
    assert got == {("f", True, "pub fn f() {"), ("K", True, "export class K {}")}


def test_calls_are_found_as_by_the_plain_pattern(spark):
    import re

    rng = random.Random(5)
    texts = ["".join(rng.choices(["foo", "b_1", "9x", "(", " ", ")", "é", ".", "if", "\n"], k=40)) for _ in range(60)]
    f = files(spark, {f"f{i}.ts": t for i, t in enumerate(texts)})
    want = {(f"f{i}.ts", n) for i, t in enumerate(texts) for n in re.findall(r"([A-Za-z_]\w*)\s*\(", t, re.ASCII) if n not in cg.NOT_CALLS}
    assert {(r["path"], r["name"]) for r in cg.calls_by_line(f).collect()} <= want
    symbols = spark.createDataFrame([("r", p, 1, "fn", n) for p, n in want], "repo string, path string, line int, kind string, name string")
    assert {(r["path"], r["to"][3:]) for r in cg.call_edges(f, symbols).collect()} == want


def test_scope_listing(spark):
    f = files(spark, {"a.ts": "main()\nexport function f(a) {\n  g(a);\n  f(a);\n}\nfunction g() {}", "b.ts": "function h() { f(); g() }", "c.ts": "f()"})
    s = cg.extract_symbols(f)
    by = cg.callers(cg.attribute_calls(cg.calls_by_line(f), s), s)
    changed = spark.createDataFrame([("r", "a.ts"), ("r", "b.ts"), ("r", "no.ts")], "repo string, path string")
    row = cg.scope_rows(s, by, changed).first()
    assert row["elided"] == 0 and row["block"] == (
        "\na.ts:\n  - fn f (L2) [pub] `export function f(a) {`\n    called by: b.ts::h, c.ts\n"
        "  - fn g (L6) `function g() {}`\n    called by: a.ts::f, b.ts::h\n"
        "\nb.ts:\n  - fn h (L1) `function h() { f(); g() }`\n"
    )
    small = cg.scope_rows(s, by, changed, 80).first()
    assert small["elided"] == 2 and "fn g" in small["block"] and "fn f" not in small["block"] and small["block"].endswith("[+2 more entries elided to stay under 80 bytes]\n")
    assert cg.scope_rows(s, by, changed.limit(0)).count() == 0


def test_scope_listing_of_two_reviews_and_wide_signatures(spark):
    f = files(spark, {"a.ts": "function f(a) { return '" + "漢" * 200 + "' }", "b.ts": "function g() {}"})
    s = cg.extract_symbols(f)
    by = cg.callers(cg.attribute_calls(cg.calls_by_line(f), s), s)
    changed = spark.createDataFrame([("r", 1, "a.ts"), ("r", 2, "b.ts"), ("r", 2, "no.ts")], "repo string, pr bigint, path string")
    rows = {r["pr"]: r["block"] for r in cg.scope_rows(s, by, changed).collect()}
    assert rows[2] == "\nb.ts:\n  - fn g (L1) `function g() {}`\n" and list(sorted(rows)) == [1, 2]
    signature = rows[1].split("`")[1]
    assert signature.endswith("漢…") and 237 <= len(signature.encode()) <= 240


def test_language_hints(spark):
    d = spark.createDataFrame([(p,) for p in ("a.tsx", "b.kts", "c.py", "d.md", "e.RS", "f", "g.zsh", "h.hh", "i.php")], "p string")
    assert [r[0] for r in d.select(tx.lang_hint(F.col("p"))).collect()] == ["ts", "kotlin", "py", "md", "", "", "bash", "cpp", "php"]


def test_related_files_by_path(spark):
    snapshot = spark.createDataFrame([("r", f"f{i}", "x" * (i * 10)) for i in range(6)], "repo string, path string, content string")
    diff = spark.createDataFrame([("r", 1, "f5"), ("r", 2, "zz")], "repo string, pr bigint, path string")
    related = df.related_files(snapshot, diff)
    assert {(r["pr"], r["path"]) for r in related.collect()} == {(1, f"f{i}") for i in range(5)} | {(2, f"f{i}") for i in range(6)}
    packed = df.pack_related(related, snapshot, ChunkPolicy(related_bytes=1000, chunk_related_bytes=75)).collect()
    assert {(r["pr"], r["path"], len(r["content"])) for r in packed} == {(p, f"f{i}", i * 10) for p in (1, 2) for i in range(4)}


def test_closure_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "src bigint, dst bigint")
    assert im.reachable(edges, spark.createDataFrame([(0,), (15,)], "entry bigint")).count() == 21 + 6


def reach(edges, node):
    seen, todo = {node}, [node]
    while todo:
        for b in edges.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


@pytest.mark.parametrize("seed", range(2))
def test_reviews_of_random_graphs(spark, seed):
    """Chains, circles and bushes of two repositories, the second one with reviews of its own; 70 reviews need two words."""
    rng = random.Random(seed)
    rows, changed = set(), set()
    for repo, n, links, reviews in (("r", 60, 50 + 20 * seed, 70), ("q", 40, 39, 2)):
        rows |= {(repo, f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(links)}
        rows |= {(repo, f"c{i}", f"c{(i + 1) % 30}") for i in range(29 + seed % 2)} | {(repo, "n1", "c5"), (repo, "c20", "n2")}
        changed |= {(repo, pr, rng.choice(["n", "c"]) + str(rng.randrange(n))) for pr in range(reviews) for _ in range(2)}
    entries = {(repo, f"{x}{i}") for repo in "rq" for x in "nc" for i in range(0, 30, 3)}
    e = spark.createDataFrame(sorted(rows), "repo string, src string, dst string")
    t = spark.createDataFrame(sorted(entries), "repo string, entry string")
    graph = {}
    for repo, a, b in rows:
        graph.setdefault((repo, a), []).append((repo, b))
    got = {tuple(r) for r in im.affected_entries(e, t, spark.createDataFrame(sorted(changed), "repo string, pr bigint, node string")).select("repo", "pr", "entry").collect()}
    ways = {x: reach(graph, x) for x in entries}
    assert got == {(repo, pr, x) for repo, pr, node in changed for r, x in entries if r == repo and (repo, node) in ways[(r, x)]}
    got = [tuple(r) for r in im.reachable(e, t).select("repo", "entry", "node").collect()]
    assert len(got) == len(set(got)) and set(got) == {(r, x, node) for (r, x), all_ in ways.items() for _, node in all_}


def test_a_thousand_reviews_over_a_chain_of_ten_thousand(spark):
    n = 10_000
    edges = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    changed = spark.range(1000).select(F.col("id").alias("pr"), (F.col("id") * 10).alias("node"))
    hit = im.affected_entries(edges, spark.createDataFrame([(0,), (5000,), (9990,), (10_000,)], "entry bigint"), changed)
    assert {r["entry"]: r["n"] for r in hit.groupBy("entry").agg(F.count("*").alias("n")).collect()} == {0: 1000, 5000: 500, 9990: 1}


def test_components_of_chains_and_stars(spark):
    from deltasieve.operators import graphs

    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(20, 60)] + [(3, 3), (1, 2), (2, 1)]
    got = {r["node"]: r["root"] for r in graphs.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(20, 60)]} | {1: 1, 2: 1}
    assert graphs.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_scope_of_two_reviews(spark):
    found = spark.createDataFrame([("r", "a"), ("r", "b"), ("q", "a")], "repo string, path string")
    ran = spark.createDataFrame([("r", 1, "a")], "repo string, pr bigint, path string")
    changed = spark.createDataFrame([("r", 1, "x"), ("r", 2, "y")], "repo string, pr bigint, path string")
    got = {(r["role"], r["pr"], r["path"]) for r in im.scope_files(found, ran, changed).collect()}
    assert got == {("changed", 1, "x"), ("changed", 2, "y"), ("ran", 1, "a"), ("skipped", 1, "b"), ("skipped", 2, "a"), ("skipped", 2, "b")}


def test_truncate_and_fit(spark):
    d = spark.createDataFrame([("a\n" * 50,), ("short",)], "t string")
    cut = [r[0] for r in d.select(tx.truncate_middle(F.col("t"), 20)).collect()]
    assert cut[1] == "short" and "truncated" in cut[0] and cut[0].startswith("a\na\n")
    assert spark.range(1).select(cg.fit_in_order(F.array(*[F.lit(x).cast("bigint") for x in (5, 9, 3)]), 8)).first()[0] == [True, False, True]


@pytest.mark.parametrize("small", [0, 40, 1000])
def test_parts_within_tasks_and_by_rounds(spark, small, monkeypatch):
    """Parts gone over within a task and by rounds give the same, alone and mixed; numbers of 150 entries take several words."""
    from deltasieve.operators import graphs

    monkeypatch.setattr(graphs, "SMALL", small)
    rng = random.Random(5)
    rows = {(repo, 100 * block + rng.randrange(8), 100 * block + rng.randrange(8)) for repo in ("r", None) for block in range(8) for _ in range(12)}
    rows |= {("r", 5000 + i, 5001 + i) for i in range(150)} | {("r", 5150, 5000)}
    entries = {(repo, 100 * block + i) for repo in ("r", None) for block in range(10) for i in range(4)} | {("r", 5000 + i) for i in range(150)}
    graph = {}
    for repo, a, b in rows:
        graph.setdefault((repo, a), []).append((repo, b))
    wanted = {(r, x, node) for r, x in entries for _, node in reach(graph, (r, x))}
    key = lambda t: (t[0] or "", *t[1:])
    e = spark.createDataFrame(sorted(rows, key=key), "repo string, src bigint, dst bigint")
    t = spark.createDataFrame(sorted(entries, key=key), "repo string, entry bigint")
    got = [tuple(r) for r in im.reachable(e, t).select("repo", "entry", "node").collect()]
    assert len(got) == len(set(got)) and set(got) == wanted


def test_small_parts_need_no_rounds(spark, monkeypatch):
    """A thousand blocks of sixteen are settled within tasks, and no task numbers all entries."""
    from deltasieve.operators import graphs

    monkeypatch.setattr(graphs, "_by_rounds", None)
    edges = spark.range(16_000).selectExpr("id AS src", "id div 16 * 16 + (7 * id + 3) % 16 AS dst").unionByName(spark.range(16_000).selectExpr("id AS src", "id div 16 * 16 + id % 16 div 2 AS dst"))
    found = im.reachable(edges, spark.range(16_000).withColumnRenamed("id", "entry"))
    block = {i: [(7 * i + 3) % 16, i // 2] for i in range(16)}
    assert found.count() == 1000 * sum(len(reach(block, i)) for i in range(16))
    plan = graphs.numbered(spark.range(100).withColumnRenamed("id", "entry"), [], ["entry"])._jdf.queryExecution().toString()
    assert "Window" not in plan
