"""Review findings: intake of free-text responses, near-duplicate merging, verdicts, ranking and roll-ups."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..options import EvaluationOptions, MergeOptions
from ..sources.shared import settled
from .graphs import components

SEVERITY_RANK = {"nit": 0, "minor": 1, "major": 2, "critical": 3}
# Spellings of severities, categories and verdicts.
SEVERITY_WORDS = {"critical": "critical", "blocker": "critical", "severe": "critical", "major": "major", "high": "major", "warning": "major", "minor": "minor", "low": "minor", "medium": "minor", "nit": "nit", "info": "nit", "trivial": "nit", "style": "nit"}
CATEGORY_WORDS = {"correctness": "correctness", "logic": "correctness", "bug": "correctness", "security": "security", "sec": "security", "performance": "performance", "perf": "performance", "speed": "performance", "maintainability": "maintainability", "style": "maintainability", "quality": "maintainability", "readability": "maintainability"}
VERDICT_WORDS = {"drop": "drop", "reject": "drop", "discard": "drop", "downgrade": "downgrade", "lower": "downgrade", "soften": "downgrade"}
UNJUDGED = 0.6


def _word(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.lower(strip(key)))


def norm_severity(c: Column) -> Column:
    return F.coalesce(_word(SEVERITY_WORDS, c), F.lit("minor"))


def norm_category(c: Column, default: Column) -> Column:
    return F.coalesce(_word(CATEGORY_WORDS, c), default)


def sev_rank(c: Column) -> Column:
    return _word(SEVERITY_RANK, c)


def json_body(raw: Column) -> Column:
    """Text from its first brace on, without a code fence around it; null if there is no brace."""
    bare = F.regexp_replace(strip(raw), r"^```(json)?\s*", "")
    bare = F.when(F.right(bare, F.lit(3)) == "```", strip(F.left(bare, F.greatest(F.lit(0), F.char_length(bare) - 3)))).otherwise(bare)
    at = F.instr(bare, "{")
    return F.when(at > 0, F.substring(bare, at, F.lit(1 << 30)))


def _kinds(value: Column, path: str) -> Column:
    """Type of a part of a variant, as text; null if it is absent or a JSON null."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def parse_findings(responses: DataFrame) -> DataFrame:
    """repo, pr, chunk_idx, persona, at and the fields of findings of reviewers' raw responses.

    A response with a field of another type than it should have is rejected whole; findings without a title are
    dropped. The persona stands for a missing or unknown category. Text before and after the JSON object is ignored.
    """
    # Generated, not projected, so that a response is parsed once, whatever is asked of it.
    keys = ["repo", "pr", "chunk_idx", "persona"]
    doc = responses.select(*keys, F.explode(F.array(F.try_parse_json(json_body(F.col("raw"))))).alias("doc")).where("doc IS NOT NULL")
    listed = F.try_variant_get("doc", "$.findings", "array<variant>")
    given = F.try_variant_get("doc", "$.findings", "variant")
    # Elements one by one: each field must be text (line: a whole number from 0) or null or absent.
    rows = doc.where(given.isNull() | listed.isNotNull()).withColumn("items", F.coalesce(listed, F.array().cast("array<variant>")))

    def text(x: Column, field: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(x, f"$.{field}", "variant"))
        return kind.isNull() | kind.isin("STRING", "VOID")

    def sound(x: Column) -> Column:
        line = F.try_variant_get(x, "$.line", "variant")
        kind = F.schema_of_variant(line)
        whole = kind.isNull() | (kind == "VOID") | ((kind == "BIGINT") & (F.try_variant_get(x, "$.line", "bigint") >= 0))
        ok = F.schema_of_variant(x).startswith("OBJECT") & whole
        for f in ("file", "severity", "category", "title", "rationale", "suggestion"):
            ok = ok & text(x, f)
        return F.coalesce(ok, F.lit(False))

    rows = rows.where(F.forall("items", sound)).select("repo", "pr", "chunk_idx", "persona", F.posexplode("items").alias("at", "x"))
    get = lambda f, t="string": F.try_variant_get("x", f"$.{f}", t)
    out = rows.select("repo", "pr", "chunk_idx", "persona", "at", F.coalesce(get("file"), F.lit("")).alias("file"), get("line", "bigint").alias("line"), F.coalesce(_word(SEVERITY_WORDS, get("severity")), F.lit("minor")).alias("severity"), norm_category(get("category"), F.col("persona")).alias("category"), strip(get("title")).alias("title"), strip(F.coalesce(get("rationale"), F.lit(""))).alias("rationale"), get("suggestion").alias("suggestion"), F.col("persona").alias("raised_by"))
    out = out.where("title IS NOT NULL AND title <> ''")
    return out.withColumns({"suggestion": F.when(strip(F.col("suggestion")) != "", F.col("suggestion")), "sev_rank": sev_rank(F.col("severity"))})


def parse_verdicts(responses: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates (repo, pr, index, ..) with verdict, confidence and judge_note of the judge's raw responses.

    Of several verdicts on an index the last counts; what the judge left out is kept at a fixed confidence.
    """
    shape = "struct<verdicts:array<struct<index:bigint,verdict:string,confidence:double,note:string>>,bad:string>"
    parsed = responses.select("repo", "pr", F.from_json(json_body(F.col("raw")), shape, {"columnNameOfCorruptRecord": "bad"}).alias("j")).where("j.bad IS NULL")
    rows = parsed.select("repo", "pr", F.posexplode("j.verdicts").alias("at", "v"))
    last = rows.where("v.index >= 0").groupBy("repo", "pr", F.col("v.index").alias("index")).agg(F.max_by("v", "at").alias("v"))
    joined = candidates.join(last, ["repo", "pr", "index"], "left")
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("v.confidence", F.lit(UNJUDGED))))
    return joined.withColumns({"verdict": F.coalesce(_word(VERDICT_WORDS, F.col("v.verdict")), F.lit("keep")), "confidence": confidence, "judge_note": F.col("v.note")}).drop("v")


def title_tokens(c: Column) -> Column:
    """The distinct words of a title, in its own case; none of a null one."""
    return F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: t != ""))


def word_keys(c: Column) -> Column:
    """title_tokens as 64-bit hashes, which take a third of the room when titles are dealt out."""
    return F.array_distinct(F.transform(title_tokens(c), lambda w: F.xxhash64(w)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token arrays; one for two empty ones."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def _meeting(rows: DataFrame, keys: list[str], least: float) -> DataFrame:
    """rows with block: under which those of a key that can be alike meet, few others do, and all with no words.

    Two arrays of m and n words that are alike have s = least / (1 + least) * (m + n) words in common, so that each one's first
    m - s + 1 (or n - s + 1) words hold one of these, whatever the order of words. Words that few of the key's rows
    have come first. A block is a hash of such a word and of the sizes m and n that a row meets another for.
    """
    named = rows.select(*keys, "node", F.posexplode("tokens").alias("_at", "word"))
    rare = named.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("_rows"))
    ranked = named.join(rare, [*keys, "word"]).groupBy(*keys, "node").agg(F.sort_array(F.collect_list(F.struct("_rows", "word"))).alias("_words"))
    n = F.size("tokens")
    sizes = F.when(n == 0, F.array(F.lit(0))).otherwise(F.sequence(F.ceil(n * least - 1e-9).cast("int"), F.floor(n / least + 1e-9).cast("int")))
    each = rows.join(ranked, [*keys, "node"], "left").withColumn("_other", F.explode(sizes))
    first = n - F.ceil(least / (1 + least) * (n + F.col("_other")) - 1e-9) + 1
    words = F.when(n == 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.transform(F.slice("_words", F.lit(1), F.greatest(F.lit(0), first).cast("int")), lambda w: w["word"]))
    blocks = F.transform(words, lambda w: F.xxhash64(F.least(n, F.col("_other")), F.greatest(n, F.col("_other")), w))
    return each.select(*rows.columns, F.explode(blocks).alias("block"))


FILE = ["repo", "pr", "file"]


def _close(rows: DataFrame, opts: MergeOptions) -> DataFrame:
    """a, b (nodes, a < b) and the keys of rows (keys, node, line, tokens) of a file whose lines are near and titles alike.

    Lines meet by equality on bands as wide as the window: a row is looked up in its own band and the next lower one.
    """
    band = opts.window + 1
    known = rows.where("line IS NOT NULL").withColumn("band", F.expr(f"line div {band}"))
    x = known.select(*FILE, "band", *[F.col(c).alias(f"{c}_x") for c in ("node", "line", "tokens")])
    y = known.select(*FILE, F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), *[F.col(c).alias(f"{c}_y") for c in ("node", "line", "tokens")])
    near = x.join(y, [*FILE, "band"]).where(f"(line_x - line_y BETWEEN 0 AND {opts.window}) AND (line_x > line_y OR node_x > node_y)")
    return near.where(jaccard(F.col("tokens_x"), F.col("tokens_y")) >= opts.similarity).select(*FILE, F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))


BLOCK = [*FILE, "block"]


def _met_without_line(rows: DataFrame, opts: MergeOptions) -> DataFrame:
    """The rows of files that have any without a line, under the words by which titles meet."""
    files = rows.where("line IS NULL").select(*FILE).distinct()
    return _meeting(rows.join(files, FILE, "left_semi").select(*FILE, "node", "line", "tokens"), FILE, opts.similarity)


def _alike(x: DataFrame, y: DataFrame, opts: MergeOptions) -> DataFrame:
    """a, b of the rows of x and those of y that meet and whose titles are alike, once for each word by which they meet."""
    left = x.select(*BLOCK, F.col("node").alias("a"), F.col("tokens").alias("tokens_a"))
    right = y.select(*BLOCK, F.col("node").alias("b"), F.col("tokens").alias("tokens_b"))
    return left.join(right, BLOCK).where((F.col("a") != F.col("b")) & (jaccard(F.col("tokens_a"), F.col("tokens_b")) >= opts.similarity)).select(*FILE, "a", "b")


def _loose(rows: DataFrame, opts: MergeOptions) -> DataFrame:
    """a, b (nodes, a < b) and the keys of rows of a file of which one has no line, and whose titles are alike."""
    met = _met_without_line(rows, opts)
    late = met.where("line IS NULL")
    with_line = _alike(met.where("line IS NOT NULL"), late, opts)
    both = with_line.unionByName(_alike(late, late, opts).where("a < b"))
    return both.select(*FILE, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _late_gone(met: DataFrame, opts: MergeOptions, rounds: int = 2) -> DataFrame:
    """node: the rows without a line that an earlier surviving row takes in; met has them and the surviving rows with a line.

    First go those alike to a row with a line. Of the others, one that comes first under all its words survives: those alike to
    it go, so that many alike titles aren't paired with one another. What is left after some rounds of that is paired.
    """
    left = met.where("line IS NULL")
    found: list[DataFrame] = []
    sure = met.where("line IS NOT NULL")
    for turn in range(rounds + 1):
        gone = settled(_alike(sure, left, opts).select(F.col("b").alias("node")).distinct(), "gone")
        found.append(gone)
        if turn:
            left = left.join(sure.select("node").distinct(), "node", "left_anti")
        left = settled(left.join(gone, "node", "left_anti"), "left")
        if turn == rounds or left.isEmpty():
            break
        first = left.groupBy(*BLOCK).agg(F.min("node").alias("_first"))
        others = left.join(first, BLOCK).where("node > _first").select("node").distinct()
        sure = settled(left.join(others, "node", "left_anti"), "sure")
    pairs = _alike(left, left, opts).where("a < b").select("a", "b").distinct()
    return reduce(DataFrame.unionByName, [*found, _not_surviving(settled(pairs, "pairs"))])


def near_duplicate_pairs(findings: DataFrame, opts: MergeOptions = MergeOptions()) -> DataFrame:
    """repo, pr, file, a, b (seq, a < b) of findings of a file whose lines are near, or one unknown, and titles alike.

    Titles are alike by their words; a null one has none, and two without words are alike. Where both lines are known, near
    ones meet first, else alike titles (see _meeting), so that a file's findings aren't all paired.
    """
    rows = findings.select(*FILE, F.col("seq").alias("node"), "line", word_keys(F.col("title")).alias("tokens"))
    return _close(rows, opts).unionByName(_loose(rows, opts)).distinct()


def _walk(batches: Iterator) -> Iterator:
    """b of pairs (root, b, a), sorted, whose row isn't a survivor: an earlier one alike is.

    Pairs pass as a stream; what is held is the survivors of one component.
    """
    import pyarrow as pa

    root, gone, node, hit = None, set(), None, False
    for batch in batches:
        out = []
        for r, b, a in zip(*(batch.column(c).to_pylist() for c in ("root", "b", "a")), strict=True):
            if r != root:
                root, gone = r, set()
            if b != node:
                node, hit = b, False
            if not hit and a not in gone:
                hit = True
                gone.add(b)
                out.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["node"])


def _not_surviving(pairs: DataFrame, rounds: int = 3) -> DataFrame:
    """node: the later rows of pairs (a, b; a < b) that an earlier row, one that survives itself, takes in.

    A row with no earlier one alike survives, and those alike to it don't; without these, others have no earlier one. After some
    rounds of that, what is left, chains that can only be walked in order, is walked component by component.
    """
    found: list[DataFrame] = []
    left = pairs.select("a", "b")
    for _ in range(rounds):
        first = left.select("a").distinct().join(left.select(F.col("b").alias("a")), "a", "left_anti")
        gone = settled(left.join(first, "a", "left_semi").select(F.col("b").alias("node")).distinct(), "gone")
        found.append(gone)
        rest = left.join(gone, F.col("a") == F.col("node"), "left_anti").join(gone, F.col("b") == F.col("node"), "left_anti")
        left = settled(rest, "left")
        if left.isEmpty():
            break
    else:
        rooted = left.join(components(left), F.col("a") == F.col("node")).select("root", "b", "a")
        walked = rooted.repartition("root").sortWithinPartitions("root", "b", "a").mapInArrow(_walk, "node bigint")
        found.append(walked)
    return reduce(DataFrame.unionByName, found)


def _names(parts: Column) -> Column:
    """Names joined in order (structs with name), each one left out that is among the parts joined so far."""
    step = lambda acc, p: F.when(acc.isNull(), p["name"]).when(F.array_contains(F.split(acc, r"\+"), p["name"]), acc).otherwise(F.concat_ws("+", acc, p["name"]))
    return F.aggregate(parts, F.lit(None).cast("string"), step)


def merge_findings(findings: DataFrame, opts: MergeOptions = MergeOptions()) -> DataFrame:
    """findings after the merge of near-duplicates, with merged, the number of rows that each stands for.

    In order of line (none: last), title and seq, a file's row goes to the nearest row before it that survives and is alike
    (see near_duplicate_pairs), or survives itself. The survivor keeps its line, title and category, takes the highest severity,
    the longest rationale, the first suggestion, and names who raised any. A null title has no words and sorts as an empty one.

    Rows of a file with one line and title are one node; nodes are numbered in that order by one sort of the whole table, and who
    survives follows from numbers of alike nodes alone, so that no file is folded in one task. Texts are joined at last.
    """
    cols = ["repo", "pr", "seq", "file", "line", "severity", "sev_rank", "category", "title", "rationale", "suggestion", "raised_by"]
    # A title is known by its words and its hash here, and by itself in the sort.
    rows = settled(findings.select(*cols).withColumns({"_row": F.monotonically_increasing_id(), "_title": F.coalesce("title", F.lit("")), "_size": F.octet_length(F.coalesce("rationale", F.lit("")))}), "findings")
    kinds = rows.groupBy(*FILE, "line", "_title").agg(F.min("seq").alias("_first"))
    nodes = kinds.orderBy(*FILE, F.col("line").asc_nulls_last(), "_title").withColumn("node", F.monotonically_increasing_id())
    nodes = settled(nodes.withColumn("tokens", word_keys(F.col("_title"))), "titles")
    pairs = settled(_close(nodes, opts).select("a", "b"), "pairs")
    gone = settled(_not_surviving(pairs), "gone")
    hosts = pairs.join(gone, F.col("b") == F.col("node"), "left_semi").join(gone, F.col("a") == F.col("node"), "left_anti")
    # Rows without a line come after all others of their file, so that those with one are decided by then.
    met = settled(_met_without_line(nodes, opts).join(gone, "node", "left_anti"), "met")
    late = settled(_late_gone(met, opts), "late")
    taken = met.join(late, "node", "left_semi")
    hosts = hosts.unionByName(_alike(met.join(late, "node", "left_anti"), taken, opts).where("a < b").select("a", "b"))
    hosts = hosts.groupBy(F.col("b").alias("node")).agg(F.max("a").alias("host"))
    named = nodes.join(hosts, "node", "left").select(*[F.col(c).alias(f"_{c}") for c in FILE], F.col("line").alias("_line"), F.col("_title").alias("_text"), "node", F.coalesce("host", "node").alias("host"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*FILE, "line")]) & (F.col("_title") == F.col("_text"))
    order = F.struct("node", "seq", "_row")
    members = rows.select(*FILE, "line", "_title", "seq", "_row", "_size", "severity", "sev_rank", "raised_by", F.col("suggestion").isNotNull().alias("_told")).join(named, same)
    later = F.struct(-F.col("node"), -F.col("seq"), -F.col("_row"))
    picked = members.groupBy("host").agg(
        F.min(order).alias("_head"),
        F.max_by("severity", F.struct(F.col("sev_rank").alias("rank"), later.alias("later"))).alias("severity"),
        F.max("sev_rank").alias("sev_rank"),
        F.max_by("_row", F.struct(F.col("_size").alias("size"), later.alias("later"))).alias("_rationale"),
        F.min_by("_row", F.when(F.col("_told"), order)).alias("_suggestion"),
        F.count(F.lit(1)).alias("merged"),
    )
    # Of a name without a plus only the first place counts; who raised a row is then joined in order.
    once = members.where("raised_by IS NOT NULL").groupBy("host", "raised_by", F.when(F.col("raised_by").contains("+"), F.col("_row")).alias("_own")).agg(F.min(order).alias("_at"))
    names = once.groupBy("host").agg(_names(F.sort_array(F.collect_list(F.struct("_at", F.col("raised_by").alias("name"))))).alias("raised_by"))
    chosen = picked.join(names, "host", "left").withColumn("_row", F.col("_head._row"))
    text = lambda c: rows.select(F.col("_row").alias(f"_{c}"), c)
    own = rows.select("_row", "repo", "pr", "seq", "file", "line", "category", "title")
    return chosen.join(own, "_row").join(text("rationale"), "_rationale", "left").join(text("suggestion"), "_suggestion", "left").select(*cols, "merged")


def rank_findings(findings: DataFrame) -> DataFrame:
    """findings with rank in their review: severity first, then file, line (none is 0) and title."""
    order = Window.partitionBy("repo", "pr").orderBy(F.col("sev_rank").desc(), "file", F.coalesce("line", F.lit(0)), "title", "seq")
    return findings.withColumn("rank", F.row_number().over(order))


def apply_verdicts(judged: DataFrame) -> DataFrame:
    """A downgraded finding loses one step of severity."""
    lower = F.when(F.col("verdict") == "downgrade", F.greatest(F.lit(0), F.col("sev_rank") - 1)).otherwise(F.col("sev_rank"))
    names = F.array(*map(F.lit, SEVERITY_RANK))
    return judged.withColumn("sev_rank", lower).withColumn("severity", F.element_at(names, (F.col("sev_rank") + 1).cast("int")))


def shippable(judged: DataFrame, floor: float = EvaluationOptions().floor) -> DataFrame:
    """Findings not dropped and confident enough, with place (from 0): severity, category, title."""
    order = Window.partitionBy("repo", "pr").orderBy(F.col("sev_rank").desc(), "category", "title", "seq")
    return judged.where((F.col("verdict") != "drop") & (F.col("confidence") >= floor)).withColumn("place", F.row_number().over(order) - 1)


def has_critical(shipped: DataFrame) -> DataFrame:
    return shipped.groupBy("repo", "pr").agg(F.max(F.col("sev_rank") == 3).alias("critical"))


def review_summary(judged: DataFrame, raw: DataFrame, responses: DataFrame, files: DataFrame, floor: float = EvaluationOptions().floor) -> DataFrame:
    """One row for each review: files in all and reviewed, tokens of the reviewers, findings raw and merged, verdicts.

    files: repo, pr, path, kept. Tokens of the judge don't count.
    """
    keys = ["repo", "pr"]
    a = judged.groupBy(*keys).agg(F.count(F.lit(1)).alias("merged"), *[F.count_if(F.col("verdict") == v).alias(n) for v, n in (("drop", "dropped"), ("downgrade", "downgraded"))], F.count_if((F.col("verdict") != "drop") & (F.col("confidence") < floor)).alias("hidden"))
    b = raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("raw"))
    c = responses.groupBy(*keys).agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("duration_ms").alias("duration_ms"))
    d = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("files_total"), F.count_if("kept").alias("files_reviewed"))
    out = d.join(c, keys, "left").join(b, keys, "left").join(a, keys, "left")
    return out.na.fill(0)


def reviewer_telemetry(responses: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows for each reviewer of a review, the failed reviewers of each review); a failed one stays, with no findings."""
    counts = findings.groupBy("repo", "pr", F.col("raised_by").alias("persona")).agg(F.count(F.lit(1)).alias("findings"))
    per = responses.groupBy("repo", "pr", "persona").agg(F.sum("duration_ms").alias("duration_ms"), F.sum("prompt_tokens").alias("prompt_tokens"), F.max("error").alias("error"))
    rows = per.join(counts, ["repo", "pr", "persona"], "left").na.fill(0, ["findings"])
    return rows, rows.where("error IS NOT NULL").groupBy("repo", "pr").agg(F.sort_array(F.collect_set("persona")).alias("failed"))


def category_counts(shipped: DataFrame) -> DataFrame:
    """repo, pr, category and the number of findings of each severity."""
    return shipped.groupBy("repo", "pr", "category").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_RANK])


def apply_curation(judged: DataFrame, decisions: DataFrame, floor: float = EvaluationOptions().floor) -> DataFrame:
    """Verdicts after a person's decisions: repo, pr, index (from 1, in the order of shippable()), action, in order of at.

    Only what would be shipped is shown and numbered. Actions are keep or drop of one index, and keep-rest or drop-rest,
    which hold for all places from theirs on that have no decision of their own. A dropped finding's verdict is drop; one
    that is kept keeps its verdict, and so does all that wasn't shown.
    """
    ships = (F.col("verdict") != "drop") & (F.col("confidence") >= floor)
    marked = judged.withColumn("_shown", F.coalesce(ships, F.lit(False)))
    order = Window.partitionBy("repo", "pr", "_shown").orderBy(F.col("sev_rank").desc(), "category", "title", "seq")
    rows = marked.withColumn("_index", F.row_number().over(order).cast("bigint"))
    single = F.when(F.col("action").isin("keep", "drop"), F.col("action"))
    rest = F.when(F.col("action").endswith("-rest"), F.substring_index("action", "-", 1))
    of = decisions.groupBy("repo", "pr", F.col("index").cast("bigint").alias("_index")).agg(F.max_by(single, F.when(single.isNotNull(), F.col("at"))).alias("_one"), F.max_by(rest, F.when(rest.isNotNull(), F.col("at"))).alias("_rest"))
    both = rows.join(of.withColumn("_shown", F.lit(True)), ["repo", "pr", "_shown", "_index"], "left")
    on = Window.partitionBy("repo", "pr", "_shown").orderBy("_index").rowsBetween(Window.unboundedPreceding, 0)
    decided = F.coalesce("_one", F.last("_rest", ignorenulls=True).over(on))
    return both.withColumn("verdict", F.when(F.col("_shown") & (decided == "drop"), "drop").otherwise(F.col("verdict"))).select(judged.columns)
