"""The feedback corpus: harvested from comments and reactions, merged, scored with decay, bounded, and selected from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sanitise, strip
from ..options import GuidanceOptions, ScoreOptions

# Kinds of signals with their authority in scores and their rank in merges.
AUTHORITY = {"user-directive": 5.0, "confirmed": 2.0, "inferred-applied": 1.0, "refuted": 0.0, "inferred-ignored": 0.5}
RANK = {"user-directive": 100, "confirmed": 50, "inferred-applied": 25, "inferred-ignored": 10, "refuted": 5}
POLARITY = {"user-directive": 1, "confirmed": 1, "inferred-applied": 1, "refuted": -1, "inferred-ignored": -1}
TRUSTED = ("OWNER", "MEMBER", "COLLABORATOR")
GUIDANCE_LIMIT = 2000


def _of(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def authority(kind: Column) -> Column:
    return _of(AUTHORITY, kind)


def polarity(kind: Column) -> Column:
    return _of(POLARITY, kind)


def split_comments(comments: DataFrame, marker: str) -> tuple[DataFrame, DataFrame]:
    """(the first comment of each review that has the marker, all comments that don't)."""
    marked = comments.where(F.col("body").contains(marker))
    first = F.row_number().over(Window.partitionBy("repo", "pr").orderBy("id"))
    return marked.withColumn("_nth", first).where("_nth = 1").drop("_nth"), comments.where(~F.col("body").contains(marker))


def trusted(comments: DataFrame, associations: Sequence[str] = TRUSTED, bot: str = "") -> DataFrame:
    """Comments whose author may give directives: of a trusted association and not the bot."""
    known = F.upper("author_association").isin(*[a.upper() for a in associations]) if associations else F.lit(False)
    return comments.where(known & ((F.lit(bot) == "") | (F.lower("user_login") != bot.lower())))


def parse_directives(comments: DataFrame, sigil: str) -> DataFrame:
    """comments' columns with at (line), kind (remember, good, bad), text and index of each directive, in any case.

    A line opens with the sigil and a colon, or with @, the sigil and a blank or colon.
    """
    lines = comments.select("*", F.posexplode(F.split("body", "\n")).alias("at", "_line"))
    rest = strip(F.regexp_extract("_line", rf"(?is)^\s*(?:{sigil}:|@{sigil}[ :])(.*)$", 1))
    lines = lines.withColumn("_rest", rest)
    text = strip(F.regexp_extract("_rest", r"(?is)^remember (.*)$", 1))
    # A number after the words, with or without a hash.
    index = lambda words: F.regexp_extract("_rest", rf"(?i)^{words} on\s*#?\s*(\d+)", 1)
    good, bad = index("good catch"), index("false[- ]positive")
    kind = F.when(text != "", "remember").when(good != "", "good").when(bad != "", "bad")
    out = lines.withColumns({"kind": kind, "text": F.when(text != "", text), "index": F.when(good != "", good).when(bad != "", bad).cast("bigint")})
    return out.where("kind IS NOT NULL").drop("_line", "_rest")


def file_to_glob(path: Column) -> Column:
    """The path's top folder and all below it; a file without a folder is its own glob."""
    bare = F.regexp_replace(path, r"^(\./)+", "")
    return F.when(path == "", None).when(F.instr(bare, "/") == 0, bare).otherwise(F.concat(F.substring_index(bare, "/", 1), F.lit("/**")))


def clamp_guidance(text: Column) -> Column:
    return F.when(F.char_length(text) > GUIDANCE_LIMIT, F.concat(F.left(text, F.lit(GUIDANCE_LIMIT - 1)), F.lit("…"))).otherwise(text)


def entry_id(glob: Column, category: Column, guidance: Column) -> Column:
    """The same id for the same scope and wording, whatever the spacing and case."""
    words = strip(F.regexp_replace(F.lower(guidance), r"(?U)\s+", " "))
    return F.concat(F.lit("e"), F.left(F.sha2(F.concat_ws("\x1f", F.coalesce(glob, F.lit("")), F.coalesce(category, F.lit("")), words), 256), F.lit(16)))


def _entries(rows: DataFrame) -> DataFrame:
    """Entry columns from rows with guidance, file_glob, category, strongest_kind, counters and their source."""
    return rows.withColumn("id", entry_id(F.col("file_glob"), F.col("category"), F.col("guidance"))).select("repo", "id", "guidance", "file_glob", "category", "strongest_kind", "source_pr", "source_comment_id", "confirmations", "refutations", F.col("seen").alias("first_seen"), F.col("seen").alias("last_seen"))


def directives_to_entries(directives: DataFrame, shipped: DataFrame, now: str) -> DataFrame:
    """Entries from directives; an index is a place among the review's shipped findings, and one beyond them is dropped."""
    seen = F.when(F.coalesce("created_at", F.lit("")) == "", now).otherwise(F.col("created_at"))
    d = directives.select("repo", "pr", F.col("id").alias("source_comment_id"), "kind", "text", "index", seen.alias("seen"))
    free = d.where("kind = 'remember'").select("*", clamp_guidance(F.col("text")).alias("guidance"), F.lit(None).cast("string").alias("file_glob"), F.lit(None).cast("string").alias("category"), F.lit("user-directive").alias("strongest_kind"), F.lit(1).alias("confirmations"), F.lit(0).alias("refutations"))
    places = shipped.select("repo", "pr", F.col("place").alias("index"), "file", "title", "category")
    on = d.where("kind <> 'remember'").join(places, ["repo", "pr", "index"])
    good = F.col("kind") == "good"
    told = F.concat(F.lit("On `"), "file", F.lit("`, the council finding `"), "title", F.lit("` was "), F.when(good, "confirmed").otherwise("refuted"), F.lit(" by a human reviewer on PR #"), F.col("pr").cast("string"), F.lit("."))
    on = on.withColumns({"guidance": told, "file_glob": file_to_glob(F.col("file")), "strongest_kind": F.when(good, "confirmed").otherwise("refuted"), "confirmations": good.cast("int"), "refutations": (~good).cast("int")})
    both = free.unionByName(on.select(free.columns))
    return _entries(both.withColumnRenamed("pr", "source_pr"))


def reactions_to_entries(system_comments: DataFrame, shipped: DataFrame, now: str) -> DataFrame:
    """Entries from reactions to a review's own comment: they confirm or refute its top finding."""
    r = lambda *names: sum((F.coalesce(F.col(f"reactions.{n}"), F.lit(0)) for n in names), F.lit(0))
    top = shipped.where("place = 0").select("repo", "pr", "file", "title", "category")
    rows = system_comments.select("repo", "pr", F.col("id").alias("source_comment_id"), r("plus_one", "heart", "hooray", "rocket").alias("pos"), r("minus_one", "confused").alias("neg")).join(top, ["repo", "pr"])
    signs = F.array(F.struct(F.lit("confirmed").alias("kind"), F.col("pos").alias("n")), F.struct(F.lit("refuted").alias("kind"), F.col("neg").alias("n")))
    rows = rows.withColumn("s", F.explode(signs)).where("s.n > 0")
    good = F.col("s.kind") == "confirmed"
    told = F.concat(F.lit("Council finding `"), "title", F.lit("` in `"), "file", F.when(good, "` was reinforced by ").otherwise("` was refuted by "), F.col("s.n").cast("string"), F.when(good, " positive").otherwise(" negative"), F.lit(" reaction(s) on PR #"), F.col("pr").cast("string"), F.when(good, ".").otherwise(" — likely a false positive pattern."))
    rows = rows.withColumns({"guidance": told, "file_glob": file_to_glob(F.col("file")), "strongest_kind": F.col("s.kind"), "confirmations": F.when(good, F.col("s.n")).otherwise(0).cast("int"), "refutations": F.when(good, 0).otherwise(F.col("s.n")).cast("int"), "seen": F.lit(now)})
    return _entries(rows.withColumnRenamed("pr", "source_pr"))


def merge_entries(corpus: DataFrame, new: DataFrame, idempotent: bool = False) -> DataFrame:
    """The corpus with new entries merged in, by repo and id, with hits (rows merged) and added (not in the corpus).

    Counters add up, last_seen moves forward, the kind is that of the highest rank, and first values stay unless
    empty. new is taken in order of last_seen and source. With idempotent, a signal from the same comment of
    the same review counts once.
    """
    if idempotent:
        new = new.dropDuplicates(["repo", "id", "source_pr", "source_comment_id"]).join(corpus.select("repo", "id", "source_pr", "source_comment_id"), ["repo", "id", "source_pr", "source_comment_id"], "left_anti")
    cols = ["repo", "id", "guidance", "file_glob", "category", "strongest_kind", "source_pr", "source_comment_id", "confirmations", "refutations", "first_seen", "last_seen"]
    both = corpus.select(*cols, F.lit(0).alias("_o")).unionByName(new.select(*cols, F.lit(1).alias("_o")))
    order = F.struct("_o", "last_seen", "source_pr", "source_comment_id")
    first = lambda c: F.min_by(c, order).alias(c)
    filled = lambda c, ok: F.coalesce(F.min_by(c, F.when(ok, order)), F.min_by(c, order)).alias(c)
    rank = F.struct(_of(RANK, F.col("strongest_kind")).alias("r"), (-F.col("_o")).alias("o"))
    return both.groupBy("repo", "id").agg(
        filled("guidance", strip(F.col("guidance")) != ""),
        first("file_glob"),
        first("category"),
        F.max_by("strongest_kind", rank).alias("strongest_kind"),
        first("source_pr"),
        filled("source_comment_id", F.col("source_comment_id").isNotNull()),
        F.sum("confirmations").alias("confirmations"),
        F.sum("refutations").alias("refutations"),
        first("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.count_if(F.col("_o") == 1).alias("hits"),
        (F.min("_o") == 1).alias("added"),
    )


def score_entries(entries: DataFrame, now: str, opts: ScoreOptions = ScoreOptions()) -> DataFrame:
    """entries with score: authority and net signals, halved in each half-life since last_seen, never below 0.

    A time that can't be read counts as long ago, one to come as now.
    """
    seconds = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.try_to_timestamp("last_seen"))
    decay = F.when(seconds.isNull(), opts.unparsed_decay).when(seconds <= 0, 1.0).otherwise(F.pow(F.lit(0.5), seconds / 86400.0 / opts.half_life_days))
    raw = authority(F.col("strongest_kind")) + F.col("confirmations") * opts.per_confirmation - F.col("refutations") * opts.per_refutation
    return entries.withColumn("score", F.greatest(F.lit(0.0), raw * decay))


def compact(entries: DataFrame, now: str, opts: ScoreOptions = ScoreOptions()) -> tuple[DataFrame, DataFrame]:
    """(the best entries of each repo, rescored, with place; repo and evicted, the number that went)."""
    scored = score_entries(entries, now, opts)
    order = Window.partitionBy("repo").orderBy(F.col("score").desc(), F.col("last_seen").desc(), "id")
    ranked = scored.where(F.col("score") >= opts.least).withColumn("place", F.row_number().over(order))
    kept = ranked.where(F.col("place") <= opts.keep)
    n = entries.groupBy("repo").agg(F.count(F.lit(1)).alias("_all")).join(kept.groupBy("repo").agg(F.count(F.lit(1)).alias("_kept")), "repo", "left")
    return kept, n.select("repo", (F.col("_all") - F.coalesce("_kept", F.lit(0))).alias("evicted"))


def glob_matches(glob: Column, path: Column) -> Column:
    """The corpus's small globs: a path, a folder and all or one level below it, a suffix, or one star."""
    before = lambda n: F.left(glob, F.char_length(glob) - n)
    under = path.startswith(F.concat(before(F.lit(3)), F.lit("/")))
    one = F.concat(before(F.lit(2)), F.lit("/"))
    direct = path.startswith(one) & (F.instr(F.substring(path, F.char_length(one) + 1, F.lit(1 << 30)), "/") == 0)
    lhs = F.substring_index(glob, "*", 1)
    rhs = F.substring(glob, F.char_length(lhs) + 2, F.lit(1 << 30))
    star = path.startswith(lhs) & path.endswith(rhs) & (F.char_length(path) >= F.char_length(lhs) + F.char_length(rhs))
    return (
        F.when(glob == path, True)
        .when(glob.endswith("/**"), (path == before(F.lit(3))) | under)
        .when(glob.endswith("/*"), direct)
        .when(glob.startswith("**/"), path.endswith(F.substring(glob, F.lit(4), F.lit(1 << 30))))
        .when(F.instr(glob, "*") > 0, star)
        .otherwise(False)
    )


def _glob_keys(glob: Column) -> Column:
    """kind and key under which a glob is found: one pair of those that each path it matches has (see _path_keys)."""
    lhs = F.substring_index(glob, "*", 1)
    rhs = F.substring(glob, F.char_length(lhs) + 2, F.lit(1 << 30))
    cut = lambda n: F.left(glob, F.char_length(glob) - n)
    pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    # What a path must end with: by its last name if it has a whole one, else by all of it, which then is in a path's name.
    ending = lambda t: F.when(F.instr(t, "/") > 0, pair("name", F.substring_index(t, "/", -1))).otherwise(pair("end", t))
    begin = F.when(F.instr(lhs, "/") > 0, pair("folder", F.regexp_replace(lhs, "/[^/]*$", ""))).otherwise(pair("begin", lhs))
    other = (
        F.when(glob.endswith("/**"), pair("folder", cut(3)))
        .when(glob.endswith("/*"), pair("parent", cut(2)))
        .when(glob.startswith("**/"), ending(F.substring(glob, F.lit(4), F.lit(1 << 30))))
        .when((F.instr(glob, "*") > 0) & (rhs != ""), ending(rhs))
        .when(F.instr(glob, "*") > 0, begin)
    )
    return F.filter(F.array(pair("path", glob), other), lambda k: k.isNotNull())


def _path_keys(path: Column) -> Column:
    """All pairs of kind and key under which a glob that matches the path may be found."""
    parts = F.split(path, "/")
    name, first = F.element_at(parts, -1), parts[0]
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    ends = F.transform(F.sequence(F.lit(0), F.char_length(name)), lambda n: F.right(name, n))
    begins = F.transform(F.sequence(F.lit(0), F.char_length(first)), lambda n: F.left(first, n))
    parent = F.when(F.size(parts) > 1, F.array(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"))).otherwise(F.array().cast("array<string>"))
    named = (("path", F.array(path)), ("folder", folders), ("parent", parent), ("name", F.array(name)), ("end", ends), ("begin", begins))

    def pairs(kind: str, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    return F.concat(*[pairs(kind, keys) for kind, keys in named])


def matching_globs(globs: DataFrame, paths: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, file_glob: the globs (keys, file_glob) that match paths (keys, path), each once.

    Globs are indexed by what they fix: the whole path, a folder, a parent, a name, or the beginning or end of one. A path
    looks up its own, some dozens of keys, so that globs and paths of a key aren't paired; what is found is then matched.
    """
    index = globs.where("file_glob IS NOT NULL").select(*keys, "file_glob").distinct().select("*", F.explode(_glob_keys(F.col("file_glob"))).alias("k")).select(*keys, "file_glob", "k.kind", "k.key")
    asked = paths.where("path IS NOT NULL").select(*keys, "path").distinct().select("*", F.explode(F.array_distinct(_path_keys(F.col("path")))).alias("k")).select(*keys, "path", "k.kind", "k.key")
    found = asked.join(index, [*keys, "kind", "key"]).where(glob_matches(F.col("file_glob"), F.col("path")))
    return found.select(*keys, "path", "file_glob").distinct()


def _review(df: DataFrame) -> list[str]:
    return [c for c in ("repo", "pr") if c in df.columns]


def select_guidance(corpus: DataFrame, changed: DataFrame | None, persona: str | None = None, opts: GuidanceOptions = GuidanceOptions()) -> DataFrame:
    """The best entries that fit a persona and touch a changed file, with place: of each repo, or of each review if changed has a pr.

    Entries without category or glob fit all, and all entries fit where no changed file is known: in repositories that changed
    doesn't have, or for reviews whose paths are null. A repository's paths look up its globs once, for all reviews.
    """
    rows = corpus if persona is None else corpus.where(F.col("category").isNull() | (F.col("category") == persona))
    keys = ["repo"]
    if changed is not None:
        keys = _review(changed)
        hits = matching_globs(rows, changed, ["repo"]).join(changed.select(*keys, "path").distinct(), ["repo", "path"]).select(*keys, "file_glob").distinct()
        reviews = changed.groupBy(*keys).agg((F.count("path") == 0).alias("_open"))
        told = rows.join(reviews, "repo", "left").withColumn("_open", F.coalesce("_open", F.lit(True)))
        rows = told.where(F.col("_open") | F.col("file_glob").isNull()).unionByName(told.where(~F.col("_open")).join(hits, [*keys, "file_glob"], "left_semi")).drop("_open")
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= opts.keep)


def guidance_lines(chosen: DataFrame) -> DataFrame:
    """repo (and pr, if chosen has it), place, line: entries as the lines of a list."""
    label = _of({"user-directive": "📌 directive", "confirmed": "✅ confirmed", "inferred-applied": "↪ likely-relevant", "refuted": "🚫 false-positive pattern", "inferred-ignored": "≈ low-signal"}, F.col("strongest_kind"))
    inner = F.concat_ws(" · ", F.when(F.col("file_glob").isNotNull(), F.concat(F.lit("`"), "file_glob", F.lit("`"))), "category")
    scope = F.when(inner == "", "").otherwise(F.concat(F.lit(" [scope: "), inner, F.lit("]")))
    line = F.concat(F.col("place").cast("string"), F.lit(". "), label, scope, F.lit(": "), sanitise(F.col("guidance")), F.lit(" (+"), F.col("confirmations").cast("string"), F.lit("/-"), F.col("refutations").cast("string"), F.lit(")\n"))
    return chosen.select(*_review(chosen), "place", line.alias("line"))


# Fixed value: what opens the block of guidance.
HEADER = "Project-specific guidance (distilled from prior reviewer feedback). Treat these as priors, not rules — they reflect what *this* project's humans have endorsed or refuted in past PRs:\n"
OVERFLOW = "…\n"


def budget_prefix(lines: DataFrame, opts: GuidanceOptions = GuidanceOptions(), header: str = HEADER) -> DataFrame:
    """The block of guidance of each repo (or review, if lines have a pr), as lines: a header (place 0), then lines in order of place.

    The first line that would bring all to over the limit, in bytes, is replaced by a mark, and none follows it.
    """
    keys = _review(lines)
    upto = Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    used = len(header.encode()) + F.sum(F.octet_length("line").cast("bigint")).over(upto)
    marked = lines.select(*keys, "place", "line", (used > opts.limit).alias("_over"))
    first_over = F.sum(F.col("_over").cast("bigint")).over(upto)
    kept = marked.withColumn("_nth", first_over).where("_nth <= 1").select(*keys, "place", F.when(F.col("_over"), OVERFLOW).otherwise(F.col("line")).alias("line"))
    heads = lines.select(*keys).distinct().select(*keys, F.lit(0).alias("place"), F.lit(header).alias("line"))
    return heads.unionByName(kept)


def corpus_listing(entries: DataFrame, width: int = 80) -> DataFrame:
    """repo, id, kind, scope, guidance (cut to width), score, counters, as text for a list."""
    scope = F.coalesce(F.nullif(F.concat_ws(" · ", "file_glob", "category"), F.lit("")), F.lit("all"))
    short = F.when(F.char_length("guidance") > width, F.concat(F.left("guidance", F.lit(width - 1)), F.lit("…"))).otherwise(F.col("guidance"))
    return entries.select("repo", "id", F.col("strongest_kind").alias("kind"), scope.alias("scope"), short.alias("guidance"), F.round("score", 2).alias("score"), "confirmations", "refutations")
