"""Unified diffs: splitting, ignoring, context, and packing into chunks of bounded size."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, truncate_middle
from ..options import ChunkPolicy
from ..sources.shared import settled
from .codegraph import fit_in_order
from .graphs import follow

# Paths that are not reviewed.
IGNORED = (
    "Cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "go.sum", "Pipfile.lock", "composer.lock", "Gemfile.lock", "uv.lock",
    ".pb.go", ".pb.h", ".pb.cc", "_pb2.py", "_pb2_grpc.py", ".generated.go", ".gen.go", ".generated.ts", ".gen.ts", ".g.dart", "generated.dart",
    "node_modules/", "vendor/", "target/", "build/", "dist/", "out/", ".next/", ".nuxt/", "__pycache__/", ".min.js", ".min.css",
    "__snapshots__/", ".snap",
)


def split_diffs(diffs: DataFrame) -> DataFrame:
    """repo, pr, pos, piece: a row for each file of a diff, without the words that open it.

    CRLF becomes LF if there is one in the front of the diff. Text before the first opening is dropped, unless an
    opening stands within it.
    """
    text = F.when(F.left("diff", F.lit(4096)).contains("\r\n"), F.replace("diff", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("diff"))
    pieces = F.split(text, "\ndiff --git ")
    first = pieces[0]
    start = F.when(first.startswith("diff --git "), F.array(F.substring(first, 12, F.lit(1 << 30)))).when(first.contains("diff --git "), F.split(first, "diff --git ")).otherwise(F.array().cast("array<string>"))
    rest = F.slice(pieces, 2, F.greatest(F.lit(0), F.size(pieces) - 1))
    filled = F.filter(F.concat(start, rest), lambda p: ~p.rlike(r"^\s*$"))
    return diffs.select("repo", "pr", F.posexplode(filled).alias("pos", "piece"))


def _last(piece: Column, pattern: str, drop: str | None = None) -> Column:
    """The last match of a header line's pattern, or null."""
    found = F.regexp_extract_all(piece, F.lit(pattern), 1)
    if drop is not None:
        found = F.filter(found, lambda x: x != drop)
    return F.try_element_at(found, F.lit(-1))


def _plain(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^[ab]/", ""), r"[\t ]+$", "")


def parse_diff_files(pieces: DataFrame) -> DataFrame:
    """repo, pr, pos, path, is_new, is_deleted, is_pure_rename, additions, deletions, body of each piece.

    Combined diffs and pieces without a path are dropped. Lines are counted from the first hunk on.
    """
    at = F.instr("piece", "\n@@")
    header = F.when(at > 0, F.substring(F.col("piece"), F.lit(1), at - 1)).otherwise(F.col("piece"))
    hunk = F.when(at > 0, F.substring(F.col("piece"), at + 1, F.lit(1 << 30))).otherwise("")
    rows = pieces.withColumns({"header": header, "hunk": hunk})
    h = F.col("header")
    opened = F.regexp_extract("piece", r"(?d)^([^\n]*)\n", 1)
    named = F.when(F.instr(opened, " b/") > 0, F.substring(opened, F.instr(opened, " b/") + 3, F.lit(1 << 30)))
    path = F.coalesce(_plain(_last(h, r"(?md)^\+\+\+ (.*)$", "/dev/null")), _plain(_last(h, r"(?md)^--- (.*)$", "/dev/null")), named)
    out = rows.where(~h.rlike(r"(?m)^diff --(cc|combined) ")).select(
        "repo",
        "pr",
        "pos",
        path.alias("path"),
        h.rlike(r"(?m)^new file mode ").alias("is_new"),
        (h.rlike(r"(?m)^deleted file mode ") | h.rlike(r"(?md)^\+\+\+ /dev/null$")).alias("is_deleted"),
        (h.rlike(r"(?m)^rename (from|to) ") & (F.col("hunk") == "")).alias("is_pure_rename"),
        F.regexp_count("hunk", F.lit("\n\\+")).cast("bigint").alias("additions"),
        F.regexp_count("hunk", F.lit("\n-")).cast("bigint").alias("deletions"),
        F.concat(F.lit("diff --git "), "piece").alias("body"),
    )
    return out.where("path IS NOT NULL")


def is_ignored(path: Column, patterns: tuple[str, ...] = IGNORED) -> Column:
    """A folder is any part of the path, a pattern with a dot a suffix of its name, others are found anywhere in it."""
    name, parts = basename(path), F.split(path, "/")

    def one(p: str) -> Column:
        if p.endswith("/"):
            return (path == p[:-1]) | path.startswith(p) | F.array_contains(parts, p[:-1])
        return name.endswith(p) if p.startswith(".") else (name == p) | path.contains(p)

    return reduce(lambda a, b: a | b, map(one, patterns), F.lit(False))


def filter_ignored(files: DataFrame, patterns: tuple[str, ...] = IGNORED) -> tuple[DataFrame, DataFrame]:
    """(kept rows, dropped repo, pr and path)."""
    bad = is_ignored(F.col("path"), patterns)
    return files.where(~bad), files.where(bad).select("repo", "pr", "path")


def attach_context(diff_files: DataFrame, files: DataFrame) -> DataFrame:
    """diff_files with context, the whole file after the change; null for deleted or unknown files."""
    known = files.select("repo", "path", F.col("content").alias("context"))
    joined = diff_files.drop("context").join(known, ["repo", "path"], "left")
    return joined.withColumn("context", F.when(~F.col("is_deleted"), F.col("context")))


def related_files(files: DataFrame, diff_files: DataFrame) -> DataFrame:
    """repo, pr, path, size (bytes): files of the snapshot that a review's diff does not touch; contents stay where they are."""
    reviews = diff_files.select("repo", "pr").distinct()
    sized = files.select("repo", "path", F.octet_length("content").cast("bigint").alias("size"))
    return sized.join(reviews, "repo").join(diff_files.select("repo", "pr", "path"), ["repo", "pr", "path"], "left_anti")


REVIEW = ["repo", "pr"]
#: Positions of a review whose running values one task works out.
PIECE = 4096


def _running(rows: DataFrame, value: Column, fold: Callable[[Column | str], Column], plus: Callable[[Column, Column], Column], name: str, back: bool = False) -> DataFrame:
    """rows (repo, pr, pos, ..) with the fold of value over all rows up to each (or from each on), null where there is none.

    Within pieces of a review and over the pieces' own folds, so that a review of any size is dealt over tasks.
    """
    at = (lambda c: F.col(c).desc()) if back else F.col
    pieces = rows.withColumns({"_piece": F.expr(f"pos div {PIECE}"), "_value": value})
    before = Window.partitionBy(*REVIEW).orderBy(at("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    whole = pieces.groupBy(*REVIEW, "_piece").agg(fold("_value").alias("_whole")).withColumn("_before", fold("_whole").over(before)).drop("_whole")
    within = Window.partitionBy(*REVIEW, "_piece").orderBy(at("pos")).rowsBetween(Window.unboundedPreceding, 0)
    near = pieces.withColumn("_near", fold("_value").over(within)).join(whole, [*REVIEW, "_piece"])
    both = F.coalesce(plus(F.col("_before"), F.col("_near")), F.col("_before"), F.col("_near"))
    return near.withColumn(name, both).drop("_piece", "_value", "_near", "_before")


def _next_cuts(sizes: DataFrame, limit: int) -> DataFrame:
    """repo, pr, node, to: for each file (its pos), the file that would begin the next chunk if this one began a chunk.

    A chunk's bytes are its bodies and one more between two, from its first body that isn't empty on. With running sums of
    bodies and ones, the next chunk begins at the first file whose sum is over a bound. Sums and bounds meet in bands as wide as a chunk; where
    a bound's band has no sum above it, it is the next band's least one.
    """
    size = F.col("body") + 1
    rows = _running(sizes, size, F.sum, lambda a, b: a + b, "upto")
    # What comes before the first body from here on that isn't empty, and that body's share.
    rows = _running(rows, F.when(F.col("body") > 0, F.struct((F.col("upto") - size).alias("base"), size.alias("size"))), F.min, lambda a, b: F.least(a, b), "first", back=True)
    base = F.col("first.base")
    bound = F.when((F.col("body") == 0) & (F.col("first.size") > limit), base).otherwise(F.greatest(base + limit + 1, F.col("upto")))
    width = limit + 1
    points = rows.select(*REVIEW, F.col("upto").alias("value"), F.col("pos").alias("point"), F.lit(None).cast("int").alias("node"))
    bounds = rows.where(base.isNotNull()).select(*REVIEW, bound.alias("value"), F.lit(None).cast("int").alias("point"), F.col("pos").alias("node"))
    both = points.unionByName(bounds).withColumn("band", F.expr(f"value div {width}"))
    above = Window.partitionBy(*REVIEW, "band").orderBy(F.col("value").desc(), F.col("point").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("to", F.last("point", ignorenulls=True).over(above)).where("node IS NOT NULL")
    later = Window.partitionBy(*REVIEW).orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bands = both.groupBy(*REVIEW, "band").agg(F.min("point").alias("_least")).withColumn("beyond", F.last("_least", ignorenulls=True).over(later)).drop("_least")
    cuts = found.join(bands, [*REVIEW, "band"]).withColumn("to", F.coalesce("to", "beyond"))
    return cuts.where("to IS NOT NULL").select(*REVIEW, "node", "to")


def pack_chunks(diff_files: DataFrame, policy: ChunkPolicy = ChunkPolicy()) -> DataFrame:
    """diff_files with body and context cut to their limits, chunk_idx, and context null where its budget is spent.

    Files are packed in order; one that would overfill a chunk begins the next. Context counts against the chunk at
    hand before that is known, and a new chunk's budget begins after its first file.

    Where a chunk would end is found for every file at once; pointers from the first file on, doubled, then tell which
    files begin chunks. So a review of any number of files is dealt over tasks; only a chunk's contexts are folded
    in order, of which there are no more than a chunk has bytes. Only sizes take part; a null body is empty.
    """
    cut = diff_files.withColumns({"body": truncate_middle(F.col("body"), policy.file_bytes), "context": truncate_middle(F.col("context"), policy.file_context_bytes)})
    bytes_ = lambda c: F.octet_length(c).cast("bigint")
    sizes = settled(cut.select(*REVIEW, "pos", F.coalesce(bytes_("body"), F.lit(0)).alias("body"), bytes_("context").alias("context")), "sizes")
    start = sizes.groupBy(*REVIEW).agg(F.min("pos").alias("node"))
    begun = follow(_next_cuts(sizes, policy.chunk_bytes), REVIEW, start).select(*REVIEW, F.col("node").alias("pos"), "rank")
    numbered = _running(sizes.join(begun, [*REVIEW, "pos"], "left"), F.col("rank"), F.max, F.greatest, "chunk_idx")
    files = numbered.groupBy(*REVIEW, "chunk_idx").agg(F.sort_array(F.collect_list(F.struct("pos", "context"))).alias("files"))
    # The first file of a chunk, but for a review's first, is told by the budget of the chunk before.
    rest = F.when(F.col("chunk_idx") == 0, F.col("files")).otherwise(F.slice("files", F.lit(2), F.size("files")))
    over = F.lit(policy.chunk_context_bytes + 1).cast("bigint")
    folded = files.withColumn("rest", rest).withColumn("keeps", fit_in_order(F.transform("rest", lambda f: F.coalesce(f["context"], over)), policy.chunk_context_bytes))
    kept = F.arrays_zip(F.transform("rest", lambda f: f["pos"]).alias("pos"), F.transform("rest", lambda f: f["context"]).alias("context"), F.col("keeps").alias("keep"))
    chunks = settled(folded.select(*REVIEW, "chunk_idx", F.col("files")[0].alias("opens"), kept.alias("kept")), "chunks")
    spent = F.aggregate("kept", F.lit(0).cast("bigint"), lambda n, f: n + F.when(f["keep"], f["context"]).otherwise(0))
    before = chunks.select(*REVIEW, (F.col("chunk_idx") + 1).alias("chunk_idx"), spent.alias("_spent"))
    opening = chunks.join(before, [*REVIEW, "chunk_idx"]).select(*REVIEW, "chunk_idx", "opens.pos", (F.col("_spent") + F.col("opens.context") <= policy.chunk_context_bytes).alias("keep"))
    inner = chunks.select(*REVIEW, "chunk_idx", F.explode("kept").alias("f")).select(*REVIEW, "chunk_idx", "f.pos", "f.keep")
    placed = opening.unionByName(inner).withColumn("chunk_idx", F.col("chunk_idx").cast("int"))
    return cut.join(placed, [*REVIEW, "pos"]).withColumn("context", F.when(F.col("keep"), F.col("context"))).drop("keep")


def pack_related(related: DataFrame, files: DataFrame, policy: ChunkPolicy = ChunkPolicy()) -> DataFrame:
    """repo, pr, path, content of related files, cut to their limit, that fit in a chunk's budget in order of path.

    Reviews are matched with paths and sizes; contents are fetched for what was packed.
    """
    cut = files.select("repo", "path", truncate_middle(F.col("content"), policy.related_bytes).alias("content"))
    sizes = cut.select("repo", "path", F.octet_length("content").cast("bigint").alias("size"))
    sized = related.select("repo", "pr", "path").join(sizes, ["repo", "path"]).where(F.col("size") <= policy.chunk_related_bytes)
    groups = sized.groupBy("repo", "pr").agg(F.sort_array(F.collect_list(F.struct("path", "size"))).alias("all"))
    fits = groups.withColumn("fits", fit_in_order(F.transform("all", lambda x: x["size"]), policy.chunk_related_bytes))
    kept = fits.select("repo", "pr", F.explode(F.arrays_zip("all", "fits")).alias("x")).where("x.fits").select("repo", "pr", F.col("x.all.path").alias("path"))
    return kept.join(cut, ["repo", "path"]).select("repo", "pr", "path", "content")


def chunk_inventory(chunks: DataFrame) -> DataFrame:
    """repo, pr, chunk_idx: files, flags, lines and bytes of each chunk."""
    return chunks.groupBy("repo", "pr", "chunk_idx").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if("is_new").alias("new"),
        F.count_if("is_deleted").alias("deleted"),
        F.count_if("is_pure_rename").alias("renamed"),
        F.sum("additions").alias("additions"),
        F.sum("deletions").alias("deletions"),
        (F.sum(F.octet_length("body").cast("bigint")) + F.count(F.lit(1)) - 1).alias("bytes"),
        F.coalesce(F.sum(F.octet_length("context").cast("bigint")), F.lit(0)).alias("context_bytes"),
    )
