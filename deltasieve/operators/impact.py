"""Which benchmark files a change can affect: import graphs and their closures."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import glob_to_regex, normalize_path, strip
from ..sources.shared import settled
from .graphs import numbered, parted, spread, with_part

# Globs of benchmark files and source extensions of each language, folders that are never entered.
BENCH_GLOBS = {"ts": ("**/*.bench.ts", "**/*.bench.js"), "go": ("**/*_bench_test.go",), "rust": ("**/benches/**/*.rs",)}
EXTENSIONS = {"ts": (".ts", ".tsx", ".js", ".cjs", ".mjs"), "go": (".go",), "rust": (".rs",)}
INDEX_NAMES = {"ts": "index", "rust": "mod"}
EXCLUDED_DIRS = ("node_modules", "dist", "build", ".git", "target", "vendor")
# Forms of an import in each language.
TS_IMPORTS = (r"""\bfrom\s+['"]([^'"]+)['"]""", r"""\bimport\s+['"]([^'"]+)['"]""", r"""\b(?:import|require)\s*\(\s*['"]([^'"]+)['"]\s*\)""")
GO_IMPORT = r"""(?m)^\s*import\s+(?:[A-Za-z_]\w*\s+)?"([^"]+)\""""
GO_BLOCK = r"(?s)import\s*\(\s*(.*?)\s*\)"
GO_BLOCK_PATH = r"""(?m)^\s*(?:[A-Za-z_]\w*\s+)?"([^"]+)\""""
RUST_MOD = r"(?m)^\s*(?:pub(?:\s*\([^)]*\))?\s+)?mod\s+([A-Za-z_]\w*)\s*;"
RUST_PATHS = (r"""\binclude!\s*\(\s*"([^"]+)"\s*\)""", r"""#\[\s*path\s*=\s*"([^"]+)"\s*\]""")


def glob_filter(df: DataFrame, globs: list[str] | tuple[str, ...], path: str = "path") -> DataFrame:
    """Rows whose path matches any of the globs."""
    return df.where(reduce(lambda a, b: a | b, [F.col(path).rlike(glob_to_regex(g)) for g in globs], F.lit(False)))


def discover_entries(files: DataFrame, globs: list[str] | None = None) -> DataFrame:
    """Benchmark files, outside excluded folders: by the given globs, or by those of each row's language."""
    inside = files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, EXCLUDED_DIRS))))
    if globs is not None:
        return glob_filter(inside, globs)
    return reduce(DataFrame.unionByName, [glob_filter(inside.where(F.col("language") == lang), g) for lang, g in BENCH_GLOBS.items()])


def strip_comments(source: Column) -> Column:
    """Source without block and line comments; '://' is no comment, and strings aren't looked for."""
    return F.regexp_replace(F.regexp_replace(source, r"(?s)/\*.*?\*/", ""), r"(^|[^:])//[^\n]*", "$1")


def _all(source: Column, pattern: str) -> Column:
    return F.regexp_extract_all(source, F.lit(pattern), 1)


def extract_specifiers(files: DataFrame) -> DataFrame:
    """repo, path, language, spec: what each file imports, in the spelling of its source."""
    code = strip_comments(F.col("content"))
    ts = F.concat(*[_all(code, p) for p in TS_IMPORTS])
    go = F.concat(_all(code, GO_IMPORT), _all(F.array_join(_all(code, GO_BLOCK), "\n"), GO_BLOCK_PATH))
    relative = lambda p: F.when(p.rlike(r"^(\./|\.\./|/)"), p).otherwise(F.concat(F.lit("./"), p))
    rust = F.concat(F.transform(_all(code, RUST_MOD), lambda m: F.concat(F.lit("./"), m)), *[F.transform(_all(code, p), relative) for p in RUST_PATHS])
    specs = F.when(F.col("language") == "ts", ts).when(F.col("language") == "go", go).when(F.col("language") == "rust", rust)
    return files.select("repo", "path", "language", F.explode(specs).alias("spec"))


def relative_only(specs: DataFrame) -> DataFrame:
    """Imports that name a place from the importing file; in TypeScript also '.', '..' and rooted ones."""
    near = F.col("spec").startswith("./") | F.col("spec").startswith("../")
    ts = F.col("spec").isin(".", "..") | F.col("spec").startswith("/")
    return specs.where(near | ((F.col("language") == "ts") & ts))


def _directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def resolve_imports(specs: DataFrame, files: DataFrame) -> DataFrame:
    """repo, src, dst: the files that relative imports lead to, by equi-joins with the table of files.

    A spec with a source extension is that file or nothing. A Go spec is all files of its folder, if it is one. Else
    the first of the extensions, then of the folder's index (TypeScript) or mod (Rust) files, that exists.
    """
    rooted = F.when(F.col("spec").startswith("/"), F.col("spec")).otherwise(F.concat_ws("/", F.nullif(_directory(F.col("path")), F.lit("")), "spec"))
    based = specs.withColumn("base", normalize_path(rooted))
    parts = []
    for lang, exts in EXTENSIONS.items():
        mine = based.where(F.col("language") == lang)
        exact = reduce(lambda a, b: a | b, [F.col("spec").endswith(e) for e in exts])
        plain = [F.concat("base", F.lit(e)) for e in exts]
        index = [F.concat("base", F.lit(f"/{INDEX_NAMES[lang]}{e}")) for e in exts] if lang in INDEX_NAMES else []
        parts.append(mine.select("repo", "path", "spec", "base", F.posexplode(F.when(exact, F.array("base")).otherwise(F.array(*plain, *index))).alias("rank", "candidate")))
        if lang == "go":
            folders = files.where(F.col("path").endswith(".go")).select("repo", _directory(F.col("path")).alias("base"), F.col("path").alias("candidate"))
            parts.append(mine.where(~exact).join(folders, ["repo", "base"]).select("repo", "path", "spec", "base", F.lit(-1).alias("rank"), "candidate"))
    there = files.select("repo", F.col("path").alias("candidate")).distinct()
    found = reduce(DataFrame.unionByName, parts).join(there, ["repo", "candidate"])
    best = F.min("rank").over(Window.partitionBy("repo", "path", "spec"))
    return found.withColumn("best", best).where("rank = best").select("repo", F.col("path").alias("src"), F.col("candidate").alias("dst")).distinct()


def import_edges(files: DataFrame, extractor: Callable[[DataFrame], DataFrame] = extract_specifiers) -> DataFrame:
    """repo, src, dst of the whole snapshot; extractor may be any function from files to specs."""
    return resolve_imports(relative_only(extractor(files)), files)


def _keys(edges: DataFrame) -> list[str]:
    return [c for c in ("repo",) if c in edges.columns]


def _spelled(labels: DataFrame, ids: DataFrame, keys: list[str], columns: list[Column]) -> DataFrame:
    """Labels as rows again: each set's members by ids (keys, word, bits and what they number)."""
    on = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"i.{k}")) for k in keys], F.col("l.word") == F.col("i.word"))
    rows = labels.alias("l").join(ids.alias("i"), on).where(F.col("l.bits").bitwiseAND(F.col("i.bits")) != 0)
    return rows.select(*[F.col(f"l.{k}").alias(k) for k in keys], *columns)


def reachable(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """entry, node (and repo, if edges have it): what each entry leads to, itself included.

    All entries are numbered, those of one part of a graph in a row, and spread along the edges at once, as sets of bits;
    see graphs.spread.
    """
    keys = _keys(edges)
    back = settled(edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst")), "edges")
    parts = parted(back, keys)
    of_part = [*keys, "part"]
    ids = settled(numbered(with_part(entries.select(*keys, "entry"), "entry", keys, parts), of_part, ["entry"]), "entries")
    labels = spread(with_part(back, "src", keys, parts), ids.withColumnRenamed("entry", "node"), of_part)
    return _spelled(labels, ids, of_part, [F.col("i.entry").alias("entry"), F.col("l.node").alias("node")]).drop("part")


def affected_entries(edges: DataFrame, entries: DataFrame, changed: DataFrame) -> DataFrame:
    """Entries that lead to a changed node or are one; where changed has a pr, those of each review, with its pr.

    One spread against the edges serves all entries and all reviews: a node's label is the set of reviews whose changes it leads to.
    """
    keys = _keys(edges)
    if "pr" not in changed.columns:
        seeds = changed.select(*keys, "node", F.lit(0).cast("bigint").alias("word"), F.lit(1).cast("bigint").alias("bits"))
        return entries.join(spread(edges, seeds, keys).select(*keys, F.col("node").alias("entry")), [*keys, "entry"], "left_semi")
    ids = settled(numbered(changed, keys, ["pr"]), "reviews")
    seeds = changed.select(*keys, "pr", "node").distinct().join(ids, [*keys, "pr"])
    labels = spread(edges, seeds, keys)
    hit = labels.join(entries.select(*keys, F.col("entry").alias("node")).distinct(), [*keys, "node"], "left_semi")
    told = _spelled(hit, ids, keys, [F.col("i.pr").alias("pr"), F.col("l.node").alias("entry")])
    return entries.join(told, [*keys, "entry"])


def scope_files(discovered: DataFrame, affected: DataFrame, changed: DataFrame) -> DataFrame:
    """role (changed, ran, skipped) and path, with the other columns that affected and changed share: those of each review, if both have a pr."""
    if "pr" in affected.columns and "pr" not in discovered.columns:
        reviews = changed.select(*[c for c in ("repo", "pr") if c in changed.columns]).distinct()
        discovered = discovered.join(reviews, "repo") if "repo" in discovered.columns else discovered.crossJoin(reviews)
    keys = [c for c in discovered.columns if c in affected.columns]
    roles = ((changed, "changed"), (affected, "ran"), (discovered.join(affected, keys, "left_anti"), "skipped"))
    return reduce(DataFrame.unionByName, [d.select(F.lit(role).alias("role"), *keys) for d, role in roles])


def changed_files(lines: DataFrame, extras: list[str] = ()) -> DataFrame:
    """path: the distinct trimmed lines of texts (column value) that aren't blank, and the extras."""
    listed = lines.select(F.explode(F.split("value", "\n")).alias("path")).select(strip(F.col("path")).alias("path"))
    more = lines.sparkSession.createDataFrame([(e,) for e in extras], "path string")
    return listed.unionByName(more).where("path <> ''").distinct()
