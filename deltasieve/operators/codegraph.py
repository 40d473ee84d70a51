"""Symbols, calls and imports of source files by pattern, and who calls whom."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WHITE, strip

# Patterns of declarations, calls and imports, and words before a bracket that are no calls.
FUNCTION = r"(?:export\s+|pub\s+(?:\([^)]*\)\s+)?|async\s+|static\s+)*(?:function|fn|func)\s+([A-Za-z_]\w*)\s*[(<]"
CLASS = r"(?:export\s+|pub\s+)*class\s+([A-Za-z_]\w*)"
TYPE = r"(?:pub\s+(?:\([^)]*\)\s+)?)?(?:struct|enum|interface|type)\s+([A-Za-z_]\w*)"
CALL = r"(?<![A-Za-z0-9_])\d*+([A-Za-z_]\w*+)\s*+\("
IMPORT = r"""(?m)^\s*(?:import\s+(?:[^"']*\s+from\s+)?['"]([^'"]+)['"]|import\s+\(\s*["']([^'"]+)["']|use\s+([A-Za-z_][A-Za-z_0-9:\*\{\}\s,]*)\s*;|extern\s+crate\s+([A-Za-z_]\w*))"""
KINDS = ("fn", "cls", "type")
NOT_CALLS = ("if", "for", "while", "switch", "catch", "function", "return", "match", "fn", "func", "case", "else", "do", "try", "throw", "select")


def _lines(files: DataFrame) -> DataFrame:
    return files.select("repo", "path", F.posexplode(F.split("content", "\n")).alias("at", "text")).withColumn("line", F.col("at") + 1)


def extract_symbols(files: DataFrame) -> DataFrame:
    """repo, path, line, kind (fn, cls, type), name, exported, signature of declarations, line by line.

    A type that a function or class of the same name on its line has already given is left out.
    """
    # Most lines have no word that declares anything, and are not searched.
    declaring = reduce(lambda a, b: a | b, [F.col("text").contains(w) for w in ("fn", "func", "class", "struct", "enum", "interface", "type")])
    fn, cls, typ = (F.regexp_extract("text", p, 1) for p in (FUNCTION, CLASS, TYPE))
    kinds = F.array(F.struct(F.lit("fn").alias("kind"), fn.alias("name")), F.struct(F.lit("cls").alias("kind"), cls.alias("name")), F.struct(F.lit("type").alias("kind"), F.when((typ != fn) & (typ != cls), typ).otherwise("").alias("name")))
    found = _lines(files).where(declaring).select("repo", "path", "line", "text", F.explode(F.filter(kinds, lambda k: k["name"] != "")).alias("k"))
    start = F.ltrim("text", F.lit(WHITE))
    return found.select("repo", "path", "line", "k.kind", "k.name", (start.startswith("pub") | start.startswith("export")).alias("exported"), strip(F.col("text")).alias("signature"))


def _first_ids(symbols: DataFrame) -> DataFrame:
    """repo, path, name, id of the first symbol of each name in its file."""
    order = F.struct("line", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")))
    return symbols.groupBy("repo", "path", "name").agg(F.min_by(F.concat("kind", F.lit(":"), "name"), order).alias("id"))


def call_edges(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """repo, path, to: symbols of a file that it calls, each once."""
    names = F.array_distinct(F.regexp_extract_all("content", F.lit(CALL), 1))
    calls = files.select("repo", "path", F.explode(names).alias("name")).where(~F.col("name").isin(*NOT_CALLS))
    return calls.join(_first_ids(symbols), ["repo", "path", "name"]).select("repo", "path", F.col("id").alias("to")).distinct()


def calls_by_line(files: DataFrame) -> DataFrame:
    """repo, path, line, name of every call site."""
    calls = _lines(files).where(F.col("text").contains("(")).select("repo", "path", "line", F.explode(F.regexp_extract_all("text", F.lit(CALL), 1)).alias("name"))
    return calls.where(~F.col("name").isin(*NOT_CALLS))


def attribute_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """repo, path, caller, name: each call goes to the last symbol declared at or above its line; not to itself.

    The caller of a call above all symbols is null: the file itself. An as-of join by line: symbols and calls of a file are one ordered sequence, whose last symbol is carried on.
    """
    both = symbols.select("repo", "path", "line", F.lit(0).alias("o"), F.col("name").alias("symbol"), F.lit(None).cast("string").alias("name")).unionByName(
        calls.select("repo", "path", "line", F.lit(1).alias("o"), F.lit(None).cast("string").alias("symbol"), "name")
    )
    above = Window.partitionBy("repo", "path").orderBy("line", "o", "symbol").rowsBetween(Window.unboundedPreceding, 0)
    asof = both.withColumn("caller", F.last("symbol", ignorenulls=True).over(above)).where("o = 1 AND (caller IS NULL OR caller <> name)")
    return asof.select("repo", "path", "caller", "name").distinct()


def extract_imports(files: DataFrame) -> DataFrame:
    """repo, path, imports (distinct, in order) and local (those that begin with ./ or ../)."""
    groups = [F.regexp_extract_all("content", F.lit(IMPORT), i) for i in range(1, 5)]
    zipped = F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(groups)])
    first = F.transform(zipped, lambda z: strip(F.concat(*[z[f"g{i}"] for i in range(4)])))
    found = files.select("repo", "path", F.array_distinct(F.filter(first, lambda s: s != "")).alias("imports"))
    return found.withColumn("local", F.filter("imports", lambda s: s.startswith("./") | s.startswith("../")))


def called_names(edges: DataFrame) -> DataFrame:
    """repo, path, names: what each file calls, without the kinds of the symbols."""
    return edges.groupBy("repo", "path").agg(F.sort_array(F.collect_set(F.regexp_replace("to", "^[a-z]+:", ""))).alias("names"))


def callers(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """repo, path, name, called_by: who calls a symbol, in any file (path and caller, null for the file itself, in order).

    Recursion within its own file is left out, and a symbol that nothing else calls has no row. The callers of a name are
    gathered once, whatever the number of files that declare it.
    """
    used = calls.groupBy("repo", "name").agg(F.sort_array(F.collect_set(F.struct("path", "caller"))).alias("all"))
    defined = symbols.select("repo", "path", "name").distinct()
    others = F.filter("all", lambda c: ~((c["path"] == F.col("path")) & c["caller"].eqNullSafe(F.col("name"))))
    return defined.join(used, ["repo", "name"]).select("repo", "path", "name", others.alias("called_by")).where(F.size("called_by") > 0)


def fit_in_order(sizes: Column, cap: int) -> Column:
    """For an array of sizes, whether each fits in what is left of cap: one that doesn't is skipped, later ones may fit."""

    def step(acc: Column, size: Column) -> Column:
        fits = acc["used"] + size <= cap
        return F.struct(F.when(fits, acc["used"] + size).otherwise(acc["used"]).alias("used"), F.concat(acc["kept"], F.array(fits)).alias("kept"))

    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<boolean>").alias("kept"))
    return F.aggregate(sizes, start, step, lambda acc: acc["kept"])


def _one_line(text: Column, most: int = 240) -> Column:
    """text on one line; over most bytes, the whole characters that fit in three bytes less, and a mark."""
    flat = F.regexp_replace(text, r"[ \n\r\t]+", " ")
    room = most - 3
    fitting = F.filter(F.sequence(F.lit(room // 4), F.lit(room)), lambda n: F.octet_length(F.left(flat, n)) <= room)
    return F.when(F.octet_length(flat) > most, F.concat(F.left(flat, F.array_max(fitting)), F.lit("…"))).otherwise(flat)


def scope_rows(symbols: DataFrame, called_by: DataFrame, changed: DataFrame, cap: int = 8 * 1024) -> DataFrame:
    """repo (and pr, if changed has it), block, elided: the symbols of changed files and who calls them, as text of at most cap bytes.

    A file has a header, then its symbols in order. What doesn't fit any more is passed over, while smaller entries
    after it may fit; without its header a file has no entries. The number of entries left out is told at the end.
    Only places and sizes are folded; the texts of what fits, which cap bounds, are joined back.
    """
    keys = [c for c in ("repo", "pr") if c in changed.columns]
    mine = symbols.join(changed.select(*keys, "path").distinct(), ["repo", "path"]).join(called_by, ["repo", "path", "name"], "left")
    who = F.array_join(F.transform("called_by", lambda c: F.concat(c["path"], F.coalesce(F.concat(F.lit("::"), c["caller"]), F.lit("")))), ", ")
    signature = F.when(F.col("signature") == "", "").otherwise(F.concat(F.lit(" `"), _one_line(F.col("signature")), F.lit("`")))
    entry = F.concat(F.lit("  - "), "kind", F.lit(" "), "name", F.lit(" (L"), F.col("line").cast("string"), F.lit(")"), F.when(F.col("exported"), " [pub]").otherwise(""), signature, F.lit("\n"))
    shown = F.concat(entry, F.coalesce(F.concat(F.lit("    called by: "), who, F.lit("\n")), F.lit("")))
    in_file = Window.partitionBy(*keys, "path").orderBy("line", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")))
    entries = mine.select(*keys, "path", F.row_number().over(in_file).alias("nth"), shown.alias("shown"))
    headers = mine.select(*keys, "path").distinct().select(*keys, "path", F.lit(0).alias("nth"), F.concat(F.lit("\n"), "path", F.lit(":\n")).alias("shown"))
    rows = headers.unionByName(entries)
    sized = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("path", "nth", F.octet_length("shown").cast("bigint").alias("size")))).alias("all"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["used"] + x["size"] <= cap) & ((x["nth"] == 0) | acc["open"])
        decided = F.transform(F.array(fits), lambda f: F.struct(
            F.when(f, acc["used"] + x["size"]).otherwise(acc["used"]).alias("used"),
            F.when(x["nth"] == 0, f).otherwise(acc["open"]).alias("open"),
            (acc["elided"] + ((x["nth"] > 0) & ~f).cast("bigint")).alias("elided"),
            F.when(f, F.concat(acc["kept"], F.array(F.struct(x["path"].alias("path"), x["nth"].alias("nth"))))).otherwise(acc["kept"]).alias("kept"),
        ))
        return decided[0]

    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("used"), F.lit(False).alias("open"), zero.alias("elided"), F.array().cast("array<struct<path:string,nth:int>>").alias("kept"))
    folded = sized.select(*keys, F.aggregate("all", start, step).alias("f"))
    kept = folded.select(*keys, F.col("f.elided").alias("elided"), F.explode("f.kept").alias("k")).select(*keys, "elided", "k.path", "k.nth")
    whole = rows.join(kept, [*keys, "path", "nth"]).groupBy(*keys, "elided").agg(F.sort_array(F.collect_list(F.struct("path", "nth", "shown"))).alias("parts"))
    mark = F.when(F.col("elided") > 0, F.concat(F.lit("\n… [+"), F.col("elided").cast("string"), F.lit(f" more entries elided to stay under {cap} bytes]\n"))).otherwise("")
    return whole.select(*keys, F.concat(F.array_join(F.transform("parts", lambda x: x["shown"]), ""), mark).alias("block"), "elided")
