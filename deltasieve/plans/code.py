"""Queries on import graphs, code graphs and diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import codegraph as cg
from ..operators import diffs as df
from ..operators import impact as im
from ..options import ChunkPolicy
from . import fixtures as fx


def specifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.extract_specifiers(fx.files(spark, sf_dir)).select("path", "spec")


def relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.relative_only(im.extract_specifiers(fx.files(spark, sf_dir))).select("path", "spec")


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.import_edges(fx.files(spark, sf_dir)).select("repo", "src", "dst")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.edges(spark, sf_dir)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is an entry; its region is what a few links over the small ring of its block reach."""
    return fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry"))


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one size have changed."""
    return fx.table(spark, sf_dir, "part").where("p_size = 7").select(F.col("p_partkey").alias("node"))


def reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.reachable(_edges(spark, sf_dir), _entries(spark, sf_dir))


def affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.affected_entries(_edges(spark, sf_dir), _entries(spark, sf_dir), _changed(spark, sf_dir))


def _changed_in_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review for each of ten sizes of parts: these parts have changed in it."""
    return fx.table(spark, sf_dir, "part").where("p_size <= 10").select(F.col("p_size").cast("bigint").alias("pr"), F.col("p_partkey").alias("node"))


def affected_in_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.affected_entries(_edges(spark, sf_dir), _entries(spark, sf_dir), _changed_in_reviews(spark, sf_dir)).select("pr", "entry")


def scope_of_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of files of each role in each review."""
    hit = affected_in_reviews(spark, sf_dir).select("pr", F.col("entry").alias("path"))
    changed = _changed_in_reviews(spark, sf_dir).select("pr", F.col("node").alias("path"))
    found = _entries(spark, sf_dir).select(F.col("entry").alias("path"))
    return im.scope_files(found, hit, changed).groupBy("pr", "role").agg(F.count("path").alias("files"), F.sum("path").alias("paths"))


def scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _entries(spark, sf_dir)
    hit = im.affected_entries(_edges(spark, sf_dir), entries, _changed(spark, sf_dir))
    path = lambda d, c: d.select(F.col(c).alias("path"))
    return im.scope_files(path(entries, "entry"), path(hit, "entry"), path(_changed(spark, sf_dir), "node"))


def globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = fx.files(spark, sf_dir).select("path")
    return im.glob_filter(paths, ["**/doc_1*.ts", "s/doc_??.rs"])


def entries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = fx.files(spark, sf_dir).select(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("a/node_modules/"), F.regexp_replace("path", r"\.ts$", ".bench.ts"))).otherwise(F.regexp_replace("path", r"\.ts$", ".bench.ts")).alias("path"), "language")
    return im.discover_entries(named).select("path")


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.table(spark, sf_dir, "pages").select(F.concat(F.lit("\t "), "url", F.lit(" \r\n\n b/"), F.col("page_id") % 5, F.lit("\u00a0")).alias("value"))
    return im.changed_files(lines, ["extra.rs"])


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    ends = F.array(*[F.lit(e) for e in (*tx.LANG_HINTS, "RS", "txt", "lock")])
    named = fx.files(spark, sf_dir).select(F.concat("path", F.lit("."), F.element_at(ends, (i % F.size(ends) + 1).cast("int"))).alias("path"))
    return named.select("path", tx.language_of(F.col("path")).alias("language"), tx.lang_hint(F.col("path")).alias("hint"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cg.extract_symbols(fx.files(spark, sf_dir))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.files(spark, sf_dir)
    return cg.call_edges(f, cg.extract_symbols(f)).select("path", "to")


def attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.files(spark, sf_dir)
    return cg.attribute_calls(cg.calls_by_line(f), cg.extract_symbols(f)).select("path", "caller", "name")


def raw_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cg.extract_imports(fx.files(spark, sf_dir))
    return found.select("path", F.array_join("imports", "|").alias("imports"), F.array_join("local", "|").alias("local"))


def names_called(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.files(spark, sf_dir)
    return cg.called_names(cg.call_edges(f, cg.extract_symbols(f))).select("path", F.array_join("names", "|").alias("names"))


def _callers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = fx.files(spark, sf_dir)
    s = cg.extract_symbols(f)
    return s, cg.callers(cg.attribute_calls(cg.calls_by_line(f), s), s)


def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = F.array_join(F.transform("called_by", lambda c: F.concat(c["path"], F.lit("::"), F.coalesce(c["caller"], F.lit("")))), ",")
    return _callers(spark, sf_dir)[1].select("repo", "path", "name", who.alias("called_by"))


def scope_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fits of each repository's listing, if all of its files have changed."""
    s, by = _callers(spark, sf_dir)
    return cg.scope_rows(s, by, fx.files(spark, sf_dir).select("repo", "path"), 4096)


def _files_of_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return df.parse_diff_files(df.split_diffs(fx.diffs(spark, sf_dir)))


def diff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files_of_diffs(spark, sf_dir).withColumn("body", F.md5("body"))


def ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, dropped = df.filter_ignored(_files_of_diffs(spark, sf_dir))
    return kept.select("pr", "path", F.lit(True).alias("kept")).unionByName(dropped.select("pr", "path", F.lit(False).alias("kept")))


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("r"), F.expr(f"doc_id div {fx.REPO}")).alias("repo"), F.concat(F.lit("src/m"), F.col("doc_id") % 4, F.lit("/f"), F.col("doc_id"), F.lit(".rs")).alias("path"), F.col("text").alias("content"))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = df.filter_ignored(_files_of_diffs(spark, sf_dir))
    return df.attach_context(kept, _snapshot(spark, sf_dir)).select("pr", "path", F.md5("context").alias("context"))


def related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return df.related_files(_snapshot(spark, sf_dir), _files_of_diffs(spark, sf_dir)).select("pr", "path", "size")


POLICY = ChunkPolicy(chunk_bytes=30_000, file_bytes=9_000, file_context_bytes=4_000, chunk_context_bytes=12_000, related_bytes=4_000, chunk_related_bytes=16_000)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = df.filter_ignored(_files_of_diffs(spark, sf_dir))
    return df.pack_chunks(df.attach_context(kept, _snapshot(spark, sf_dir)), POLICY)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("pr", "pos", "path", "chunk_idx", F.md5("body").alias("body"), F.md5("context").alias("context"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return df.chunk_inventory(_chunks(spark, sf_dir)).drop("repo")


def related_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = _snapshot(spark, sf_dir)
    return df.pack_related(df.related_files(snap, _files_of_diffs(spark, sf_dir)), snap, POLICY).select("pr", "path", F.md5("content").alias("content"))


QUERIES = {
    "import_specifiers": specifiers,
    "relative_imports": relative,
    "import_edges": imports,
    "reachable": reach,
    "affected_entries": affected,
    "affected_in_reviews": affected_in_reviews,
    "scope_of_reviews": scope_of_reviews,
    "scope_files": scope,
    "glob_filter": globs,
    "discover_entries": entries_of,
    "changed_files": changed,
    "languages": languages,
    "extract_symbols": symbols,
    "call_edges": calls,
    "attribute_calls": attributed,
    "extract_imports": raw_imports,
    "called_names": names_called,
    "callers": callers,
    "scope_rows": scope_listing,
    "diff_files": diff_files,
    "filter_ignored": ignored,
    "attach_context": contexts,
    "related_files": related,
    "pack_chunks": chunks,
    "chunk_inventory": inventory,
    "pack_related": related_packed,
}

_q = lambda text: "'" + text.replace("'", "''") + "'"
_all = lambda text, pattern: f"regexp_extract_all({text}, {_q(pattern)}, 1)"
# The same patterns, without what that engine lacks: it needs no possessive forms, and its lines end at line feeds alone.
_CALL = r"([A-Za-z_]\w*)\s*\("
_TS, _RUST = (im.TS_IMPORTS, im.RUST_PATHS)
_REL = lambda x: f"CASE WHEN regexp_matches({x}, '^(\\./|\\.\\./|/)') THEN {x} ELSE './' || {x} END"
_F = f"WITH {fx.FILES_SQL}"
_SPECS = f""", code AS (SELECT repo, path, i, language, regexp_replace(regexp_replace(content, '(?s)/\\*.*?\\*/', '', 'g'), '(^|[^:])//[^\\n]*', '\\1', 'g') AS c FROM f),
  sp AS (SELECT repo, path, i, language, unnest(CASE language
    WHEN 'ts' THEN list_concat(list_concat({_all('c', _TS[0])}, {_all('c', _TS[1])}), {_all('c', _TS[2])})
    WHEN 'go' THEN list_concat({_all('c', im.GO_IMPORT)}, {_all(f"array_to_string({_all('c', im.GO_BLOCK)}, chr(10))", im.GO_BLOCK_PATH)})
    ELSE list_concat(list_concat(list_transform({_all('c', im.RUST_MOD)}, lambda x: './' || x), list_transform({_all('c', _RUST[0])}, lambda x: {_REL('x')})), list_transform({_all('c', _RUST[1])}, lambda x: {_REL('x')})) END) AS spec FROM code)"""
_E = "WITH RECURSIVE e AS (SELECT p_partkey AS src, unnest([p_partkey // 16 * 16 + (7 * p_partkey + 3) % 16, p_partkey // 16 * 16 + p_partkey % 16 // 2]) AS dst FROM part)"
_HIT = ", h AS (SELECT p_partkey AS node FROM part WHERE p_size = 7 UNION SELECT e.src FROM h JOIN e ON e.dst = h.node), a AS (SELECT p_partkey AS entry FROM part WHERE p_partkey IN (SELECT node FROM h))"
_HITS = ", c AS (SELECT p_size::BIGINT AS pr, p_partkey AS node FROM part WHERE p_size <= 10), h AS (SELECT pr, node FROM c UNION SELECT h.pr, e.src FROM h JOIN e ON e.dst = h.node), a AS (SELECT DISTINCT h.pr, p_partkey AS entry FROM part JOIN h ON h.node = p_partkey)"
_WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160) || chr(5760) || " + " || ".join(f"chr({c})" for c in range(0x2000, 0x200B)) + " || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"
_SYM = f""", ln AS (SELECT repo, path, unnest(string_split(content, chr(10))) AS text, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM f),
  s0 AS (SELECT repo, path, line, text, regexp_extract(text, {_q(cg.FUNCTION)}, 1) AS fn, regexp_extract(text, {_q(cg.CLASS)}, 1) AS cls, regexp_extract(text, {_q(cg.TYPE)}, 1) AS typ FROM ln),
  sy AS (SELECT repo, path, line, kind, name, starts_with(ltrim(text, {_WS}), 'pub') OR starts_with(ltrim(text, {_WS}), 'export') AS exported, trim(text, {_WS}) AS signature, ord FROM (
    SELECT *, 'fn' AS kind, fn AS name, 1 AS ord FROM s0 UNION ALL SELECT *, 'cls', cls, 2 FROM s0 UNION ALL SELECT *, 'type', CASE WHEN typ <> fn AND typ <> cls THEN typ ELSE '' END, 3 FROM s0) WHERE name <> ''),
  cs AS (SELECT * FROM (SELECT repo, path, line, unnest(regexp_extract_all(text, {_q(_CALL)}, 1)) AS name FROM ln) WHERE name NOT IN ({', '.join(map(_q, cg.NOT_CALLS))})),
  ce AS (SELECT DISTINCT c.repo, c.path, d.id AS "to", c.name FROM (SELECT DISTINCT repo, path, unnest(regexp_extract_all(content, {_q(_CALL)}, 1)) AS name FROM f) c JOIN (SELECT repo, path, name, arg_min(kind || ':' || name, line * 4 + ord) AS id FROM sy GROUP BY repo, path, name) d ON c.path = d.path AND c.name = d.name WHERE c.name NOT IN ({', '.join(map(_q, cg.NOT_CALLS))})),
  ev AS (SELECT repo, path, line, 0 AS o, name AS symbol, NULL::VARCHAR AS name FROM sy UNION ALL SELECT repo, path, line, 1, NULL::VARCHAR, name FROM cs),
  ao AS (SELECT *, last_value(symbol IGNORE NULLS) OVER (PARTITION BY repo, path ORDER BY line, o, symbol ROWS UNBOUNDED PRECEDING) AS caller FROM ev),
  ac AS (SELECT DISTINCT repo, path, caller, name FROM ao WHERE o = 1 AND (caller IS NULL OR caller <> name))"""
_P = f"WITH {fx.DIFFS_SQL}"
_SNAP = ", sn AS (SELECT 'r' || (doc_id // 1000) AS repo, 'src/m' || (doc_id % 4) || '/f' || doc_id || '.rs' AS path, text, strlen(text) AS size FROM documents)"
_HINTS = "map {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in tx.LANG_HINTS.items()) + "}"
_ENDS = "[" + ", ".join(map(_q, (*tx.LANG_HINTS, "RS", "txt", "lock"))) + "]"



def _cut(text: str, limit: int) -> str:
    """truncate_middle() in SQL: the most characters whose bytes fit, then to the line feeds."""
    half = limit // 2
    most = lambda side: f"{side}({text}, list_filter(range({half // 4}, {half + 1}), lambda n: strlen({side}({text}, n)) <= {half})[-1])"
    front, back = most("left"), most("right")
    head = f"CASE WHEN contains({front}, chr(10)) THEN regexp_extract({front}, '(?s)^(.*)\\n', 1) ELSE {front} END"
    tail = f"CASE WHEN contains({back}, chr(10)) THEN substr({back}, strpos({back}, chr(10)) + 1) ELSE {back} END"
    return f"CASE WHEN strlen({text}) <= {limit} THEN {text} ELSE {head} || chr(10) || '... [truncated ' || (strlen({text}) - strlen({head}) - strlen({tail})) || ' bytes — file too large] ...' || chr(10) || {tail} END"


# Files in order, one step of the fold for each.
_CH = f"""{_P.replace('WITH', 'WITH RECURSIVE', 1)}{_SNAP}, b AS (SELECT dp.pr, dp.pos, dp.path, is_new, is_deleted, is_pure_rename, additions, deletions, {_cut('piece', POLICY.file_bytes)} AS body, CASE WHEN NOT is_deleted THEN {_cut('text', POLICY.file_context_bytes)} END AS context,
    row_number() OVER (PARTITION BY dp.pr ORDER BY dp.pos) AS nth FROM dp LEFT JOIN sn ON sn.path = dp.path AND sn.repo = dp.repo WHERE n % 10 <> 0),
  z AS (SELECT DISTINCT pr, 0::BIGINT AS nth, 0::BIGINT AS chunk, 0::BIGINT AS bytes, 0::BIGINT AS used, false AS keep FROM b
    UNION ALL SELECT z.pr, b.nth, chunk + (b.nth > 1 AND bytes + strlen(body) + 1 > {POLICY.chunk_bytes})::INT,
      CASE WHEN b.nth > 1 AND bytes + strlen(body) + 1 > {POLICY.chunk_bytes} THEN strlen(body) ELSE bytes + strlen(body) + (bytes > 0)::INT END,
      CASE WHEN b.nth > 1 AND bytes + strlen(body) + 1 > {POLICY.chunk_bytes} THEN 0 WHEN used + strlen(context) <= {POLICY.chunk_context_bytes} THEN used + strlen(context) ELSE used END,
      coalesce(used + strlen(context) <= {POLICY.chunk_context_bytes}, false) FROM z JOIN b ON b.pr = z.pr AND b.nth = z.nth + 1),
  k AS (SELECT b.* EXCLUDE (nth, context), z.chunk AS chunk_idx, CASE WHEN keep THEN context END AS context FROM b JOIN z ON z.pr = b.pr AND z.nth = b.nth)"""
_RL = f"""{_P.replace('WITH', 'WITH RECURSIVE', 1)}{_SNAP}, c AS (SELECT repo, path, {_cut('text', POLICY.related_bytes)} AS content FROM sn),
  b AS (SELECT p.pr, c.path, content, row_number() OVER (PARTITION BY p.pr ORDER BY c.path) AS nth FROM (SELECT DISTINCT repo, pr FROM dp) p JOIN c ON c.repo = p.repo WHERE NOT EXISTS (SELECT 1 FROM dp WHERE dp.pr = p.pr AND dp.path = c.path)),
  z AS (SELECT DISTINCT pr, 0::BIGINT AS nth, 0::BIGINT AS used, false AS keep FROM b
    UNION ALL SELECT z.pr, b.nth, CASE WHEN used + strlen(content) <= {POLICY.chunk_related_bytes} THEN used + strlen(content) ELSE used END, used + strlen(content) <= {POLICY.chunk_related_bytes} FROM z JOIN b ON b.pr = z.pr AND b.nth = z.nth + 1)"""
_LINE = "regexp_replace(signature, '[ \\n\\r\\t]+', ' ', 'g')"
_SC = f"""{_F.replace('WITH', 'WITH RECURSIVE', 1)}{_SYM}, g AS (SELECT DISTINCT d.path, d.name, ac.path AS c_path, caller FROM (SELECT DISTINCT repo, path, name FROM sy) d JOIN ac ON ac.repo = d.repo AND ac.name = d.name WHERE NOT (ac.path = d.path AND caller IS NOT DISTINCT FROM d.name)),
  w AS (SELECT path, name, string_agg(c_path || coalesce('::' || caller, ''), ', ' ORDER BY c_path, caller NULLS FIRST) AS who FROM g GROUP BY path, name),
  it AS (SELECT DISTINCT repo, path, 0 AS k, chr(10) || path || ':' || chr(10) AS shown FROM sy UNION ALL
    SELECT sy.repo, sy.path, row_number() OVER (PARTITION BY sy.path ORDER BY line, ord), '  - ' || kind || ' ' || sy.name || ' (L' || line || ')' || CASE WHEN exported THEN ' [pub]' ELSE '' END
      || CASE WHEN signature = '' THEN '' ELSE ' `' || CASE WHEN strlen({_LINE}) > 240 THEN left({_LINE}, 237) || '…' ELSE {_LINE} END || '`' END || chr(10) || coalesce('    called by: ' || who || chr(10), '') FROM sy LEFT JOIN w ON w.path = sy.path AND w.name = sy.name),
  b AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path, k) AS nth, strlen(shown) AS size FROM it),
  z AS (SELECT DISTINCT repo, 0::BIGINT AS nth, 0::BIGINT AS used, false AS op, false AS keep, 0::BIGINT AS elided FROM b
    UNION ALL SELECT z.repo, b.nth, CASE WHEN used + size <= 4096 AND (k = 0 OR op) THEN used + size ELSE used END, CASE WHEN k = 0 THEN used + size <= 4096 ELSE op END, used + size <= 4096 AND (k = 0 OR op), elided + (k > 0 AND NOT (used + size <= 4096 AND op))::INT FROM z JOIN b ON b.repo = z.repo AND b.nth = z.nth + 1),
  e AS (SELECT repo, max(elided) AS elided FROM z GROUP BY repo)"""

ORACLE_SQL = {
    "pack_chunks": f"{_CH} SELECT pr, pos, path, chunk_idx, md5(body) AS body, md5(context) AS context FROM k",
    "chunk_inventory": f"{_CH} SELECT pr, chunk_idx, count(*) AS files, count(*) FILTER (WHERE is_new) AS \"new\", count(*) FILTER (WHERE is_deleted) AS deleted, count(*) FILTER (WHERE is_pure_rename) AS renamed, sum(additions) AS additions, sum(deletions) AS deletions, sum(strlen(body)) + count(*) - 1 AS bytes, coalesce(sum(strlen(context)), 0) AS context_bytes FROM k GROUP BY pr, chunk_idx",
    "pack_related": f"{_RL} SELECT b.pr, path, md5(content) AS content FROM b JOIN z ON z.pr = b.pr AND z.nth = b.nth WHERE keep",
    "scope_rows": f"{_SC} SELECT b.repo, string_agg(shown, '' ORDER BY b.nth) || CASE WHEN e.elided > 0 THEN chr(10) || '… [+' || e.elided || ' more entries elided to stay under 4096 bytes]' || chr(10) ELSE '' END AS block, e.elided FROM b JOIN z ON z.repo = b.repo AND z.nth = b.nth JOIN e ON e.repo = b.repo WHERE keep GROUP BY b.repo, e.elided",
    "import_specifiers": f"{_F}{_SPECS} SELECT path, spec FROM sp",
    "relative_imports": f"{_F}{_SPECS} SELECT path, spec FROM sp WHERE starts_with(spec, './') OR starts_with(spec, '../') OR (language = 'ts' AND (spec IN ('.', '..') OR starts_with(spec, '/')))",
    "import_edges": f"{_F} SELECT a.repo, a.path AS src, b.path AS dst FROM f a JOIN f b ON b.i IN (a.i + 3, a.i + 6) AND a.repo = b.repo WHERE a.i % 3 IN (0, 2)",
    "reachable": f"{_E}, r AS (SELECT p_partkey AS entry, p_partkey AS node FROM part UNION SELECT r.entry, e.dst FROM r JOIN e ON e.src = r.node) SELECT entry, node FROM r",
    "affected_entries": f"{_E}{_HIT} SELECT entry FROM a",
    "affected_in_reviews": f"{_E}{_HITS} SELECT pr, entry FROM a",
    "scope_of_reviews": f"{_E}{_HITS}, r AS (SELECT DISTINCT pr FROM c), x AS (SELECT pr, 'changed' AS role, node AS path FROM c UNION ALL SELECT pr, 'ran', entry FROM a UNION ALL SELECT r.pr, 'skipped', p_partkey FROM part, r WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.pr = r.pr AND a.entry = p_partkey)) SELECT pr, role, count(*) AS files, sum(path)::BIGINT AS paths FROM x GROUP BY pr, role",
    "scope_files": f"{_E}{_HIT} SELECT 'changed' AS role, p_partkey AS path FROM part WHERE p_size = 7 UNION ALL SELECT 'ran', entry FROM a UNION ALL SELECT 'skipped', p_partkey FROM part WHERE p_partkey NOT IN (SELECT entry FROM a)",
    "glob_filter": f"{_F} SELECT path FROM f WHERE regexp_matches(path, '^.*doc_1[^/]*\\.ts$') OR regexp_matches(path, '^s/doc_[^/][^/]\\.rs$')",
    "discover_entries": f"{_F} SELECT regexp_replace(path, '\\.ts$', '.bench.ts') AS path FROM f WHERE i % 3 = 0 AND i % 2 = 1",
    "changed_files": "SELECT DISTINCT path FROM (SELECT trim(url) AS path FROM pages UNION ALL SELECT 'b/' || (page_id % 5) FROM pages UNION ALL SELECT 'extra.rs') WHERE path <> ''",
    "languages": f"{_F}, e AS (SELECT path || '.' || ({_ENDS})[i % len({_ENDS}) + 1] AS path, ({_ENDS})[i % len({_ENDS}) + 1] AS ext FROM f) SELECT path, CASE lower(ext) WHEN 'ts' THEN 'ts' WHEN 'tsx' THEN 'ts' WHEN 'js' THEN 'ts' WHEN 'mjs' THEN 'ts' WHEN 'cjs' THEN 'ts' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' END AS language, coalesce({_HINTS}[ext], '') AS hint FROM e",
    "extract_symbols": f"{_F}{_SYM} SELECT repo, path, line, kind, name, exported, signature FROM sy",
    "attribute_calls": f"{_F}{_SYM} SELECT path, caller, name FROM ac",
    "callers": f"{_F}{_SYM}, g AS (SELECT DISTINCT d.repo, d.path, d.name, ac.path AS c_path, caller FROM (SELECT DISTINCT repo, path, name FROM sy) d JOIN ac ON ac.repo = d.repo AND ac.name = d.name WHERE NOT (ac.path = d.path AND caller IS NOT DISTINCT FROM d.name)) SELECT repo, path, name, string_agg(c_path || '::' || coalesce(caller, ''), ',' ORDER BY c_path, caller NULLS FIRST) AS called_by FROM g GROUP BY repo, path, name",
    "extract_imports": f"{_F}, g AS (SELECT path, " + ", ".join(f"regexp_extract_all(content, {_q(cg.IMPORT)}, {k}) AS g{k}" for k in range(1, 5)) + f" FROM f), m AS (SELECT path, list_filter(list_transform(range(1, len(g1) + 1), lambda k: trim(concat(g1[k], g2[k], g3[k], g4[k]), {_WS})), lambda x: x <> '') AS l FROM g), d AS (SELECT path, list_filter(l, lambda x, k: list_position(l, x) = k) AS l FROM m) SELECT path, array_to_string(l, '|') AS imports, array_to_string(list_filter(l, lambda x: starts_with(x, './') OR starts_with(x, '../')), '|') AS local FROM d",
    "call_edges": f"{_F}{_SYM} SELECT path, \"to\" FROM ce",
    "called_names": f"{_F}{_SYM} SELECT path, string_agg(DISTINCT regexp_replace(\"to\", '^[a-z]+:', ''), '|' ORDER BY regexp_replace(\"to\", '^[a-z]+:', '')) AS names FROM ce GROUP BY path",
    "diff_files": f"{_P} SELECT repo, pr, pos, path, is_new, is_deleted, is_pure_rename, additions, deletions, md5(piece) AS body FROM dp",
    "filter_ignored": f"{_P} SELECT pr, path, n % 10 <> 0 AS kept FROM dp",
    "attach_context": f"{_P}{_SNAP} SELECT pr, dp.path, CASE WHEN NOT is_deleted THEN md5(text) END AS context FROM dp LEFT JOIN sn ON dp.path = sn.path AND dp.repo = sn.repo WHERE n % 10 <> 0",
    "related_files": f"{_P}{_SNAP} SELECT p.pr, sn.path, size FROM (SELECT DISTINCT repo, pr FROM dp) p JOIN sn ON sn.repo = p.repo WHERE NOT EXISTS (SELECT 1 FROM dp WHERE dp.pr = p.pr AND dp.path = sn.path)",
}
