"""Graphs of any depth: components, labels spread against the edges, and pointers followed, in logarithmically many rounds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..llm._components import components as least_around
from ..sources.shared import settled

#: Jumps of a length are found while there are at most so many times as many of them as edges.
JUMPS = 8
#: Rounds after which what was written in each is put together as one table.
COMPACT = 8
#: A part of a graph with up to so many edges and seeds is spread over within a task, with others of about TOGETHER rows in all.
SMALL, TOGETHER = 1000, 20_000


def _same(keys: list[str], left: str, right: str, **pairs: str) -> Column:
    """Equality of aliased tables' keys, nulls alike, and of the columns named."""
    tests = [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys] + [F.col(f"{left}.{a}") == F.col(f"{right}.{b}") for a, b in pairs.items()]
    return reduce(lambda a, b: a & b, tests)


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b; numbers): root is the least node of its component.

    In turns, a node's neighbours above it, then those below it, are linked to the least one around it, until nothing
    changes. No neighbourhood is gathered: each turn takes a minimum and a join. Loops and repeats change nothing.
    """
    now = settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
        seen = state
        both = now.union(now.select("b", "a"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("low"))
        above = both.join(least, F.col("a") == F.col("node")).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        below = above.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        linked = above.join(below, F.col("a") == F.col("node"))
        now = settled(linked.select("b", "low").union(linked.select("a", "low")).toDF("a", "b").where("a <> b").distinct(), "links")


def follow(pointers: DataFrame, keys: list[str], start: DataFrame) -> DataFrame:
    """keys, node, rank: what each start (keys, node) comes to over pointers (keys, node, to; one a node), itself at rank 0.

    Pointers are doubled: a round knows all within twice as many steps as the one before. Pointers must not lead in a circle.
    """
    found = start.select(*keys, "node", F.lit(0).cast("bigint").alias("rank"))
    step, jump = 1, settled(pointers.select(*keys, "node", "to"), "pointers")
    while not jump.isEmpty():
        on = _same(keys, "f", "j", node="node")
        beyond = found.alias("f").join(jump.alias("j"), on).select(*[F.col(f"f.{k}").alias(k) for k in keys], F.col("j.to").alias("node"), (F.col("f.rank") + step).alias("rank"))
        found = settled(found.unionByName(beyond), "found")
        ahead = jump.alias("a").join(jump.alias("b"), _same(keys, "a", "b", to="node"))
        jump = settled(ahead.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.node").alias("node"), F.col("b.to").alias("to")), "pointers")
        step *= 2
    return found


def _or(labels: DataFrame, keys: list[str]) -> DataFrame:
    return labels.groupBy(*keys, "node", "word").agg(F.bit_or("bits").alias("bits"))


def _taken(edges: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """What the edges' sources take from the labels of their targets."""
    return edges.alias("e").join(labels.alias("l"), _same(keys, "e", "l", dst="node")).select(*[F.col(f"e.{k}").alias(k) for k in keys], F.col("e.src").alias("node"), F.col("l.word").alias("word"), F.col("l.bits").alias("bits"))


def _collapse(edges: DataFrame, labels: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, labels, ends): nodes with one target only are taken out, and circles of such nodes with them.

    Their pointers are doubled until they lead to a node with more or no targets, or all of a circle has been gone over, while
    the labels on the way are gathered. ends: keys, node, to (null: nothing beyond) of those taken out, whose labels then
    hold all that is on their way.
    """
    single = edges.groupBy(*keys, "src").agg(F.count(F.lit(1)).alias("n"), F.first("dst").alias("to")).where("n = 1")
    ends = settled(single.select(*keys, F.col("src").alias("node"), "to"), "ends")
    if ends.isEmpty():
        return edges, labels, ends
    # Gathered: what stands on the way from a node up to, but without, where its pointer leads.
    gathered = settled(_or(labels.alias("l").join(ends.alias("e"), _same(keys, "l", "e", node="node"), "left_semi"), keys), "gathered")
    before = None
    while True:
        # Fewer pointers lead on after each round while any chain isn't at its end, and more is gathered while any circle isn't gone
        # over; where neither is so, what leads on leads into circles.
        leading_on = ends.alias("a").join(ends.alias("b"), _same(keys, "a", "b", to="node"), "left_semi").count()
        state = (leading_on, gathered.agg(F.sum(F.bit_count("bits"))).first()[0])
        if not leading_on or state == before:
            break
        before = state
        on_way = _taken(ends.select(*keys, F.col("node").alias("src"), F.col("to").alias("dst")), gathered, keys)
        gathered = settled(_or(gathered.unionByName(on_way), keys), "gathered")
        ahead = ends.alias("a").join(ends.alias("b"), _same(keys, "a", "b", to="node"), "left")
        ends = settled(ahead.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.node").alias("node"), F.coalesce("b.to", "a.to").alias("to")), "ends")
    inner = ends.alias("e").join(ends.alias("x"), _same(keys, "e", "x", to="node"), "left")
    ends = settled(inner.select(*[F.col(f"e.{k}").alias(k) for k in keys], F.col("e.node").alias("node"), F.when(F.col("x.node").isNull(), F.col("e.to")).alias("to")), "ends")
    rest = edges.alias("e").join(ends.alias("x"), _same(keys, "e", "x", src="node"), "left_anti")
    through = _taken(rest, gathered, keys)
    led = rest.alias("e").join(ends.alias("x"), _same(keys, "e", "x", dst="node"), "left")
    target = F.when(F.col("x.node").isNull(), F.col("e.dst")).otherwise(F.col("x.to"))
    edges = led.select(*[F.col(f"e.{k}").alias(k) for k in keys], F.col("e.src").alias("src"), target.alias("dst")).where("dst IS NOT NULL AND src <> dst").distinct()
    own = labels.alias("l").join(ends.alias("x"), _same(keys, "l", "x", node="node"), "left_anti")
    return settled(edges, "edges"), settled(_or(own.unionByName(through).unionByName(gathered), keys), "labels"), ends


def _jumps(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges, and where walks of 2, 4, 8, .. edges lead, while these aren't many more than edges."""
    size = edges.count()
    found, last, length = [edges], edges, 1
    while size and length < size:
        joined = last.alias("a").join(last.alias("b"), _same(keys, "a", "b", dst="src"))
        ways = joined.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        # Counted before they are made: a node's ways in times its ways out.
        into = last.groupBy(*keys, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"))
        out = last.groupBy(*keys, F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("m"))
        expected = into.alias("i").join(out.alias("o"), _same(keys, "i", "o", node="node")).agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0
        if expected > JUMPS * JUMPS * size:
            break
        last = settled(ways.distinct(), "jumps")
        n = last.count()
        if not n or n > JUMPS * size:
            break
        found.append(last)
        length *= 2
    return reduce(DataFrame.unionByName, found).distinct()


def parted(edges: DataFrame, keys: list[str]) -> DataFrame:
    """code, part of each node of edges (keys, src, dst): nodes that edges join, whichever way, are of one part.

    Nodes are told apart by 64-bit hashes here. If two hash alike, their parts count as one, which only makes it larger.
    """
    ends = edges.select(F.xxhash64(*keys, "src").alias("a"), F.xxhash64(*keys, "dst").alias("b"))
    return least_around(ends).select(F.col("node").alias("code"), F.col("root").alias("part"))


def with_part(rows: DataFrame, node: str, keys: list[str], parts: DataFrame) -> DataFrame:
    """rows with the part of their node; a node without edges is a part of its own."""
    coded = rows.withColumn("_code", F.xxhash64(*keys, node)).join(parts, F.col("_code") == F.col("code"), "left")
    return coded.withColumn("part", F.coalesce("part", "_code")).drop("_code", "code")


def _whole(batches: Iterator) -> Iterator:
    """Tables of whole parts, from batches in order of part."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size > TOGETHER:
            table = pa.Table.from_batches(held)
            part = table.column("part").to_numpy()
            cut = int(np.searchsorted(part, part[-1]))
            if cut:
                yield table.slice(0, cut)
            held, size = table.slice(cut).to_batches(), len(part) - cut
    if size:
        yield pa.Table.from_batches(held)


def _alike(columns: list) -> np.ndarray:
    """A number for each row: the same for rows that are alike in all columns, nulls too."""
    out = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        code = column.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
        out = np.unique(out * (code.max(initial=0) + 1) + code, return_inverse=True)[1]
    return out


def _told(table, keys: list[str]) -> tuple[np.ndarray, ...]:
    """(row of a node's name, whether that is its dst, part's row, word, bits): all that nodes of whole parts have or are led to."""
    import pyarrow as pa

    of = lambda name: pa.concat_arrays(table.column(name).chunks)
    is_edge = table.column("word").is_null().to_numpy()
    edge, seed = np.flatnonzero(is_edge), np.flatnonzero(~is_edge)
    if not len(seed):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    rows = np.concatenate([np.arange(len(is_edge)), edge])
    names = pa.concat_arrays([of("src"), of("dst").take(pa.array(edge))])
    _, named, node = np.unique(_alike([*(of(k).take(pa.array(rows)) for k in keys), names]), return_index=True, return_inverse=True)
    part = np.unique(of("part").to_numpy(), return_inverse=True)[1]
    words, word = np.unique(of("word").take(pa.array(seed)).to_numpy(), return_inverse=True)
    # Every node has a place for each word that a seed of its part has.
    kinds, kind = np.unique(part[seed] * len(words) + word, return_inverse=True)
    n = np.bincount(kinds // len(words), minlength=part[-1] + 1)
    first = np.cumsum(n) - n
    each = n[part[rows[named]]]
    begin = np.cumsum(each) - each
    bits = np.zeros(each.sum(), np.int64)
    np.bitwise_or.at(bits, begin[node[seed]] + kind - first[part[seed]], of("bits").take(pa.array(seed)).to_numpy())
    many = n[part[edge]]
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    to, come, kind = (np.repeat(x, many) + nth for x in (begin[node[edge]], begin[node[len(is_edge) :]], first[part[edge]]))
    while len(to):
        new = bits[come] & ~bits[to]
        some = np.flatnonzero(new)
        np.bitwise_or.at(bits, to[some], new[some])
        # Where a word has changed nowhere in a part, it is done.
        going = np.zeros(len(kinds), bool)
        going[kind[some]] = True
        to, come, kind = (x[going[kind]] for x in (to, come, kind))
    found = np.flatnonzero(bits)
    node = np.repeat(np.arange(len(each)), each)[found]
    at = first[part[rows[named]]][node] + found - begin[node]
    return named[node], rows[named][node], words[kinds[at] % len(words)], bits[found]


def _within(edges: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, word, bits of parts (a column) that are small: each is gone over to its end within a task."""
    named = [k for k in keys if k != "part"]
    none = F.lit(None).cast("bigint")
    ways = edges.select("part", *named, "src", "dst", none.alias("word"), none.alias("bits"))
    rows = ways.unionByName(labels.select("part", *named, F.col("node").alias("src"), F.lit(None).cast(dict(ways.dtypes)["dst"]).alias("dst"), "word", "bits"))
    fields = {f.name: f for f in rows.schema}
    schema = StructType([*(fields[k] for k in keys), *StructType().add("node", fields["src"].dataType), *(fields[c] for c in ("word", "bits"))])

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for table in _whole(batches):
            name, row, word, bits = _told(table, named)
            if len(name):
                is_edge = np.flatnonzero(table.column("word").is_null().to_numpy())
                names = pa.concat_arrays([*table.column("src").chunks, *table.column("dst").take(pa.array(is_edge)).chunks])
                columns = [*(pa.concat_arrays(table.column(k).chunks).take(pa.array(row)) for k in keys), names.take(pa.array(name)), pa.array(word), pa.array(bits)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(work, schema)


def spread(edges: DataFrame, seeds: DataFrame, keys: list[str] = ()) -> DataFrame:
    """keys, node, word, bits: every node's own bits and those of all nodes that edges (keys, src, dst) lead it to.

    seeds: keys, node, word, bits: a node's set, 64 numbers to a word. One spread serves all numbers at once. If edges and
    seeds have the part of their nodes (see parted), it is one of the keys; else it is found here.

    Parts of up to SMALL edges and seeds are gone over within tasks, many at once; larger ones by rounds over their tables.
    """
    keys = list(keys)
    edges = edges.select(*keys, "src", "dst").where("src <> dst").distinct()
    labels = _or(seeds.select(*keys, "node", "word", "bits"), keys)
    if "part" not in keys:
        edges, labels = settled(edges, "edges"), settled(labels, "labels")
        parts = parted(edges, keys)
        edges, labels = with_part(edges, "src", keys, parts), with_part(labels, "node", keys, parts)
    edges, labels = settled(edges, "edges"), settled(labels, "labels")
    # Few: each has over SMALL rows of its own.
    large = settled(edges.select("part").unionAll(labels.select("part")).groupBy("part").count().where(F.col("count") > SMALL).select("part"), "large")
    if large.isEmpty():
        return _within(edges, labels, keys)
    of = lambda rows, how: rows.join(F.broadcast(large), "part", how)
    by_rounds = _by_rounds(of(edges, "left_semi").select(*keys, "src", "dst"), of(labels, "left_semi").select(*keys, "node", "word", "bits"), keys)
    return _within(of(edges, "left_anti"), of(labels, "left_anti"), keys).unionByName(by_rounds)


def _by_rounds(edges: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, word, bits as spread() gives them, of any graph; edges and labels are distinct.

    Nodes with one target are taken out first, by doubling pointers, so that plain chains and circles, however long, cost
    a logarithm of rounds. Over what is left, edges are extended by jumps over 2, 4, 8, .. of them, as long as there are
    few; then only new bits are handed on, round by round, until there are none: there is no limit of rounds.
    """
    edges, labels = settled(edges, "edges"), settled(labels, "labels")
    core, labels, ends = _collapse(edges, labels, keys)
    if not core.isEmpty():
        jumps = settled(_jumps(core, keys), "jumps")
        fresh = labels
        turn = 0
        while not fresh.isEmpty():
            told = _or(_taken(jumps, fresh, keys), keys)
            both = told.alias("t").join(_or(labels, keys).alias("l"), _same(keys, "t", "l", node="node", word="word"), "left")
            news = both.select(*[F.col(f"t.{k}").alias(k) for k in keys], F.col("t.node").alias("node"), F.col("t.word").alias("word"), F.col("t.bits").bitwiseAND(F.bitwise_not(F.coalesce("l.bits", F.lit(0).cast("bigint")))).alias("bits"))
            fresh = settled(news.where("bits <> 0"), "fresh")
            labels, turn = labels.unionByName(fresh), turn + 1
            if turn % COMPACT == 0:
                labels = settled(_or(labels, keys), "labels")
        labels = _or(labels, keys)
    # What was taken out has what is on its way and what its end has.
    beyond = _taken(ends.where("to IS NOT NULL").select(*keys, F.col("node").alias("src"), F.col("to").alias("dst")), labels, keys)
    return _or(labels.unionByName(beyond), keys)


def numbered(df: DataFrame, keys: list[str], of: list[str]) -> DataFrame:
    """df's distinct (keys, of) with word and bits, the place of each in a set of its key's; to be settled, as other runs may number otherwise.

    Rows are numbered in order, range by range, so that no task has all of a key's. Numbers have gaps between ranges.
    """
    ordered = df.select(*keys, *of).distinct().repartitionByRange(*keys, *of).sortWithinPartitions(*keys, *of)
    return ordered.withColumn("_n", F.monotonically_increasing_id()).select(*keys, *of, F.expr("_n div 64").alias("word"), F.expr("shiftleft(1L, CAST(_n % 64 AS INT))").alias("bits"))
