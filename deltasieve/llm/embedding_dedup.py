"""Near-duplicate embeddings by an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import partitions, stash
from ._components import components

#: Vectors in an interval of the sequence, and in the intervals at which the recursion inside a task ends.
INTERVAL, LEAF = 4096, 256
#: Leading principal dimensions of the grid.
DIMENSIONS = 8
#: Slack of the bounds and of single precision; whatever falls in it is decided in double precision.
SLACK = 1e-4


def _unit(column) -> tuple[list, list]:
    """(bytes of the double-precision unit vector, its length) of each row of a list column; two nulls if unusable."""
    import pyarrow.compute as pc

    width = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component is no number
    begin = np.concatenate([[0], np.cumsum(width)])[:-1]
    units: list = [None] * len(width)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        x = values[begin[rows][:, None] + np.arange(w)]
        largest = np.abs(x).max(axis=1)
        rows, x, largest = (v[np.isfinite(largest) & (largest > 0)] for v in (rows, x, largest))
        x = x / np.exp2(np.frexp(largest)[1] - 1.0)[:, None]  # a power of two: exact, and squares stay in range
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        for i, row in zip(rows.tolist(), x, strict=True):
            units[i] = row.tobytes()
    return units, [None if u is None else len(u) // 8 for u in units]


def units(vectors: DataFrame) -> DataFrame:
    """vec_id, unit (bytes of doubles) and width; unit is null for a vector that is null, empty, zero, or not finite throughout."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            unit, width = _unit(batch.column("embedding"))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(unit, pa.binary()), pa.array(width, pa.int32())], ["vec_id", "unit", "width"])

    plain = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return plain.mapInArrow(work, "vec_id bigint, unit binary, width int")


def principal(classes: DataFrame, width: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The leading principal directions [width, dimensions] of all vectors of this width; the driver gets sums alone."""

    def moments(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n, total = 0, np.zeros((width + 1, width))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                x = np.stack([np.frombuffer(b) for b in batch.column("unit").slice(at, 1000).to_pylist()])
                n, total = n + len(x), total + np.concatenate([x.T @ x, x.sum(axis=0)[None]])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "sums"])

    def added(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n, total = 0, 0.0
        for batch in batches:
            for k, sums in zip(batch.column("n").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                n, total = n + k, total + np.frombuffer(sums)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "sums"])

    schema = "n bigint, sums binary"
    parts = classes.where(F.col("width") == width).select("unit").mapInArrow(moments, schema).repartition(8).mapInArrow(added, schema).collect()
    n, sums = sum(p["n"] for p in parts), sum(np.frombuffer(p["sums"]) for p in parts).reshape(width + 1, width)
    mean = sums[width] / n
    spread = (sums[:width] - n * np.outer(mean, mean)) / max(1, n - 1)
    values, directions = np.linalg.eigh(spread)
    return np.ascontiguousarray(directions[:, np.argsort(-values)[:dimensions]])


def grid_order(classes: DataFrame, directions: np.ndarray, epsilon: float) -> DataFrame:
    """at (place in the sequence), rep, n, unit, lead: vectors in the order of their grid cells, cell by cell.

    A cell has sides of epsilon in the principal dimensions; vectors of a cell are in order of their first coordinate.
    """
    spark = classes.sparkSession

    def project(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = np.stack([np.frombuffer(b) for b in batch.column("unit").to_pylist()]) if batch.num_rows else np.zeros((0, len(directions)))
            lead = x @ directions
            cell = np.floor(lead / epsilon).astype(int)
            # Cell numbers as one text that sorts as they do: each is offset to be positive.
            names = [".".join(f"{c + 500:03d}" for c in row) for row in cell.tolist()]
            columns = [pa.array(names, pa.string()), pa.array(lead[:, 0]), pa.array([row.tobytes() for row in lead], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "n", "unit")), *columns], ["rep", "n", "unit", "cell", "first", "lead"])

    placed = classes.select("rep", "n", "unit").mapInArrow(project, "rep bigint, n bigint, unit binary, cell string, first double, lead binary")
    parts = partitions(spark)
    ranged = placed.repartitionByRange(parts, "cell", "first", "rep").sortWithinPartitions("cell", "first", "rep")

    def number(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, i = TaskContext.get().partitionId(), 0
        for batch in batches:
            place = pa.array(np.arange(i, i + batch.num_rows, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, part, np.int32)), place, *(batch.column(c) for c in ("rep", "n", "unit", "lead"))], ["part", "i", "rep", "n", "unit", "lead"])
            i += batch.num_rows

    rows = stash(ranged.mapInArrow(number, "part int, i bigint, rep bigint, n bigint, unit binary, lead binary"), "sequence")
    # One number for each partition, so the table of offsets has a row for each shuffle partition.
    offsets, total = [], 0
    for row in rows.groupBy("part").count().orderBy("part").collect():
        offsets.append((row["part"], total))
        total += row["count"]
    table = spark.createDataFrame(offsets, "part int, offset bigint")
    return rows.join(F.broadcast(table), "part").select((F.col("i") + F.col("offset")).alias("at"), "rep", "n", "unit", "lead")


def intervals(sequence: DataFrame, size: int = INTERVAL) -> DataFrame:
    """block, ids, counts, units (bytes), low, high: size consecutive vectors in a row, with their bounds."""

    def pack(key, table):
        import pyarrow as pa

        table = table.sort_by("at")
        lead = np.stack([np.frombuffer(b) for b in table.column("lead").to_pylist()])
        blob = b"".join(table.column("unit").to_pylist())
        cells = [pa.array([key[0].as_py()], pa.int64()), *(pa.array([table.column(c).to_numpy().astype(np.int64).tobytes()], pa.binary()) for c in ("rep", "n")), pa.array([blob], pa.binary())]
        bounds = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (lead.min(axis=0), lead.max(axis=0))]
        return pa.Table.from_arrays([*cells, *bounds], ["block", "ids", "counts", "units", "low", "high"])

    blocks = sequence.withColumn("block", F.floor(F.col("at") / size)).groupBy("block")
    return blocks.applyInArrow(pack, "block bigint, ids binary, counts binary, units binary, low array<double>, high array<double>")


def near_intervals(blocks: DataFrame, epsilon: float) -> DataFrame:
    """Pairs (x, y), x <= y, of intervals that aren't provably further apart than epsilon.

    From the whole sequence joined with itself, each pair of intervals is halved into up to four, and those whose
    bounds are over epsilon apart are skipped, down to single blocks.
    """
    bounds = blocks.select(F.col("block").alias("b"), "low", "high")
    count = (bounds.agg(F.max("b")).first()[0] or 0) + 1
    depth = max(0, int(count - 1).bit_length())
    axes = range(len(blocks.select("low").first()["low"]))
    of_level = bounds.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("b", F.expr("shiftright(b, level)"))
    least, most = (F.array(*[f(F.col(c)[k]) for k in axes]).alias(c) for f, c in ((F.min, "low"), (F.max, "high")))
    levels = stash(of_level.groupBy("level", "b").agg(least, most), "bounds")
    wider = [levels.where(F.col("level") == level).select("b", "low", "high") for level in range(depth + 1)]
    pairs = wider[depth].select(F.col("b").alias("x"), F.col("b").alias("y"))
    for level in reversed(range(depth)):
        halves = pairs.withColumn("p", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("q", F.explode(F.array(F.lit(0), F.lit(1))))
        halves = halves.select((F.col("x") * 2 + F.col("p")).alias("x"), (F.col("y") * 2 + F.col("q")).alias("y")).where("x <= y")
        left, right = (wider[level].select(F.col("b").alias(n), F.col("low").alias(f"low_{n}"), F.col("high").alias(f"high_{n}")) for n in ("x", "y"))
        both = halves.join(left, "x").join(right, "y")
        apart = F.zip_with(F.zip_with("low_x", "high_y", lambda a, b: a - b), F.zip_with("low_y", "high_x", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
        distance = F.aggregate(apart, F.lit(0.0), lambda s, d: s + d * d)
        pairs = both.where(distance <= epsilon * epsilon + SLACK).select("x", "y")
        if level % 4 == 0:
            pairs = stash(pairs, "interval-pairs")
    return pairs


def _compare(x: np.ndarray, y: np.ndarray, lead_x: np.ndarray, lead_y: np.ndarray, epsilon: float, cosine: float, same: bool):
    """Index pairs (i, j) of linked rows, interval by interval: the recursion's last levels, inside a task."""

    def boxes(lead: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        return [(i, min(i + LEAF, len(lead)), lead[i : i + LEAF].min(axis=0), lead[i : i + LEAF].max(axis=0)) for i in range(0, len(lead), LEAF)]

    fast_x, fast_y = x.astype(np.float32), y.astype(np.float32)
    for a, b, low_a, high_a in boxes(lead_x):
        for c, d, low_c, high_c in boxes(lead_y):
            if same and c < a:
                continue
            gap = np.maximum(0, np.maximum(low_a - high_c, low_c - high_a))
            if (gap * gap).sum() > epsilon * epsilon + SLACK:
                continue
            i, j = np.nonzero(fast_x[a:b] @ fast_y[c:d].T >= cosine - SLACK)
            if same and a == c:
                i, j = i[i < j], j[i < j]
            if len(i):
                for at in range(0, len(i), 100_000):
                    p, q = i[at : at + 100_000] + a, j[at : at + 100_000] + c
                    exact = np.einsum("nd,nd->n", x[p], y[q]) >= cosine
                    yield p[exact], q[exact]


def links(blocks: DataFrame, directions: np.ndarray, cosine: float) -> DataFrame:
    """Rows (a, b, n) from every pair of near intervals: n of class a's links if b is null, else a link that connects.

    A class's links within a pair of intervals are counted, and only a forest of them is passed on.
    """
    epsilon = float(np.sqrt(2 - 2 * cosine))
    width = len(directions)
    pairs = near_intervals(blocks, epsilon)
    data = blocks.select("block", "ids", "counts", "units")
    one = data.toDF("x", "ids_x", "counts_x", "units_x")
    two = data.toDF("y", "ids_y", "counts_y", "units_y")
    joined = pairs.join(one, "x").join(two, "y")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                cell = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                (ids, counts), (ids_y, counts_y) = ((np.frombuffer(cell[f"ids_{s}"], np.int64), np.frombuffer(cell[f"counts_{s}"], np.int64)) for s in "xy")
                x, y = (np.frombuffer(cell[f"units_{s}"]).reshape(-1, width) for s in "xy")
                same = cell["x"] == cell["y"]
                if same:
                    ids_y, counts_y, y = ids, counts, x
                found_x, found_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
                root = np.arange(len(x) + (0 if same else len(y)))
                shift = 0 if same else len(x)
                kept = []
                for i, j in _compare(x, y, x @ directions, y @ directions, epsilon, cosine, same):
                    np.add.at(found_x, i, counts_y[j])
                    np.add.at(found_x if same else found_y, j, counts[i])
                    while True:  # a link between different trees joins them; others add nothing
                        p, q = root[i], root[j + shift]
                        new = p != q
                        if not new.any():
                            break
                        i, j, p, q = i[new], j[new], p[new], q[new]
                        high, low = np.maximum(p, q), np.minimum(p, q)
                        last = np.full(len(root), -1)
                        last[high] = np.arange(len(high))
                        pick = last[last >= 0]
                        root[high[pick]] = low[pick]
                        kept.append((ids[i[pick]], ids_y[j[pick]]))
                        while (root[root] != root).any():
                            root = root[root]
                a = [ids[found_x > 0], *([] if same else [ids_y[found_y > 0]])]
                n = [found_x[found_x > 0], *([] if same else [found_y[found_y > 0]])]
                a, n = np.concatenate(a), np.concatenate(n)
                e, f = (np.concatenate([k[s] for k in kept] + [np.zeros(0, np.int64)]) for s in (0, 1))
                null = np.concatenate([np.ones(len(a), bool), np.zeros(len(e), bool)])
                columns = [pa.array(np.concatenate([a, e])), pa.array(np.concatenate([np.zeros(len(a), np.int64), f]), mask=null), pa.array(np.concatenate([n, np.zeros(len(e), np.int64)]))]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "n"])

    return joined.mapInArrow(work, "a bigint, b bigint, n bigint")


def near_vectors(vectors: DataFrame, cosine: float = 0.9, interval: int = INTERVAL) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors, by cosine in double precision.

    Equal vectors are one class, whose members link with each other and share all links; only classes are compared,
    every one with every other that isn't provably too far off. A vector that is null, empty, zero, or has a null or
    non-finite component links with nothing. Vectors of different lengths do not link. A row with a null vec_id is
    a vector like others; it names no component, and is kept only if no row of its component has a vec_id. Rows that
    repeat a vec_id are vectors of their own. Labels and other columns play no part; an empty table gives no rows.
    """
    rows = stash(units(vectors), "units")
    # Copies meet in the partial aggregates before the shuffle. A class is named by a number of its own, written with it.
    grouped = rows.where("unit IS NOT NULL").groupBy(F.xxhash64("unit").alias("h"), "unit", "width").agg(F.min("vec_id").alias("vec"), F.count(F.lit(1)).alias("n"))
    classes = stash(grouped.withColumn("rep", F.monotonically_increasing_id()), "classes")
    found = None
    for width in sorted(r["width"] for r in classes.select("width").distinct().collect()):
        of_width = classes.where(F.col("width") == width)
        directions = principal(of_width, width)
        epsilon = float(np.sqrt(2 - 2 * cosine))
        blocks = stash(intervals(grid_order(of_width, directions, epsilon), interval), "intervals")
        some = links(blocks, directions, cosine)
        found = some if found is None else found.unionByName(some)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = stash(found, "links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    roots = components(found.where("b IS NOT NULL").select("a", "b")).withColumnsRenamed({"node": "rep"})
    rooted = classes.join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = rooted.groupBy("root").agg(F.min("vec").alias("component_id"))
    named = rooted.join(counts, "rep", "left").join(least, "root")
    named = named.select("h", "unit", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id")
    out = rows.withColumn("h", F.xxhash64("unit")).join(named, ["h", "unit"], "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), own.alias("component_id"), own.eqNullSafe(F.col("vec_id")).alias("kept"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector, by near_vectors() at a cosine of 0.9."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS n, vec_id AS m FROM embeddings UNION SELECT r.n, l.b FROM r JOIN l ON r.m = l.a),
g AS (SELECT n, min(m) AS least FROM r GROUP BY n),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT g.n AS vec_id, coalesce(k.n, 0) AS n_links, least AS component_id, least = g.n AS kept FROM g LEFT JOIN k ON k.a = g.n
"""
