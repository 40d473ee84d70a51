"""Exact duplicates through an extendible-hash index whose buckets are owned by tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import SPACE, partitions, small_batches, stash

#: Slots of the directory at most 2**MAX_DEPTH: this bounds what the driver holds and what is broadcast.
MAX_DEPTH = 16
#: Distinct keys in a bucket before it is split; fewer if there would be under four buckets for each owner.
CAPACITY = 8192


def normalised() -> F.Column:
    return F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACE, " ")


def build_directory(cells: np.ndarray, capacity: int) -> tuple[int, list[int], list[tuple[int, int]]]:
    """(depth, slots, buckets) for the number of keys in each cell of equal key prefixes, a power of two of them.

    Starts from one bucket. An overfull bucket is split by one more bit of the key; if that needs more bits than
    the directory has, the directory doubles. slots[prefix] is a bucket's index; buckets are (local depth, prefix).
    A bucket whose keys agree in all bits that cells tell apart stays overfull; its keys are chained like others.
    """
    bits = int(len(cells)).bit_length() - 1
    total = np.concatenate([[0], np.cumsum(cells)])
    depth, slots, buckets, pending = 0, [0], [(0, 0)], [0]
    while pending:
        at = pending.pop()
        local, prefix = buckets[at]
        keys = total[(prefix + 1) << (bits - local)] - total[prefix << (bits - local)]
        if keys <= capacity or local == bits:
            continue
        if local == depth:
            slots = [s for s in slots for _ in (0, 1)]
            depth += 1
        new = len(buckets)
        buckets[at] = (local + 1, 2 * prefix)
        buckets.append((local + 1, 2 * prefix + 1))
        width = 1 << (depth - local - 1)
        begin = (2 * prefix + 1) * width
        slots[begin : begin + width] = [new] * width
        pending += [at, new]
    return depth, slots, buckets


def directory(keys: DataFrame, owners: int, capacity: int = CAPACITY) -> tuple[int, DataFrame]:
    """(depth, table of slot, bucket, owner): each owner has a contiguous range of keys."""
    cell = F.shiftrightunsigned("h", 64 - MAX_DEPTH).cast("int")
    found = keys.select("h").distinct().groupBy(cell.alias("cell")).count().collect()
    cells = np.zeros(1 << MAX_DEPTH, np.int64)
    for row in found:
        cells[row["cell"]] = row["count"]
    capacity = max(1, min(capacity, int(cells.sum()) // (4 * owners)))
    depth, slots, buckets = build_directory(cells, capacity)
    order = sorted(range(len(buckets)), key=lambda b: buckets[b][1] / (1 << buckets[b][0]))
    rank = {b: i for i, b in enumerate(order)}
    rows = [(i, rank[b], rank[b] * owners // len(buckets)) for i, b in enumerate(slots)]
    return depth, keys.sparkSession.createDataFrame(rows, "slot int, bucket int, owner int")


def _combine(batches: Iterator) -> Iterator:
    """Copies that meet in a batch become one row before anything is shuffled."""
    import pyarrow as pa

    for batch in batches:
        seen: dict[bytes, list] = {}
        columns = (batch.column(c).to_pylist() for c in ("h", "slot", "norm", "doc_id"))
        for h, slot, norm, doc_id in zip(*columns, strict=True):
            _add(seen.setdefault(norm, [h, slot, norm, None, 0, 0]), doc_id, 1, 1)
        if seen:
            cols = list(zip(*seen.values(), strict=True))
            types = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["h", "slot", "norm", "keep_id", "n", "n_keep"])


def _add(entry: list, doc_id: int | None, n: int, n_keep: int) -> None:
    """Count rows into an entry [.., smallest doc_id, rows, rows with that doc_id]; a null doc_id is the largest."""
    least = entry[-3]
    if entry[-2] == 0 or (doc_id is not None and (least is None or doc_id < least)):
        entry[-3], entry[-1] = doc_id, n_keep
    elif doc_id == least:
        entry[-1] += n_keep
    entry[-2] += n


def _own(batches: Iterator) -> Iterator:
    """An owner's buckets, in order of key: entries with one key are chained, and told apart by their bytes."""
    import pyarrow as pa

    names = ["bucket", "h", "chain", "sha", "keep_id", "n", "n_keep"]
    types = (pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())

    def index(chain: list[list], bucket: int, h: int) -> list[tuple]:
        return [(bucket, h, i, hashlib.sha256(e[0]).hexdigest(), *e[1:]) for i, e in enumerate(chain)]

    chain: list[list] = []
    at = None
    for batch in batches:
        done: list[tuple] = []
        columns = (batch.column(c).to_pylist() for c in ("bucket", "h", "norm", "keep_id", "n", "n_keep"))
        for bucket, h, norm, keep_id, n, n_keep in zip(*columns, strict=True):
            if (bucket, h) != at:
                done += index(chain, *at) if at else []
                chain, at = [], (bucket, h)
            entry = next((e for e in chain if e[0] == norm), None)
            if entry is None:
                chain.append(entry := [norm, None, 0, 0])
            _add(entry, keep_id, n, n_keep)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
    if at:
        done = index(chain, *at)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)


def build_index(docs: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """(keys of all rows, index): both in shared files.

    The index has a row for each distinct normalised text: bucket, h, chain (its place among texts with the same
    64-bit key), sha, keep_id (smallest doc_id), n (rows), n_keep (rows with that doc_id).
    """
    spark = docs.sparkSession
    small_batches(spark)
    owners = partitions(spark)
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), normalised().alias("norm"))
    text = text.withColumn("h", F.xxhash64("norm"))
    keys = stash(text.select("doc_id", "h", F.sha2("norm", 256).alias("sha")), "dedup-keys")
    depth, slots = directory(keys, owners, capacity)
    slot = F.shiftrightunsigned("h", 64 - depth).cast("int") if depth else F.lit(0)
    combined = text.select("doc_id", "h", F.col("norm").cast("binary").alias("norm"), slot.alias("slot")).mapInArrow(
        _combine, "h bigint, slot int, norm binary, keep_id bigint, n bigint, n_keep bigint"
    )
    owned = combined.join(F.broadcast(slots), "slot").repartitionById(owners, F.col("owner")).sortWithinPartitions("bucket", "h")
    schema = "bucket int, h bigint, chain int, sha string, keep_id bigint, n bigint, n_keep bigint"
    index = owned.select("bucket", "h", "norm", "keep_id", "n", "n_keep").mapInArrow(_own, schema)
    return keys, stash(index, "dedup-index")


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical once each run of ASCII white space is one space; null counts as empty.
    The row with the smallest doc_id stays; null doc_ids come last, and of rows equal in doc_id and text one stays.
    Other columns play no part; an empty table gives no rows. No text is too long: it must fit in one row.
    """
    keys, index = build_index(docs, capacity)
    joined = keys.join(index.select("h", "sha", "keep_id", "n"), ["h", "sha"], "left")
    first = F.row_number().over(Window.partitionBy("doc_id", "sha").orderBy(F.lit(0))) == 1
    return joined.select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("doc_id").eqNullSafe(F.col("keep_id")) & first).alias("kept"), F.col("sha").alias("text_sha256")
    )


def drop_duplicates(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of docs that stay, with all their columns; nulls, ties and empty tables as in exact_duplicates()."""
    kept = exact_duplicates(docs, capacity).where("kept").select(F.col("doc_id").alias("keep"), "text_sha256")
    # The whole row is one column, so that no column of docs meets another of its name.
    marked = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.sha2(normalised(), 256).alias("sha"))
    once = F.row_number().over(Window.partitionBy("id", "sha").orderBy(F.lit(0)))
    same = F.col("id").eqNullSafe(F.col("keep")) & (F.col("sha") == F.col("text_sha256"))
    return marked.join(kept, same, "left_semi").withColumn("nth", once).where("nth = 1").select("row.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document, by exact_duplicates()."""
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT doc_id, sha256(norm) AS text_sha256, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
