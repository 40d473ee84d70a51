"""SimHash fingerprints and near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import chunked, partitions, row_key, runs, small_batches, stash
from ._components import components

#: Fingerprints link at so many differing bits or fewer.
BITS = 2
SEED = 42


def segments(bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one differs by at most one bit if at most bits bits differ."""
    if not 0 <= bits < 16:
        raise ValueError("from 0 to 15 differing bits")
    n = bits // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """k1, k2 (row key), doc_id, fp (64 bits) of each row of docs.

    Words are lower-cased in A-Z alone; shingles of width words, repeats included, are joined by spaces and hashed by
    XXH64; a bit is set if it is set in over half of them. A text of fewer words is one shingle; one without words (or
    null) has fingerprint zero.
    """

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh64_intdigest
        for texts, *keys in chunked(batches, ["k1", "k2", "doc_id"]):
            hashes: list[int] = []
            counts = np.zeros(len(texts), np.int64)
            for i, text in enumerate(texts):
                words = text.lower().split()
                if not words:
                    continue
                if len(words) <= width:
                    hashes.append(digest(b" ".join(words), SEED))
                    counts[i] = 1
                    continue
                # Shingles are slices of the joined text: from a word's start to the end of the width-th word from it.
                joined = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                starts = np.concatenate([[0], ends[:-1] + 1])
                hashes += [digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)]
                counts[i] = len(words) - width + 1
            fp = np.zeros(len(texts), np.uint64)
            if hashes:
                all_ = np.array(hashes, np.uint64)
                full = np.flatnonzero(counts)
                begin = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
                for bit in range(64):
                    ones = np.add.reduceat((all_ >> np.uint64(bit)) & np.uint64(1), begin)
                    fp[full] |= (ones * 2 > counts[full].astype(np.uint64)).astype(np.uint64) << np.uint64(bit)
            yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in keys), pa.array(fp.view(np.int64))], ["k1", "k2", "doc_id", "fp"])

    return docs.select(*row_key(), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string")).mapInArrow(work, "k1 bigint, k2 bigint, doc_id bigint, fp bigint")


def _near(fp: np.ndarray, bits: int, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the components of fp (sorted, distinct) under at most bits differing bits.

    Every fingerprint is compared with every earlier one, block by block; each gets a link to its first neighbour and,
    while labels still differ, to one neighbour of a smaller label: a forest, not all pairs.
    """
    n = len(fp)
    label = np.arange(n)
    a, b = [], []
    while True:
        least = label.copy()
        for i in range(0, n, block):
            for j in range(0, n, block):
                near = np.bitwise_count(fp[i : i + block, None] ^ fp[None, j : j + block]) <= bits
                found = np.where(near, label[None, j : j + block], n).min(axis=1)
                np.minimum(least[i : i + block], found, out=least[i : i + block])
        moved = np.flatnonzero(least < label)
        if not len(moved):
            break
        a.append(label[moved])
        b.append(least[moved])
        # Hook the roots of the labels that moved below the smaller labels, and jump to the roots.
        root = np.arange(n)
        np.minimum.at(root, label[moved], least[moved])
        while (root[root] != root).any():
            root = root[root]
        label = root[label]
    if not a:
        return fp[:0], fp[:0]
    return fp[np.concatenate(a)], fp[np.concatenate(b)]


def _spanning(fp: np.ndarray, bits: int, dense: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """_near, but a large group is first parted by two of bits + 2 pieces of the fingerprint, of which some two are equal."""
    if len(fp) <= dense:
        return _near(fp, bits)
    a, b = [fp[:0]], [fp[:0]]
    cuts = [64 * i // (bits + 2) for i in range(bits + 3)]
    masks = [(1 << end) - (1 << begin) for begin, end in zip(cuts, cuts[1:], strict=False)]
    for p in range(bits + 2):
        for q in range(p):
            mask = np.uint64(masks[p] | masks[q])
            order = np.argsort(fp & mask, kind="stable")
            ends = np.flatnonzero(np.diff((fp & mask)[order])) + 1
            for part in np.split(order, ends):
                if len(part) > 1:
                    x, y = _near(fp[part], bits)
                    a.append(x)
                    b.append(y)
    return np.concatenate(a), np.concatenate(b)


def _link(bits: int):
    """Edges within each run of rows with one variant key; the rows come sorted by key and fingerprint."""

    def edges(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cuts = np.flatnonzero(np.diff(key)) + 1
        begin = np.concatenate([[0], cuts])
        size = np.diff(np.concatenate([begin, [len(key)]]))
        two = begin[size == 2]  # most groups: no loop
        x, y = fp[two], fp[two + 1]
        near = np.bitwise_count(x ^ y) <= bits
        a, b = [x[near]], [y[near]]
        for i, n in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            x, y = _spanning(fp[i : i + n], bits)
            a.append(x)
            b.append(y)
        return np.concatenate(a), np.concatenate(b)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for key, fp in runs(batches, ["key", "fp"]):
            a, b = edges(key, fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return work


def variant_edges(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that differ in at most bits bits, enough to connect them.

    A fingerprint is cut into segments (two halves for 2 bits); each is indexed once for each of its bits, with that one
    deleted. Two that differ in at most bits bits differ by at most one bit in some segment, so they share a variant
    there; others that share one are told apart by comparing.
    """
    cut = segments(bits)
    where = F.array(*[F.lit(begin) for begin, width in cut for _ in range(width)])
    size = F.array(*[F.lit(width) for _, width in cut for _ in range(width)])
    one = F.lit(1).cast("bigint")
    shift = lambda c, by: F.call_function("shiftleft", c, by)
    segment = F.call_function("shiftrightunsigned", F.col("fp"), where[F.col("v")]).bitwiseAND(shift(one, size[F.col("v")]) - 1)
    whole = F.when(size[F.col("v")] == 64, F.col("fp")).otherwise(segment)
    deleted = whole.bitwiseAND(F.bitwise_not(shift(one, F.col("v") - where[F.col("v")])))
    # A variant's number and what is left of its segment: in one word where the segment leaves room for the number.
    key = shift(F.col("v").cast("bigint"), F.lit(56)).bitwiseOR(deleted) if len(cut) > 1 else F.xxhash64("v", deleted)
    variants = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v")).select(key.alias("key"), "fp")
    return variants.repartition(partitions(distinct.sparkSession), "key").sortWithinPartitions("key", "fp").mapInArrow(_link(bits), "a bigint, b bigint")


def _rooted(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """k1, k2, doc_id, fp, root (smallest fingerprint of the component) and component_id for each row of docs."""
    small_batches(docs.sparkSession)
    rows = stash(fingerprints(docs, width), "fingerprints")
    nodes = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(variant_edges(nodes, bits))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp", "left").select("k1", "k2", "doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, bits: int = BITS) -> DataFrame:
    """k1, k2, doc_id, fp and component_id (smallest doc_id reachable by links) for each row of docs.

    Equal fingerprints are one node, whatever the number of rows: copies are never paired. Rows with null doc_id
    take part; they come last for the smallest doc_id. Other columns play no part; an empty table gives no rows.
    """
    return _rooted(docs, width, bits).drop("root")


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that come first in their component; found has k1, k2, doc_id and root of each row.

    Components are told apart by root, not by doc_id, which may be null or shared. The row with the smallest doc_id
    stays (null last, then by k1 and k2); of rows alike in doc_id and text, one.
    """
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "k1", "k2")).alias("least")).select("least.k1", "least.k2")
    # The whole row is one column, so that no column of docs meets another of its name.
    marked = docs.select(F.struct(*docs.columns).alias("row"), *row_key())
    once = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.lit(0)))
    return marked.join(kept, ["k1", "k2"], "left_semi").withColumn("nth", once).where("nth = 1").select("row.*")


def keep_one(docs: DataFrame, width: int = 3, bits: int = BITS) -> DataFrame:
    """The rows of docs of which each is the first of its component, with all their columns."""
    return first_of_each(docs, _rooted(docs, width, bits))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document, by near_duplicates() with its defaults."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
