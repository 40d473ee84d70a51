"""Removal of repeated passages by level-wise doubling of repeated windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import chunked, mix, partitions, slice_hashes, word_bounds, word_hashes

#: Words of a window that must not repeat, and of the shortest windows looked at.
LENGTH, SHORTEST = 35, 9
#: Rows held by a task before it sends its questions on.
HELD = 1_000_000
#: Shares among which the copies of one text are dealt.
SALTS = 32


def levels(length: int, shortest: int = SHORTEST) -> list[int]:
    """Window lengths, each at most twice the one before, from about the shortest to length: 9, 18, 35."""
    found = [length]
    while found[0] > max(shortest, 1):
        found.insert(0, (found[0] + 1) // 2)
    return found


def _slide(values: np.ndarray, width: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over values[i : i + width] for each i, beyond the end over fill."""
    n = len(values)
    now, span = np.concatenate([values, np.full(width - 1, fill, values.dtype)]), 1
    while 2 * span <= width:
        now = op(now[:-span], now[span:])
        span *= 2
    return op(now[:n], now[width - span : width - span + n])


def _anchors(hashes: np.ndarray, alive: np.ndarray, width: int) -> np.ndarray:
    """Whether a window's hash is the least among width neighbours that one living long window spans.

    Copies of a long window have the same least one, so that a level need only count a few of its windows, and
    none outside what is still alive.
    """
    least = _slide(hashes, width, np.minimum, np.iinfo(np.uint64).max)
    least[~alive] = 0
    highest = _slide(np.concatenate([np.zeros(width - 1, np.uint64), least]), width, np.maximum, 0)[: len(hashes)]
    return (hashes == highest) & (highest > 0)


class Chunk:
    """Words of some documents, and the places where a window of the full length may still repeat."""

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        blob, starts, ends, self.first = word_bounds(texts)
        self.words = word_hashes(blob, starts, ends)
        n = len(self.words)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.alive = np.arange(n) + length <= self.first[1:][self.doc]

    def hashes(self, size: int) -> np.ndarray:
        """Hash of the window of size words from each place (of what is left, near the end)."""
        at = np.arange(len(self.words))
        return slice_hashes(self.words, at, np.minimum(at + size, len(self.words)))

    def ask(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, places to count) of a level."""
        hashes = self.hashes(size)
        return hashes, _anchors(hashes, self.alive, self.length - size + 1)

    def answer(self, size: int, repeated: list[list[int] | None]) -> None:
        """Long windows whose least window of this size isn't at one of the repeated places (by document) are dead."""
        hashes, width, most = self.hashes(size), self.length - size + 1, np.iinfo(np.uint64).max
        again = np.full(len(hashes), most, np.uint64)
        at = self.places(repeated)
        again[at] = hashes[at]
        self.alive &= _slide(hashes, width, np.minimum, most) == _slide(again, width, np.minimum, most)

    def places(self, by_doc: list[list[int] | None]) -> np.ndarray:
        parts = [np.asarray(p, np.int64) + self.first[i] for i, p in enumerate(by_doc) if p is not None and len(p)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _questions(length: int, sizes: list[int], held: int):
    """Rows (h, n, k, pos): windows of the last of sizes to be counted over the whole corpus.

    Windows that a task meets twice are known to repeat: one row without place tells the others how often they were
    met, and their places go on under keys of their own, so that no key has more than a row from each task's hold.
    """

    def flush(parts: list[tuple]) -> object:
        import pyarrow as pa

        h, k, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        h, k, pos = h[order], k[order], pos[order]
        begin = np.concatenate([[0], np.flatnonzero(np.diff(h)) + 1])
        count = np.diff(np.concatenate([begin, [len(h)]]))
        many = np.repeat(count > 1, count)
        tell = begin[count > 1]
        key = np.concatenate([np.where(many, mix(h ^ mix(k.view(np.uint64) + pos.astype(np.uint64))), h), h[tell]])
        n = np.concatenate([np.where(many, 2, 1), count[count > 1]]).astype(np.int32)
        null = np.arange(len(key)) >= len(h)
        fill = np.zeros(len(tell), np.int32)
        columns = [pa.array(key.view(np.int64)), pa.array(n), pa.array(np.concatenate([k, fill]), mask=null), pa.array(np.concatenate([pos, fill]), mask=null)]
        return pa.RecordBatch.from_arrays(columns, ["h", "n", "k", "pos"])

    def work(batches: Iterator) -> Iterator:
        parts: list[tuple] = []
        total = 0
        for texts, k, *repeated in chunked(batches, ["k", *(f"r{s}" for s in sizes[:-1])]):
            chunk = Chunk(texts, length)
            for size, places in zip(sizes, repeated, strict=False):
                chunk.answer(size, places)
            hashes, asked = chunk.ask(sizes[-1])
            at = np.flatnonzero(asked)
            doc = chunk.doc[at]
            parts.append((hashes[at], np.asarray(k, np.int64)[doc], (at - chunk.first[doc]).astype(np.int32)))
            total += len(at)
            if total >= held:
                yield flush(parts)
                parts, total = [], 0
        if total:
            yield flush(parts)

    return work


def _places(docs: DataFrame, length: int, shortest: int, held: int) -> DataFrame:
    """k, places: where windows of the full length that also start elsewhere start, for documents that have any."""
    found: list[DataFrame] = []
    sizes = levels(length, shortest)
    parts = partitions(docs.sparkSession)
    for i, size in enumerate(sizes):
        now = docs.select("k", "doc_id", "text")  # the columns of the removal: all read the same exchange
        for old, repeated in zip(sizes, found, strict=False):
            now = now.join(repeated.withColumnRenamed("places", f"r{old}"), "k")
        asked = now.mapInArrow(_questions(length, sizes[: i + 1], held), "h bigint, n int, k bigint, pos int")
        met = F.sum("n").over(Window.partitionBy("h"))
        again = asked.withColumn("met", met).where("met > 1 AND pos IS NOT NULL").select("k", "pos")
        found.append(again.repartition(parts, "k").groupBy("k").agg(F.collect_list("pos").alias("places")))
    return found[-1]


def _copies(keyed: DataFrame) -> DataFrame:
    """k, first for rows whose whole text stands in several rows; first marks the one that asks for all of them."""
    # Copies of a text are counted before they are dealt, and look their group up in SALTS shares.
    texts = keyed.select("k", F.xxhash64("text", F.lit(1)).alias("th"), F.pmod(F.col("k"), F.lit(SALTS)).alias("salt"))
    groups = texts.groupBy("th").agg(F.count(F.lit(1)).alias("rows"), F.min("k").alias("least")).where("rows > 1")
    groups = groups.select("th", "least", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    marked = texts.join(groups, ["th", "salt"]).groupBy("k").agg(F.max(F.col("k") == F.col("least")).alias("first"))
    return marked.repartition(partitions(keyed.sparkSession), "k")


def _run(docs: DataFrame, length: int, shortest: int, held: int, schema: str, finish) -> DataFrame:
    # One exchange of the texts serves every level and the removal: the plans below share it.
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("k"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string"))
    dealt = keyed.repartition(partitions(docs.sparkSession), "k")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for texts, ids, first, places in chunked(batches, ["doc_id", "first", "places"]):
            rows = []
            for text, copied, at in zip(texts, first, places, strict=True):
                words = text.split()
                total = len(words)
                if copied is not None:  # all its windows start in the copies too
                    words = words if total < length else []
                elif at is not None and len(at):
                    edge = np.zeros(total + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, np.asarray(at) + length, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                rows.append((total, total - len(words), finish(b" ".join(words))))
            names = [part.split()[0] for part in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c) for c in zip(*rows, strict=True))], names)

    copied = _copies(keyed)
    marked = dealt.join(copied, "k", "left")
    places = _places(marked.where("first IS NULL OR first"), length, shortest, held)
    return marked.join(places, "k", "left").select("doc_id", "text", "first", "places").mapInArrow(work, schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, shortest: int = SHORTEST, held: int = HELD) -> DataFrame:
    """doc_id, n_words, n_removed, kept for each row of docs: kept has the words left, joined by single spaces.

    A word goes if a window of length words that covers it has a word sequence that also starts anywhere else, in the
    same document or another, all judged on the input. Windows are compared level by level: only where a
    window of one length repeats are windows of twice that length, which hold it, counted. Of rows with one text,
    only one has its windows counted. Sequences are equal if their 64-bit hashes are, at every level; rows are
    told apart by 64 bits as well.

    A null text has no words; texts shorter than length keep all; rows that repeat doc_id and text repeat each
    other's words. Other columns play no part; an empty table gives no rows.
    """
    return _run(docs, length, shortest, held, "doc_id bigint, n_words bigint, n_removed bigint, kept string", lambda kept: kept.decode())


def digests(docs: DataFrame, length: int = LENGTH, shortest: int = SHORTEST, held: int = HELD) -> DataFrame:
    """remove_repeats(), with what is kept reduced to its SHA-256 inside the task; the same rules hold."""
    return _run(docs, length, shortest, held, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string", lambda kept: hashlib.sha256(kept).hexdigest())


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document, by digests() with windows of LENGTH words."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
r AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY h) > 1),
c AS (SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM r) GROUP BY doc_id),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.j) AS kept FROM u ANTI JOIN (SELECT doc_id, unnest(js) AS j FROM c) x ON u.doc_id = x.doc_id AND u.j = x.j GROUP BY u.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(js), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""
