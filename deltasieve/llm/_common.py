"""Shared pieces: session settings, stashed tables, row keys and vectorised word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of one word: anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    Where the session names none, a temporary one is set if driver and executors are one process; on a cluster, whose
    executors would each write to a disk of their own, that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(stashed: DataFrame) -> None:
    """Delete the files of a stashed table that nothing will read again."""
    for file in {f.rsplit("/", 1)[0] for f in stashed.inputFiles()}:
        path = stashed.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(stashed.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let at most so many whole texts go to a Python worker at once: ten times fewer than Spark's default.

    A batch is held by the executor and by the worker in turn, so that its size counts several times over. The setting is
    read when a plan runs, after its operator has returned, so that it stays lowered for the session; results don't
    depend on it.
    """
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(conf)) > rows:
        spark.conf.set(conf, str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key() -> list:
    """Two columns that name a row by doc_id and text; rows alike in both are interchangeable."""
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)).alias("k1"), F.xxhash64("text").alias("k2")]


def remainder(divisor: int):
    """crc32 of the decimal doc_id, modulo divisor; a null doc_id counts as an empty string."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor


# Vectorised hashing of words. A chunk of documents is one byte array with a line feed after each
# document; prefix sums of table[byte] * BASE**i turn any slice's hash into two look-ups.
_rng = np.random.default_rng(20240229)
BYTE_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
LOWER_TABLE = BYTE_TABLE.copy()
LOWER_TABLE[65:91] = BYTE_TABLE[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE, _BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slice_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[s:e] for each pair; equal slices hash alike wherever they stand."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_BASE, len(values)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(_BASE_INV, len(values) + 1)[starts])


def word_bounds(docs: list[bytes], gap: bytes = b"\n") -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts, word ends, first word of each document plus the total) of a chunk; gap parts documents."""
    blob = gap + gap.join(docs) + gap
    data = np.frombuffer(blob, np.uint8)
    edge = np.flatnonzero(np.diff(IS_SPACE[data].view(np.int8))) + 1
    starts, ends = edge[::2], edge[1::2]
    offsets = np.cumsum([len(gap)] + [len(d) + len(gap) for d in docs])
    return blob, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(blob: bytes, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    table = LOWER_TABLE if lower else BYTE_TABLE
    return slice_hashes(table[np.frombuffer(blob, np.uint8)], starts, ends)


def chunked(batches, columns: list[str], size: int = 2_000_000):
    """Arrow batches as tuples of lists (text as bytes, null as empty), of about size bytes of text each."""
    import pyarrow as pa

    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        rest = [batch.column(c).to_pylist() for c in columns]
        at = 0
        while at < len(texts):
            end, total = at, 0
            while end < len(texts) and (end == at or total < size):
                total += len(texts[end] or b"")
                end += 1
            yield [t or b"" for t in texts[at:end]], *(r[at:end] for r in rest)
            at = end


def runs(batches, names: list[str]):
    """Columns of the rows of whole runs of the first column, from batches of rows that come sorted by it.

    A run over many batches is put together once, when it ends.
    """
    held: list[list[np.ndarray]] = []
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        key = now[0]
        if not len(key):
            continue
        if held and (key[0] != held[-1][0][-1] or key[-1] != key[0]):
            # The run held ends here: what is before this batch's last run is whole.
            done = int(np.searchsorted(key, key[-1]))
            held.append([c[:done] for c in now])
            yield [np.concatenate(p) for p in zip(*held, strict=True)]
            held = [[c[done:] for c in now]]
        elif not held:
            done = int(np.searchsorted(key, key[-1]))
            if done:
                yield [c[:done] for c in now]
            held = [[c[done:] for c in now]]
        else:
            held.append(now)
    if held:
        yield [np.concatenate(p) for p in zip(*held, strict=True)]
