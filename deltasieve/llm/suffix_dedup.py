"""Removal of bytes that repeat earlier ones: suffix arrays of what may repeat, by two-stage sorting."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import BYTE_TABLE, chunked, mix, partitions, slice_hashes, small_batches
from .substring_dedup import _slide

#: Bytes of a string that must not repeat.
LENGTH = 100
#: Bytes of the grams by which strings meet, and of those for strings whose gram is too common.
GRAMS = (20, 90, LENGTH)
#: A gram with more different surroundings than this, and than ten a task, is too common.
COMMON = 1000
#: Anchors and bytes of fragments that a task holds before it sends them on, bytes that go into a suffix array.
ASKED, HELD, SORTED = 1_000_000, 24_000_000, 2_000_000
#: Shares among which the rows of one text are dealt, and groups of anchors for each task of the sorting.
SALTS, SLOTS = 32, 8
_MOST = np.iinfo(np.uint64).max


class SuffixArray:
    """Suffixes of fragments at their first windows[f] places, sorted by two stages; a fragment ends below every byte.

    A suffix smaller than its successor (the one a byte shorter) is sorted directly, by its first length bytes, eight
    at a time. All others are induced: in a scan of the buckets of first bytes, in order, such suffixes of a bucket stand
    before the others in it, in order of their successors, which have been placed by then.
    """

    def __init__(self, fragments: list[bytes], windows: np.ndarray, length: int):
        self.length = length
        sizes = np.array([len(f) for f in fragments], np.int64)
        self.begin = np.cumsum(sizes) - sizes
        self.fragment = np.repeat(np.arange(len(fragments)), sizes)
        self.end = (self.begin + sizes)[self.fragment]
        blob = b"".join(fragments)
        self.bytes = np.frombuffer(blob, np.uint8)
        self.words = self._words(blob)
        n = len(self.bytes)
        self.at = np.arange(n)
        self.windows = self.at < (self.begin + windows)[self.fragment]
        self.smaller = self._smaller()
        # Beyond the windows, a suffix that isn't sorted directly needs its successors up to one that is.
        stop = np.where(self.smaller, self.at, n)
        stop = np.minimum.accumulate(stop[::-1])[::-1]
        last = self.begin + windows - 1
        reach = np.minimum(stop[last], self.begin + sizes - 1)
        self.needed = self.at <= reach[self.fragment]
        self.order = self._induce(self._direct(np.flatnonzero(self.needed & self.smaller)))

    def _words(self, blob: bytes) -> np.ndarray:
        """The eight bytes from each place on, and on to zeros, as one number."""
        padded = blob + bytes(16 + self.length)
        words = np.empty(len(blob) + self.length, np.uint64)
        for i in range(8):
            part = np.frombuffer(padded, ">u8", (len(padded) - i) // 8, i)
            words[i::8] = part[: len(words[i::8])]
        return words

    def _smaller(self) -> np.ndarray:
        """Whether a suffix is smaller than its successor, as the next other byte in its fragment says."""
        b, n = self.bytes, len(self.bytes)
        up, other = np.zeros(n, bool), np.ones(n, bool)
        up[:-1], other[:-1] = b[:-1] < b[1:], b[:-1] != b[1:]
        last = self.at == self.end - 1
        up[last], other[last] = False, True
        decided = np.minimum.accumulate(np.where(other, self.at, n)[::-1])[::-1]
        return up[decided]

    def _direct(self, at: np.ndarray) -> np.ndarray:
        """Places in order of their first length bytes, as far as the fragment goes."""
        masks = np.array([0, *(_MOST ^ np.uint64((1 << (64 - 8 * i)) - 1) for i in range(1, 9))], np.uint64)
        most = np.minimum(self.end[at] - at, self.length)
        key = self.words[at] & masks[np.minimum(most, 8)]
        order = np.argsort(key)
        at, most, key = at[order], most[order], key[order]
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        for skip in range(8, self.length, 8):
            group = np.cumsum(new)
            tied = np.flatnonzero(~new | ~np.append(new[1:], True))
            if not len(tied):
                break
            key = self.words[at[tied] + skip] & masks[np.clip(most[tied] - skip, 0, 8)]
            found, rank = np.unique(key, return_inverse=True)
            both = group[tied].astype(np.int64) * len(found) + rank
            order = np.argsort(both)
            both = both[order]
            at[tied], most[tied] = at[tied[order]], most[tied[order]]
            new[tied[1:]] |= both[1:] != both[:-1]
        return at

    def _induce(self, direct: np.ndarray) -> np.ndarray:
        rank = np.zeros(len(self.bytes) + 1, np.int64)
        rest = np.flatnonzero(self.needed & ~self.smaller)
        first = self.bytes[rest]
        rest = rest[np.argsort(first, kind="stable")]
        edges = np.searchsorted(self.bytes[rest], np.arange(257, dtype=np.int64))
        ready = np.searchsorted(self.bytes[direct], np.arange(257, dtype=np.int64))
        out: list[np.ndarray] = []
        placed = 1  # 0 is the rank of what ends
        for c in range(256):
            own = rest[edges[c] : edges[c + 1]]
            if len(own):
                ends = own + 1 == self.end[own]
                same = np.zeros(len(own), bool)
                same[~ends] = self.bytes[own[~ends] + 1] == c
                now = own[~same]
                now = now[np.argsort(np.where(ends[~same], 0, rank[now + 1]), kind="stable")]
                left = np.zeros(0, bool)
                if same.any():
                    left = np.zeros(len(self.bytes) + 1, bool)
                    left[own[same]] = True
                while len(now):
                    rank[now] = np.arange(placed, placed + len(now))
                    placed += len(now)
                    out.append(now)
                    before = now - 1  # place -1 is the last one, which is never left
                    now = before[left[before]] if len(left) else now[:0]
            own = direct[ready[c] : ready[c + 1]]
            rank[own] = np.arange(placed, placed + len(own))
            placed += len(own)
            out.append(own)
        return np.concatenate(out)

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """(places of the windows in order, whether each one's common prefix with the one before is shorter than length)."""
        at = self.order[self.windows[self.order]]
        new = np.ones(len(at), bool)
        alike = np.arange(1, len(at))
        for skip in [*range(0, self.length - 8, 8), self.length - 8]:
            alike = alike[self.words[at[alike - 1] + skip] == self.words[at[alike] + skip]]
        new[alike] = False
        return at, new


def repeated(fragments: list[bytes], windows: np.ndarray, order: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fragment, first window, number of windows) of runs of windows that also start earlier, at a lower (order, offset)."""
    found = SuffixArray(fragments, windows, length)
    at, new = found.groups()
    of = found.fragment[at]
    place = order[of] << 32 | (at - found.begin[of])
    begin = np.flatnonzero(new)
    least = np.minimum.reduceat(place, begin)
    later = np.sort(at[place != np.repeat(least, np.diff(np.append(begin, len(at))))])
    if not len(later):
        return (np.zeros(0, np.int64),) * 3
    of = found.fragment[later]
    edge = np.append(True, (np.diff(later) != 1) | (np.diff(of) != 0))
    first = np.flatnonzero(edge)
    return of[first], later[first] - found.begin[of[first]], np.diff(np.append(first, len(later)))


class Chunk:
    """Some texts, one after the other, and the anchors of their strings: the least gram of each, by hash."""

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        self.blob = b"".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(sizes) - sizes
        self.doc = np.repeat(np.arange(len(texts)), sizes)
        self.values = BYTE_TABLE[np.frombuffer(self.blob, np.uint8)]
        self.left = (self.begin + sizes)[self.doc] - np.arange(len(self.blob))
        self.scope = self.left >= length
        self.at = np.arange(len(self.blob))

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return slice_hashes(self.values, start, end)

    def grams(self, gram: int) -> np.ndarray:
        """Hash of the gram from each place."""
        hashes = np.full(len(self.blob), _MOST, np.uint64)
        whole = np.flatnonzero(self.left >= gram)
        hashes[whole] = self.hashes(whole, whole + gram)
        return hashes

    def runs(self, gram: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, first place, places) of runs of strings in scope with one anchor, the least of their grams' hashes."""
        anchor = _slide(hashes, self.length - gram + 1, np.minimum, _MOST)
        at = np.flatnonzero(self.scope)
        if not len(at):
            return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 2)
        own = anchor[at]
        edge = np.append(True, (own[1:] != own[:-1]) | (np.diff(at) != 1) | (np.diff(self.doc[at]) != 0))
        first = np.flatnonzero(edge)
        return own[first], at[first], np.diff(np.append(first, len(at)))

    def occurrences(self, gram: int, hashes: np.ndarray, anchor: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """How often the anchor stands in each run: twice or more if the run's strings repeat one another."""
        if not len(first):
            return np.zeros(0, np.int64)
        span = count + self.length - gram
        ends = np.cumsum(span)
        same = hashes[np.arange(ends[-1]) + np.repeat(first - ends + span, span)] == np.repeat(anchor, span)
        return np.add.reduceat(same.astype(np.int64), ends - span)

    def narrow(self, first: np.ndarray, count: np.ndarray) -> None:
        """Only strings from these runs stay in scope."""
        edge = np.zeros(len(self.blob) + 1, np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + count, -1)
        self.scope = np.cumsum(edge[:-1]) > 0


def _union(columns: list[list[int] | None]) -> np.ndarray:
    parts = [np.asarray(c, np.int64) for c in columns if c]
    return np.unique(np.concatenate(parts)).view(np.uint64) if parts else np.zeros(0, np.uint64)


def _among(asked: np.ndarray, known: np.ndarray) -> np.ndarray:
    return np.isin(asked, known) if len(known) else np.zeros(len(asked), bool)


def _questions(length: int, grams: tuple[int, ...]):
    """Rows (key, h, n, m, k1, k2): anchors of the last of grams, n occurrences with m surroundings.

    An anchor that a task's hold has several times is told under its own key once, without a text, and goes on for each
    text under keys of their own, so that no key has more than a row from a hold.
    """

    def flush(parts: list[tuple]):
        import pyarrow as pa

        h, around, times, k1, k2 = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((around, h))
        kind = np.append(True, (np.diff(h[order]) != 0) | (np.diff(around[order]) != 0)).astype(np.int64)
        order = np.lexsort((k1, h))
        h, times, k1, k2 = h[order], times[order], k1[order], k2[order]
        begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(begin, len(h)))
        count = np.add.reduceat(times, begin)
        kinds = np.add.reduceat(kind, begin)
        many = np.repeat(count > 1, size)
        once = np.append(True, (h[1:] != h[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))  # each text asks once
        tell = begin[count > 1]
        key = np.concatenate([np.where(many, mix(h ^ mix(k1.view(np.uint64))), h)[once], h[tell]])
        n = np.concatenate([np.where(many, 2, 1)[once], count[count > 1]]).astype(np.int64)
        m = np.concatenate([np.where(many, 0, 1)[once], kinds[count > 1]]).astype(np.int64)
        null = np.arange(len(key)) >= once.sum()
        asks = [pa.array(np.concatenate([k[once], np.zeros(len(tell), np.int64)]), kind, mask=null) for k, kind in ((k1, pa.int64()), (k2, pa.int32()))]
        columns = [pa.array(key.view(np.int64)), pa.array(np.concatenate([h[once], h[tell]]).view(np.int64)), pa.array(n), pa.array(m), *asks]
        return pa.RecordBatch.from_arrays(columns, ["key", "h", "n", "m", "k1", "k2"])

    def work(batches: Iterator) -> Iterator:
        parts: list[tuple] = []
        total = 0
        for texts, k1, k2, *common in chunked(batches, ["k1", "k2", *(f"common{g}" for g in grams[:-1])], 1_000_000):
            chunk = Chunk(texts, length)
            for gram, known in zip(grams, common, strict=False):
                h, first, count = chunk.runs(gram, chunk.grams(gram))
                hot = _among(h, _union(known))
                chunk.narrow(first[hot], count[hot])
            hashes = chunk.grams(grams[-1])
            h, first, count = chunk.runs(grams[-1], hashes)
            doc = chunk.doc[first]
            parts.append((h, chunk.hashes(first, first + count + length - 1), chunk.occurrences(grams[-1], hashes, h, first, count), np.asarray(k1, np.int64)[doc], np.asarray(k2, np.int64)[doc]))
            total += len(h)
            if total >= ASKED:
                yield flush(parts)
                parts, total = [], 0
        if total:
            yield flush(parts)

    return work


def _packed(rows: list[tuple], parts: list[bytes]) -> bytes:
    """Fragments (or, without parts, strings known to start earlier) as one compressed value: key, id, k1, k2, pos, n of each."""
    sizes = np.array([len(p) for p in parts], np.int32)
    head = np.array([len(rows), len(parts)], np.int64)
    return zlib.compress(b"".join([head.tobytes(), np.array(rows, np.int64).T.tobytes(), sizes.tobytes(), *parts]), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """(six columns, parts) of what _packed() made."""
    data = zlib.decompress(data)
    n, m = np.frombuffer(data, np.int64, 2)
    columns = np.frombuffer(data, np.int64, 6 * n, 16).reshape(6, n)
    ends = np.cumsum(np.frombuffer(data, np.int32, m, 16 + 48 * n), dtype=np.int64) + 16 + 48 * n + 4 * m
    cuts = [int(16 + 48 * n + 4 * m), *ends.tolist()]
    return columns, [data[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]


def _fragments(length: int, grams: tuple[int, ...], slots: int):
    """Rows (slot, data): packed fragments of strings that may repeat, by anchor, and strings that do.

    Of equal fragments that a task holds, only the earliest goes on; the others' strings are known to start earlier.
    """

    def flush(held: dict[bytes, tuple], known: list[tuple]):
        import pyarrow as pa

        by_slot: dict[int, tuple[list, list]] = {}
        for part, row in held.items():
            rows, parts = by_slot.setdefault(row[0] % slots, ([], []))
            rows.append(row)
            parts.append(part)
        out = [(slot, _packed(*both)) for slot, both in by_slot.items()]
        if known:
            out.append((known[0][2] % slots, _packed(known, [])))
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], ["slot", "data"])

    def work(batches: Iterator) -> Iterator:
        held: dict[bytes, tuple] = {}
        size, known = 0, []
        fields = ["id", "k1", "k2", *(f"{kind}{g}" for g in grams for kind in ("rare", "common"))]
        for texts, ids, k1, k2, *answers in chunked(batches, fields, 1_000_000):
            chunk = Chunk(texts, length)
            for i, gram in enumerate(grams):
                h, first, count = chunk.runs(gram, chunk.grams(gram))
                rare = _among(h, _union(answers[2 * i]))
                doc = chunk.doc[first[rare]]
                places = first[rare] - chunk.begin[doc]
                for anchor, d, start, pos, n in zip(h[rare].view(np.int64).tolist(), doc.tolist(), first[rare].tolist(), places.tolist(), count[rare].tolist(), strict=True):
                    part = chunk.blob[start : start + n + length - 1]
                    row = (anchor, ids[d], k1[d], k2[d], pos, n)
                    other = held.setdefault(part, row)
                    if other is row:
                        size += len(part)
                    elif row[1:5] < other[1:5]:
                        held[part] = row
                        known.append(other)
                    else:
                        known.append(row)
                common = _union(answers[2 * i + 1])
                if not len(common):
                    break
                hot = _among(h, common)
                chunk.narrow(first[hot], count[hot])
            if size >= HELD or len(known) >= 200_000:
                yield flush(held if size >= HELD else {}, known)
                known = []
                if size >= HELD:
                    held, size = {}, 0
        if held or known:
            yield flush(held, known)

    return work


def _sort(length: int):
    """Rows (k1, k2, pos, n) of strings that start earlier, from all fragments of some anchors, which come sorted by slot."""

    def solve(rows: np.ndarray, parts: list[bytes], out: list[np.ndarray]) -> None:
        """Fragments of whole anchors: equal ones count once, by the earliest; the others go into a suffix array."""
        place = list(zip(*rows[1:5].tolist(), strict=True))
        known: dict[bytes, int] = {}
        again = []
        for i, part in enumerate(parts):
            other = known.setdefault(part, i)
            if other != i:
                first, second = (i, other) if place[i] < place[other] else (other, i)
                known[part] = first
                again.append(second)
        at = np.array([*known.values()], np.int64)
        order = np.empty(len(at), np.int64)
        order[np.lexsort(rows[4:0:-1, at])] = np.arange(len(at))
        of, first, n = repeated(list(known), rows[5, at], order, length)
        found = rows[2:6, at[of]].copy()
        found[2] += first
        found[3] = n
        out += [rows[2:6, again], found]

    def finish(held: list[tuple[np.ndarray, list[bytes]]]):
        import pyarrow as pa

        out = [rows[2:6] for rows, parts in held if not parts]
        held = [h for h in held if h[1]]
        if held:
            rows, parts = np.concatenate([h[0] for h in held], 1), [p for h in held for p in h[1]]
            order = np.argsort(rows[0], kind="stable")
            rows, parts = rows[:, order], [parts[i] for i in order.tolist()]
            upto = np.cumsum([len(p) for p in parts])
            edges = np.append(np.flatnonzero(np.diff(rows[0])) + 1, len(parts))  # ends of anchors
            begin = 0
            while begin < len(parts):
                # As many anchors as fit in an array; one of them at least.
                room = (upto[begin - 1] if begin else 0) + SORTED
                fit = edges[(edges > begin) & (upto[edges - 1] <= room)]
                end = int(fit[-1]) if len(fit) else int(edges[edges > begin][0])
                solve(rows[:, begin:end], parts[begin:end], out)
                begin = end
        k1, k2, pos, n = np.concatenate(out, 1)
        return pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2.astype(np.int32)), pa.array(pos), pa.array(n)], ["k1", "k2", "pos", "n"])

    def work(batches: Iterator) -> Iterator:
        held: list[tuple[np.ndarray, list[bytes]]] = []
        at = None
        for batch in batches:
            for slot, data in zip(batch.column("slot").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if slot != at and held:
                    yield finish(held)
                    held = []
                at = slot
                held.append(_unpacked(data))
        if held:
            yield finish(held)

    return work


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Two unlike hashes: 96 bits of the text.
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.hash("text"), "size": F.octet_length("text").cast("bigint")})


def _answers(asked: DataFrame, gram: int, common: int) -> DataFrame:
    """k1, k2, rare and common: anchors of a text that other strings have too, by how many surroundings they have in all."""
    dealt = asked.repartition(partitions(asked.sparkSession), "key")
    again = dealt.withColumn("met", F.sum("n").over(Window.partitionBy("key"))).where("met > 1 AND n >= m AND k1 IS NOT NULL").select("h", "k1", "k2")
    # A row from each hold at most has m, so that these sums are of few rows; what is too common has over `common` of all surroundings.
    # All columns are asked about, with conditions that always hold, so that both plans read one exchange.
    sums = dealt.groupBy("key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.max("h").alias("h"), F.count("k1").alias("c1"), F.count("k2").alias("c2"))
    hot = F.broadcast(sums.where((F.col("m") > common) & (F.col("n") >= F.col("m")) & (F.col("n") >= F.col("c1")) & (F.col("n") >= F.col("c2")) & (F.col("h") == F.col("key"))).select(F.col("key").alias("hot")))
    marked = again.join(hot, F.col("h") == F.col("hot"), "left")
    lists = [F.collect_list(F.when(F.col("hot").isNull(), F.col("h"))).alias(f"rare{gram}"), F.collect_list("hot").alias(f"common{gram}")]
    return marked.groupBy("k1", "k2").agg(*lists)


def _copies(rows: DataFrame, length: int) -> DataFrame:
    """Result rows of rows whose text an earlier row has: all or nothing of it goes."""
    alike = rows.groupBy("doc_id", "k1", "k2", "size", F.sha2("text", 256).alias("sha")).agg(F.count(F.lit(1)).alias("rows"))
    alike = alike.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    groups = alike.groupBy("k1", "k2").agg(F.sum("rows").alias("all"), F.min(F.struct("doc_id")).alias("least")).where("all > 1")
    groups = groups.select("k1", "k2", "least", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    later = alike.join(groups, ["k1", "k2", "salt"]).withColumn("later", F.col("rows") - F.col("doc_id").eqNullSafe(F.col("least.doc_id")).cast("bigint")).where("later > 0")
    # As many rows as there are: first by thousands, then one by one, so that no array is long.
    some = later.withColumn("from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("later") - 1, F.lit(1000).cast("bigint"))))
    each = some.withColumn("one", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(1000).cast("bigint"), F.col("later") - F.col("from")))))
    gone = F.col("size") >= length
    return each.select("doc_id", F.col("size").alias("n_bytes"), F.when(gone, F.col("size")).otherwise(0).alias("n_removed"), gone.cast("bigint").alias("n_spans"), F.col("k1").alias("k1"), F.col("k2").alias("k2"), F.when(gone, F.sha2(F.lit(b""), 256)).otherwise(F.col("sha")).alias("kept_sha256"))


def _remover(length: int, texts: bool):
    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for parts, ids, spans in chunked(batches, ["doc_id", "spans"], 4_000_000):
            rows = []
            for text, found in zip(parts, spans, strict=True):
                removed = runs = 0
                kept = text
                if found:
                    edge = np.zeros(len(text) + 1, np.int64)
                    start = np.array([s["pos"] for s in found], np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + np.array([s["n"] for s in found], np.int64) + length - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed = int(gone.sum())
                    runs = int((np.diff(gone.view(np.int8), prepend=0) == 1).sum())
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                rows.append((len(text), removed, runs, kept if texts else hashlib.sha256(kept).hexdigest()))
            n, removed, runs, kept = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in (n, removed, runs)), pa.array(kept, pa.binary() if texts else pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept" if texts else "kept_sha256"])

    return work


def _run(docs: DataFrame, length: int, grams: tuple[int, ...], common: int | None, texts: bool) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    grams = tuple(g for g in grams if g < length) + (length,)
    common = common or max(COMMON, 10 * partitions(spark))
    rows = _texts(docs)
    # One row for each text, by its earliest document. The exchange of this grouping, which sends a text once from each task,
    # serves every plan below.
    whole = rows.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.min(F.struct("doc_id")).alias("least"))
    whole = whole.select("k1", "k2", F.col("least.doc_id").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    answers: list[DataFrame] = []
    for i, gram in enumerate(grams):
        asking = whole  # with doc_id, which isn't asked about: all plans read one exchange of the same columns
        for old, known in zip(grams, answers, strict=False):
            asking = asking.join(known.where(F.size(f"common{old}") > 0).select("k1", "k2", f"common{old}"), ["k1", "k2"])
        asked = asking.mapInArrow(_questions(length, grams[: i + 1]), "key bigint NOT NULL, h bigint NOT NULL, n bigint NOT NULL, m bigint NOT NULL, k1 bigint, k2 int")
        answers.append(_answers(asked, gram, common if gram < length else 1 << 62))
    # A null doc_id comes before all others.
    named = whole.select("k1", "k2", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "text").join(answers[0], ["k1", "k2"])
    found = reduce(lambda a, b: a.join(b, ["k1", "k2"], "left"), answers[1:], named)
    parts = found.mapInArrow(_fragments(length, grams, SLOTS * partitions(spark)), "slot int, data binary")
    dealt = parts.repartition(partitions(spark), "slot").sortWithinPartitions("slot")
    later = dealt.mapInArrow(_sort(length), "k1 bigint, k2 int, pos bigint, n bigint")
    spans = later.groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "n")).alias("spans"))
    last = "kept binary" if texts else "kept_sha256 string"
    kept = whole.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(_remover(length, texts), f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, {last}")
    copies = _copies(rows, length)
    if not texts:
        return kept.unionByName(copies.drop("k1", "k2"))
    # A copy that is too short to lose anything is its text.
    short = rows.where(F.col("size") < length).groupBy("k1", "k2").agg(F.first("text").cast("binary").alias("kept"))
    return kept.unionByName(copies.drop("kept_sha256").join(short, ["k1", "k2"], "left").drop("k1", "k2").withColumn("kept", F.coalesce("kept", F.lit(b""))))


def remove_repeats(docs: DataFrame, length: int = LENGTH, grams: tuple[int, ...] = GRAMS, common: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept for each row of docs: kept (binary) has the bytes left.

    A byte of a text's UTF-8 goes if a string of length bytes that covers it also starts earlier: in a row with a smaller
    doc_id, or in the same row, further left. All is judged on the input, and n_spans counts the runs of bytes that go.

    Strings meet by anchors, the least of their grams by hash: equal strings have equal ones, so that an anchor that only
    one place has is left alone. Fragments, the strings of a run with one anchor, are sent to the anchor's task; it
    builds a suffix array of them, and neighbours in it with a common prefix of length bytes are one string, whose earliest
    place stays. An anchor with more than `common` surroundings is replaced by longer ones, at last by the whole string, so that
    no task has more of one anchor than that; equal fragments are sent once from each task's hold.

    A null text is empty. A row whose text stands in an earlier row loses all of it (nothing if it is shorter than length).
    A null doc_id comes first; rows that share a doc_id are in order of a hash of their texts; of equal rows one
    is first. Texts are told apart by 96 bits of hash, strings by their bytes. A text of any length goes through as one
    row. Other columns play no part; an empty table gives no rows. length must be 8 at least.
    """
    return _run(docs, length, grams, common, True)


def digests(docs: DataFrame, length: int = LENGTH, grams: tuple[int, ...] = GRAMS, common: int | None = None) -> DataFrame:
    """remove_repeats(), with what is kept reduced to its SHA-256 inside the task; the same rules hold."""
    return _run(docs, length, grams, common, False)


def op13_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, by digests() with strings of LENGTH bytes."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
h AS (SELECT doc_id, i, md5(x[2 * i + 1:2 * i + 200]) AS h FROM (SELECT doc_id, x, unnest(range(len(x) // 2 - 99)) AS i FROM d)),
r AS (SELECT doc_id, i FROM h QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
g AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 100)) AS i FROM r)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 1 AS b FROM g GROUP BY doc_id, run),
e AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
k AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS last, string_agg(x[2 * before + 1:2 * a], '' ORDER BY a) AS kept
  FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(from_hex(coalesce(kept, '') || x[2 * coalesce(last, 0) + 1:])) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
