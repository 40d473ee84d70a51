"""Near copies by Jaccard similarity of word shingles: long SimHash fingerprints propose pairs, shingle sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import chunked, discard, mix, partitions, row_key, runs, small_batches, stash, word_bounds, word_hashes
from ._components import components
from .simhash import first_of_each, variant_edges

#: Words of a shingle, and the least Jaccard similarity of two near copies' sets of shingles.
WIDTH, SIMILAR = 5, 0.8
#: A fingerprint has 64 * WORDS bits. At similarity 0.8 two differ in 15% of them, give or take 2.2% (4.5% in 64).
WORDS = 4
#: Pairs at exactly 0.8 to be met in some band; more similar ones are met more often.
RECALL = 0.999
#: Most differing bits of a pair: over three and a half deviations above 0.8's mean.
ALL = 62
#: Bands of which neighbours in order are linked first. Then all bands are looked through for close rows of unlike components.
#: Groups of up to GROUP rows are compared many at once. Where no row has more than NEAREST such others in its group, the
#: pairs are passed on; of other groups the rows are, with their sets, so that no group's pairs are written out.
FIRST_BANDS, GROUP, NEAREST = 6, 64, 2
#: Of the pairs, so many nearest of each row are verified first.
AT_FIRST = 2
SEED = 20240301
#: Names of a fingerprint's words, and what is known of a node wherever it meets others.
_WORDS = [f"w{w}" for w in range(WORDS)]
_CARRIED = ["node", "n", "label", *_WORDS]
_FACTORS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
#: The eight bits of a byte, each in its own byte of a word: so added, up to 255 bytes count all their bits at once.
_LANES = np.array([sum((b >> i & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def shingles(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each text's distinct shingles, in that order.

    Words are lower-cased in A-Z alone and told apart, as shingles are, by 64-bit hashes. A text of fewer words than
    width is one shingle, one without words has none.
    """
    blob, starts, ends, first = word_bounds(texts)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(texts)), n)
    if not len(doc):
        return doc, np.zeros(0, np.uint64)
    words = word_hashes(blob, starts, ends, lower=True)
    left = np.repeat(first[1:], n) - np.arange(len(doc))  # words from each one to its text's end
    total = np.zeros(len(doc), np.uint64)
    for j in range(width):
        total[: len(doc) - j] += np.where(left[: len(doc) - j] > j, words[j:] * _FACTORS[j], np.uint64(0))
    whole = (left >= width) | (left == n[doc])
    doc, hashes = doc[whole], mix(total[whole])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new]


def sketch(doc: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set's 64-bit digest, number of shingles, fingerprint of WORDS words) of each of size documents.

    A bit is set if over half of the distinct shingles have it, or half and the least of them. Zero without shingles.
    """
    count = np.bincount(doc, minlength=size)
    node, bits = np.zeros(size, np.uint64), np.zeros((size, 64 * WORDS), bool)
    full = np.flatnonzero(count)
    if len(full):
        n = count[full]
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        node[full] = mix(np.add.reduceat(mix(hashes ^ _FACTORS[-1]), begin))
        parts = -(-n // 255)
        part = np.concatenate([[0], np.cumsum(parts)[:-1]])
        at = np.repeat(begin, parts) + 255 * (np.arange(parts.sum()) - np.repeat(part, parts))
        for w in range(WORDS):
            bytes_ = mix(hashes + _FACTORS[32 + w]).view(np.uint8).reshape(-1, 8)
            for b in range(8):
                lanes = np.add.reduceat(_LANES[bytes_[:, b]], at).view(np.uint8).reshape(-1, 8)
                ones = np.add.reduceat(lanes.astype(np.int64), part, axis=0)
                least = (bytes_[begin, b][:, None] >> np.arange(8, dtype=np.uint8)) & 1
                bits[full, 64 * w + 8 * b : 64 * w + 8 * b + 8] = 2 * ones + least > n[:, None]
    return node, count, np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """k1, k2, doc_id, node (digest of the set of shingles), n (its size) and w0.. (fingerprint) of each row."""
    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for texts, *keys in chunked(batches, ["k1", "k2", "doc_id"]):
            node, count, prints = sketch(*shingles(texts, width), len(texts))
            columns = [*(pa.array(k, pa.int64()) for k in keys), pa.array(node.view(np.int64)), pa.array(count.astype(np.int64))]
            columns += [pa.array(np.ascontiguousarray(prints[:, w]).view(np.int64)) for w in range(WORDS)]
            yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "doc_id", "node", "n", *_WORDS])

    plain = docs.select(*row_key(), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string"))
    return plain.mapInArrow(work, "k1 bigint, k2 bigint, doc_id bigint, node bigint, n bigint, " + ", ".join(f"{n} bigint" for n in _WORDS))


def bands(n: int, similar: float = SIMILAR) -> np.ndarray:
    """Bit numbers [band, bit]: the more nodes, the more bits to a band and the more bands.

    A band takes at least a sixteenth as many values as there are nodes, so unrelated nodes meet a bounded number of others in
    each; bands suffice for RECALL of the pairs of this similarity, whose bits agree with the chance below.
    """
    k = min(40, max(8, math.ceil(math.log2(max(n, 1))) - 4))
    agree = 1 - math.acos(2 * similar / (1 + similar)) / math.pi
    m = math.ceil(math.log(1 - RECALL) / math.log1p(-(agree**k)))
    rng = np.random.default_rng(SEED)
    return np.stack([rng.permutation(64 * WORDS)[:k] for _ in range(m)])


def _banded(nodes: DataFrame, chosen: np.ndarray) -> DataFrame:
    """key, node, n, label and fingerprint of each node in each band."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            prints = np.stack([batch.column(w).to_numpy(zero_copy_only=False) for w in _WORDS], axis=1)
            for at in range(0, len(prints), 2000):
                some = np.ascontiguousarray(prints[at : at + 2000])
                bits = np.unpackbits(some.view(np.uint8), axis=1, bitorder="little").T
                rest = [batch.column(c).slice(at, len(some)) for c in _CARRIED]
                for band, places in enumerate(chosen):
                    key = np.full(len(some), band, np.int64)
                    for place in places:
                        key = (key << 1) | bits[place]
                    yield pa.RecordBatch.from_arrays([pa.array(key), *rest], ["key", *_CARRIED])

    schema = ", ".join(f"{c} bigint" for c in ["key", *_CARRIED])
    return nodes.select(*_CARRIED).mapInArrow(work, schema)


def _by_variants(nodes: DataFrame) -> DataFrame:
    """a, b: nodes alike in the first 64 bits of their fingerprints but for few, by deletion variants; enough to connect them.

    Nodes of one such word are paired with the first of them.
    """
    first = stash(nodes.groupBy(F.col("w0").alias("fp")).agg(F.min("node").alias("first")), "firsts")
    same = nodes.join(first, nodes["w0"] == F.col("fp")).where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = variant_edges(first.select("fp")).toDF("fa", "fb")
    a, b = (first.select(F.col("fp").alias(f), F.col("first").alias(n)) for f, n in (("fa", "a"), ("fb", "b")))
    return same.unionByName(near.join(a, "fa").join(b, "fb").select("a", "b"))


def _read(batches: Iterator, similar: float) -> Iterator:
    """key, node and label of whole groups, with a function of two arrays of rows: their differing bits, more than ALL if the
    sizes of their sets alone keep them from being similar, and one that tells which bits differ."""
    for key, node, n, label, *prints in runs(batches, ["key", *_CARRIED]):
        yield key, node, label, *_compared(n, prints, similar)


def _compared(n: np.ndarray, prints: list, similar: float) -> tuple:
    prints = [p.view(np.uint64) for p in prints]

    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        bits = sum(np.bitwise_count(p[a] ^ p[b]).astype(np.int16) for p in prints)
        return np.where(np.minimum(n[a], n[b]) >= similar * np.maximum(n[a], n[b]), bits, ALL + 1)

    return apart, lambda a, b: [p[a] ^ p[b] for p in prints]


def _masks(chosen: np.ndarray) -> np.ndarray:
    """Each band's bits of a fingerprint, [band, word]."""
    bits = np.zeros((len(chosen), 64 * WORDS), np.uint8)
    for band, places in enumerate(chosen):
        bits[band, places] = 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _met_before(key: np.ndarray, differ: list, chosen: np.ndarray | None) -> np.ndarray:
    """Whether pairs of rows that meet under these keys, of which these bits differ, also meet in an earlier band."""
    out = np.zeros(len(key), bool)
    if chosen is None or not len(key):
        return out
    band = key >> chosen.shape[1]
    for earlier, mask in enumerate(_masks(chosen)[: band.max()]):
        some = np.flatnonzero((band > earlier) & ~out)
        out[some] = ~np.any([d[some] & m for d, m in zip(differ, mask, strict=True)], axis=0)
    return out


def _chained(similar: float):
    """(a, b): close pairs of rows one or two places apart in their group, and of a group's first row with each other one."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for key, node, _, apart, _ in _read(batches, similar):
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            head = np.repeat(begin, np.diff(np.concatenate([begin, [len(key)]])))
            i = np.arange(len(key))
            found = []
            for step in (1, 2):
                some = i[step:][key[step:] == key[:-step]]
                found.append(np.stack([some - step, some]))
            some = np.flatnonzero(i - head > 2)
            a, b = np.concatenate([*found, np.stack([head[some], some])], axis=1)
            near = apart(a, b) <= ALL
            yield pa.RecordBatch.from_arrays([pa.array(node[a[near]]), pa.array(node[b[near]])], ["a", "b"])

    return work


def _across(key: np.ndarray, label: np.ndarray, apart, differ, lo: int, hi: int, chosen: np.ndarray | None) -> Iterator:
    """(a, b, apart): for some rows of lo:hi at a time, those of other labels that are close enough and haven't met before.

    All rows but those of the largest label are looked at: a pair of unlike labels has one of them at least. Where both
    rows of a pair are looked at, it comes from the first one alone.
    """
    _, kind, n = np.unique(label[lo:hi], return_inverse=True, return_counts=True)
    most = kind == np.argmax(n)
    rows, group = np.flatnonzero(~most), np.arange(hi - lo)
    for at in range(0, len(rows), 64):
        some = rows[at : at + 64]
        bits = apart(lo + some[:, None], lo + group[None])
        i, j = np.nonzero((bits <= ALL) & (kind[some][:, None] != kind[None]) & (most[None] | (some[:, None] < group[None])))
        new = ~_met_before(key[lo + j], differ(lo + some[i], lo + j), chosen)
        i, j = i[new], j[new]
        yield lo + some[i], lo + j, bits[i, j]


def _pairs(similar: float, again: bool = False, chosen: np.ndarray | None = None):
    """(key, a, b, apart): close pairs of unlike label that meet in no earlier band of those chosen, from groups where no row
    is in more than NEAREST of them; of other groups (key, node) of all rows that are in one. With again, every group is
    looked at row by row, as are those of more than GROUP rows otherwise."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        group, names = 0 if again else GROUP, ["key", "a", "b", "apart"]
        for key, node, label, apart, differ in _read(batches, similar):
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.concatenate([begin, [len(key)]]))
            large = np.repeat(size > group, size)
            found = [np.zeros((3, 0), np.int64)]
            i = np.arange(len(key))
            for step in range(1, group):
                i = i[i + step < len(key)]
                i = i[(key[i] == key[i + step]) & ~large[i]]
                if not len(i):
                    break
                unlike = i[label[i] != label[i + step]]
                bits = apart(unlike, unlike + step)
                near, bits = unlike[bits <= ALL], bits[bits <= ALL]
                new = ~_met_before(key[near], differ(near, near + step), chosen)
                found.append(np.stack([near, near + step, bits])[:, new])
            a, b, bits = np.concatenate(found, axis=1)
            of = np.repeat(np.arange(len(size)), size)
            often = np.bincount(np.concatenate([a, b]), minlength=len(key)) > NEAREST
            crowded = np.bincount(of[often], minlength=len(size)) > 0
            passed = np.zeros(len(key), bool)
            passed[np.concatenate([a, b])[crowded[of[np.concatenate([a, b])]]]] = True
            few = ~crowded[of[a]]
            found = [(a[few], b[few], bits[few])]
            for lo, n in zip(begin[size > group].tolist(), size[size > group].tolist(), strict=True):
                held, met = [], np.zeros(n, np.int64)
                for a, b, bits in _across(key, label, apart, differ, lo, lo + n, chosen):
                    met += np.bincount(np.concatenate([a, b]) - lo, minlength=n)
                    held = [*held, (a, b, bits)] if met.max() <= NEAREST else []
                found += held
                passed[lo : lo + n] = (met > 0) & (met.max() > NEAREST)
            a, b, bits = (np.concatenate(c) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(node[a]), pa.array(node[b]), pa.array(bits.astype(np.int64))], names)
            rows = np.flatnonzero(passed)
            if len(rows):
                none = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(node[rows]), none, none], names)

    return work


def _linked(similar: float, chosen: np.ndarray | None = None):
    """(a, b): links by whole sets between rows of unlike label in a group, enough to connect all that such pairs connect.

    Each close pair that meets in no earlier band is compared while its rows are of unlike labels; labels that a link joins are
    one from then on, so that a group has fewer links than rows.
    """

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for key, node, n, label, *prints, sets in _with_sets(batches):
            apart, differ = _compared(n, prints, similar)
            _, kind = np.unique(label, return_inverse=True)
            values, ids = np.unique(np.concatenate(sets), return_inverse=True)
            ends, mark, links = np.cumsum(n), np.zeros(len(values), bool), []
            for a, b, _ in _across(key, label, apart, differ, 0, len(key), chosen):
                for r in np.unique(a).tolist():
                    others = b[a == r]
                    others = others[kind[others] != kind[r]]
                    if not len(others):
                        continue
                    mine = ids[ends[r] - n[r] : ends[r]]
                    mark[mine] = True
                    upto = np.cumsum(n[others])
                    place = np.arange(upto[-1]) + np.repeat(ends[others] - upto, n[others])
                    common = np.add.reduceat(mark[ids[place]].astype(np.int64), upto - n[others])
                    mark[mine] = False
                    for j in others[common / (n[r] + n[others] - common) >= similar].tolist():
                        if kind[j] != kind[r]:
                            links.append((node[r], node[j]))
                            kind[kind == kind[j]] = kind[r]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*links, strict=True)], ["a", "b"])

    return work


def _with_sets(batches: Iterator) -> Iterator:
    """key, node, n, label, fingerprint and list of sets of the rows of one group after the other, from batches sorted by key."""
    names, held = ["key", *_CARRIED], []

    def whole() -> tuple:
        return *(np.concatenate([h[c] for h in held]) for c in range(len(names))), [x for h in held for x in h[-1]]

    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        sets = batch.column("set")
        flat, at = sets.values.to_numpy(), sets.offsets.to_numpy()
        own = [flat[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        key = columns[0]
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and lo < hi and held[-1][0][-1] != key[lo]:
                yield whole()
                held = []
            if lo < hi:
                held.append((*(c[lo:hi] for c in columns), own[lo:hi]))
    if held:
        yield whole()


def _sets(ends: DataFrame, nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """node, set (its shingles' hashes) of these nodes, each from the text of one of its rows."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for texts, node in chunked(batches, ["node"]):
            doc, hashes = shingles(texts, width)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))], ["node", "set"])

    named = nodes.join(ends.distinct(), "node", "left_semi").select("node", "row.k1", "row.k2")
    texts = docs.select(*row_key(), F.col("text").cast("string")).join(named, ["k1", "k2"]).select("node", "text")
    return stash(texts.mapInArrow(work, "node bigint, set array<bigint>").dropDuplicates(["node"]), "shingles")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).distinct().union(pairs.select("b").distinct())


def _verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """a, b of the pairs whose sets of shingles have at least this Jaccard similarity."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("set").alias(f"s{c}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return stash(both.where(common / (F.size("sa") + F.size("sb") - common) >= similar).select("a", "b"), "links")


def _once(pairs: DataFrame) -> DataFrame:
    """a, b (a < b), apart of pairs in any order, each once."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "apart").where("a <> b").groupBy("a", "b").agg(F.min("apart").alias("apart"))


def _placed(pairs: DataFrame) -> DataFrame:
    """a, b, place of pairs a, b, apart: the pair is the so-manieth nearest of one of the two, at least."""
    place = lambda c, other: F.row_number().over(Window.partitionBy(c).orderBy("apart", other))
    return pairs.select("a", "b", F.least(place("a", "b"), place("b", "a")).alias("place"))


def _nearest_first(pairs: DataFrame, most: int) -> DataFrame:
    """a, b of the pairs that are among the so many nearest of one of the two."""
    return _placed(pairs).where(F.col("place") <= most).select("a", "b")


def groups(docs: DataFrame, width: int = WIDTH, similar: float = SIMILAR) -> DataFrame:
    """k1, k2, doc_id and root for each row of docs: rows of one root are linked by pairs at least so similar.

    Rows alike in their sets of shingles are one node. Nodes meet by deletion variants of their fingerprints' first 64
    bits and as neighbours in a few bands of bits; what meets is compared by whole fingerprints in the tasks where it
    meets, then by whole sets, so every link is exact. Then, in all bands, every pair of unlike components in a group that
    is at most ALL bits apart and of sizes that can be similar is compared by whole sets, in the first band where it
    meets: as pairs from groups where no row is in more than NEAREST of them, in the group's own task otherwise. None is
    left out. Copies of one text are never paired, and no group's pairs are written out. Texts are dealt out
    twice: for the sets of what meets first, and of all that is compared later.

    A null text is one without words; such rows are alike. Repeated rows are one node; null and repeated doc_ids are as
    others. Other columns play no part; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = stash(sketches(docs, width), "sketches")
    # Rows of one node agree in n and fingerprint.
    nodes = stash(rows.groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("row"), *(F.min(c).alias(c) for c in ("n", *_WORDS))), "nodes")
    chosen = bands(nodes.count(), similar)
    parts = partitions(docs.sparkSession)
    named = lambda d, roots: d.join(roots.select("node", F.col("root").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
    grouped = lambda d: d.repartition(parts, "key").sortWithinPartitions("key", "w0", "node")

    first = grouped(_banded(nodes.withColumn("label", F.col("node")), chosen[:FIRST_BANDS])).mapInArrow(_chained(similar), "a bigint, b bigint")
    met = first.unionByName(_by_variants(nodes)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    met = stash(met.where("a <> b").distinct(), "candidates")
    sets = _sets(_ends(met), nodes, docs, width)
    links = _verified(met, sets, similar)
    roots = stash(components(links), "roots")
    for done in (met, sets, links):
        discard(done)
    found = stash(grouped(_banded(named(nodes, roots), chosen)).mapInArrow(_pairs(similar, chosen=chosen), "key bigint, a bigint, b bigint, apart bigint"), "found")
    left = stash(_placed(_once(found.where("key IS NULL"))), "turn")
    members = found.where("key IS NOT NULL").select("key", F.col("a").alias("node"))
    sets = _sets(_ends(left).union(members.select("node")), nodes, docs, width)

    def joined(roots: DataFrame, more: DataFrame) -> DataFrame:
        """roots after these links: what was linked before is linked to its root."""
        after = roots if more.isEmpty() else stash(components(roots.toDF("a", "b").union(more)), "roots")
        discard(more)
        if after is not roots:
            discard(roots)
        return after

    def unlike(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        label = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"of_{c}"))
        return pairs.join(label("a"), "a", "left").join(label("b"), "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")

    roots = joined(roots, _verified(left.where(F.col("place") <= AT_FIRST), sets, similar))
    roots = joined(roots, _verified(unlike(left.where(F.col("place") > AT_FIRST), roots), sets, similar))
    if not members.isEmpty():
        crowded = grouped(named(members.join(nodes.drop("row"), "node"), roots).join(sets, "node").select("key", *_CARRIED, "set"))
        roots = joined(roots, stash(crowded.mapInArrow(_linked(similar, chosen), "a bigint, b bigint"), "links"))
    for done in (found, left, sets):
        discard(done)
    return rows.join(roots, "node", "left").select("k1", "k2", "doc_id", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, width: int = WIDTH, similar: float = SIMILAR) -> DataFrame:
    """The first row of each group of near copies, with all its columns; an empty table gives no rows."""
    return first_of_each(docs, groups(docs, width, similar))
