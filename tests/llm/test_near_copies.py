"""The pipeline's near-copy stage against brute-force Jaccard similarity of 5-word shingles."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from deltasieve.llm import exact_dedup, near_copies, simhash

SCHEMA = "doc_id bigint, text string, lang string"
WORDS = [f"{a}{b}" for a in "stone river paper green window seven bright mountain".split() for b in "abcdefgh"]


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar_pairs(texts, similar=0.8):
    """(i, j) of at least this similarity, by counting the shingles each two share."""
    sets = [shingle_set(t) for t in texts]
    at = defaultdict(list)
    common = Counter()
    for i, s in enumerate(sets):
        for x in s:
            common.update((j, i) for j in at[x])
            at[x].append(i)
    return {(i, j) for (i, j), n in common.items() if n / (len(sets[i]) + len(sets[j]) - n) >= similar}


def roots_of(n, pairs):
    root = list(range(n))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    bases = [rng.choices(WORDS, k=rng.choice([12, 60, 150, 400])) for _ in range(60)]
    out = bases + [edited(rng, b, max(1, len(b) // k)) for b in bases for k in (25, 50, 100)]
    return list(dict.fromkeys(" ".join(t) for t in out))


def test_groups_are_those_of_brute_force(spark, texts):
    pairs = similar_pairs(texts)
    want = roots_of(len(texts), pairs)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r["doc_id"]: r["root"] for r in near_copies.groups(docs).collect()}
    for i in range(len(texts)):
        assert all(want[i] == want[j] for j in range(i) if got[i] == got[j])  # every link is exact
    linked = sum(got[i] == got[j] for i, j in pairs)
    assert len(pairs) > 60 and linked >= 0.97 * len(pairs)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert len(kept) == len(set(got.values())) and {min(i for i in got if got[i] == g) for g in got.values()} == kept


def test_large_groups_lose_no_pair(spark, monkeypatch):
    """With bands shared by all, what chain and star leave apart is found across components."""
    rng = random.Random(5)
    bases = [rng.choices(WORDS, k=100) for _ in range(8)]
    mixed = [" ".join(edited(rng, rng.choice(bases), 2)) for _ in range(60)]
    texts = list(dict.fromkeys(mixed))
    monkeypatch.setattr(near_copies, "GROUP", 4)
    monkeypatch.setattr(near_copies, "bands", lambda n, s: np.zeros((1, 0), np.int64))
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r["root"] for r in near_copies.groups(docs).collect()}
    want = roots_of(len(texts), similar_pairs(texts))
    assert len(set(got.values())) == len(set(want))


def test_edges(spark):
    rng = random.Random(6)
    long = [" ".join(rng.choices(WORDS, k=300)) for _ in range(3)]
    rows = [(None, t, "en") for t in long] + [(7, long[0].upper(), "en"), (8, None, None), (9, " \n", None), (10, "a b", "en"), (11, "A  b", "en"), (12, "a", "en")]
    kept = near_copies.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 0, 7, 8, 10, 12]
    assert near_copies.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_real_near_copies(spark):
    docs = exact_dedup.drop_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    ids, texts = zip(*rows, strict=True)
    pairs = similar_pairs(texts)
    kept = {r["doc_id"] for r in near_copies.keep_one(docs).collect()}
    assert pairs and not any(ids[i] in kept and ids[j] in kept for i, j in pairs)
    before = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert any(ids[i] in before and ids[j] in before for i, j in pairs)


def test_fingerprints_meet_by_deletion_variants(spark):
    prints = [0, 1, 1 | 1 << 40, 0, 0b11111 << 20, 0b1111 << 20]
    nodes = spark.createDataFrame(list(enumerate(prints)), "node bigint, w0 bigint")
    root = roots_of(len(prints), [tuple(r) for r in near_copies._by_variants(nodes).collect()])
    assert root == [0, 0, 0, 0, 4, 4]


def test_a_turn_verifies_the_nearest_pairs_of_each_row(spark):
    pairs = [(a, b, b - a) for a in range(40) for b in range(a + 1, 40)]
    got = near_copies._nearest_first(spark.createDataFrame(pairs, "a bigint, b bigint, apart bigint"), 2).collect()
    assert {tuple(r) for r in got} == {(a, b) for a, b, n in pairs if n <= 2}


def test_few_edges_take_no_broadcast(spark):
    """Of no more edges than a hub has neighbours, rounds join plainly, once; the components are as before."""
    from pyspark.sql import functions as F

    from deltasieve.llm import _components

    edges = spark.range(300).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    plan = _components._lowest(edges, least, 600)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan and plan.count("Join") == 1
    assert {tuple(r) for r in _components.components(edges.repartition(7)).collect()} == {(i, 0) for i in range(301)}


def test_texts_are_dealt_out_twice_whatever_the_number_of_turns(spark, texts, monkeypatch):
    """Shingle sets are made for what meets first and for all that is proposed later, not again in each turn."""
    names = []
    stash = near_copies.stash
    monkeypatch.setattr(near_copies, "stash", lambda df, name: names.append(name) or stash(df, name))
    monkeypatch.setattr(near_copies, "GROUP", 2)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r["doc_id"]: r["root"] for r in near_copies.groups(docs).collect()}
    assert names.count("turn") > 0 and names.count("shingles") == 2
    want = roots_of(len(texts), similar_pairs(texts))
    assert len({(got[i], r) for i, r in enumerate(want)}) == len(set(want)) == len(set(got.values()))


def test_whole_fingerprints_and_sizes_part_rows_where_they_meet():
    """Rows alike in their first 64 bits alone, or of unlike sizes, are not proposed; those of one label neither."""
    import pyarrow as pa

    rows = [  # key, node, n, label, w0..w3
        (1, 10, 50, 10, 0, 0, 0, 0),
        (1, 11, 50, 11, 1, 0, 0, 0),
        (1, 12, 50, 12, 0, -1, 0, 0),
        (1, 13, 90, 13, 0, 0, 0, 0),
        (1, 14, 50, 10, 3, 0, 0, 0),
    ]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["key", *near_copies._CARRIED])
    for again in (False, True):
        found = {(r["a"], r["b"], r["apart"]) for out in near_copies._pairs(0.8, again)([batch]) for r in out.to_pylist() if r["key"] is None}
        assert {(*sorted(f[:2]), f[2]) for f in found} == {(10, 11, 1), (11, 14, 1)}


def test_few_edges_take_no_rounds(spark, monkeypatch):
    """Up to FEW edges are drawn together in one task, more in rounds, with the same components."""
    from deltasieve.llm import _components

    edges = spark.range(300).select((F.col("id") * 7 % 300 + 1).alias("a"), (F.col("id") * 7 % 300).alias("b")).repartition(7)
    rounds = []
    lowest = _components._lowest
    monkeypatch.setattr(_components, "_lowest", lambda *a: rounds.append(1) or lowest(*a))
    got = {tuple(r) for r in _components.components(edges).collect()}
    assert got == {(i, 0) for i in range(301)} and not rounds
    monkeypatch.setattr(_components, "FEW", 0)
    assert {tuple(r) for r in _components.components(edges).collect()} == got and rounds


def test_ends_of_pairs_are_not_written_out_for_each_pair(spark):
    pairs = spark.createDataFrame([(a, b) for a in range(20) for b in range(a + 1, 20)], "a bigint, b bigint")
    ends = near_copies._ends(pairs)
    assert "Generate" not in ends._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["node"] for r in ends.collect()) == sorted([*range(19), *range(1, 20)])


@pytest.mark.parametrize("group", [64, 4])
def test_rows_that_are_not_among_the_nearest_are_compared_too(spark, monkeypatch, group):
    """Texts that are alike to one only, of many that are about as near by fingerprint, are still its copies."""
    rng = random.Random(8)
    base = rng.choices(WORDS, k=150)
    with_new = lambda at: [f"x{rng.randrange(10**9)}" if i in at else w for i, w in enumerate(base)]
    texts = [" ".join(with_new((20,)))] + [" ".join(with_new((40 + 2 * rng.randrange(20), 90 + 2 * rng.randrange(20)))) for _ in range(58)]
    monkeypatch.setattr(near_copies, "GROUP", group)
    monkeypatch.setattr(near_copies, "bands", lambda n, s: np.zeros((1, 0), np.int64))
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r["root"] for r in near_copies.groups(docs).collect()}
    want = roots_of(len(texts), similar_pairs(texts))
    assert len(set(want)) == 1 and len(set(got.values())) == 1


def test_a_pair_is_compared_in_the_first_band_where_it_meets():
    """Rows alike in their bits of two bands are a pair in the first one, and in the second where they meet there alone."""
    import pyarrow as pa

    chosen = np.array([[0, 1], [2, 3]])
    rows = [  # key (band, two bits), node, n, label, w0..w3
        (0b000, 10, 50, 10, 0, 0, 0, 0),
        (0b000, 11, 50, 11, 1 << 9, 0, 0, 0),
        (0b001, 12, 50, 12, 2, 0, 0, 0),
        (0b100, 10, 50, 10, 0, 0, 0, 0),
        (0b100, 11, 50, 11, 1 << 9, 0, 0, 0),
        (0b100, 12, 50, 12, 2, 0, 0, 0),
    ]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["key", *near_copies._CARRIED])
    for again in (False, True):
        found = [(*sorted((r["a"], r["b"])), r["apart"]) for out in near_copies._pairs(0.8, again, chosen)([batch]) for r in out.to_pylist()]
        assert sorted(found) == [(10, 11, 1), (10, 12, 1), (11, 12, 2)]
