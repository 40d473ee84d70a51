"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltasieve.llm import bpe, chat, embedding_dedup, exact_dedup, langid, lm_scoring, mixing, quality, simhash, substring_dedup
from deltasieve.llm._common import remainder
from deltasieve.llm._components import components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, k bigint, h string, row string, size int, shard int, fp string, sha string"
WORDS = "the of and to in river stone green quickly mountain paper window seven bright".split()


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), 1, "h", "r", 2, 3, "f", "s")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    prose = [" ".join(rng.choices(WORDS, k=rng.randint(3, 90))) for _ in range(40)]
    shared = " ".join(rng.choices(WORDS, k=50))
    out = [doc(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None])) for i, t in enumerate(prose)]
    out += [doc(100 + i, f"{p}\n{shared}  {q}") for i, (p, q) in enumerate(zip(prose[:6], prose[6:12]))]
    out += [doc(200 + i, prose[0].replace(" ", "\t ")) for i in range(5)] + [doc(200, prose[0].replace(" ", "\t "))] * 2
    out += [doc(300, None), doc(301, ""), doc(302, "  \n"), doc(None, "null id text"), doc(None, None), doc(303, "§§ 12 !!"), doc(304, None, None, None)]
    out += [doc(400, " ".join(rng.choices(WORDS, k=60_000))), doc(401, "same " * 500)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def test_exact_duplicates(docs, rows, empty):
    import re

    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    size = Counter(norm(r[1]) for r in rows)
    least = {}
    for r in rows:
        if r[0] is not None:
            least[norm(r[1])] = min(r[0], least.get(norm(r[1]), r[0]))
    got = exact_dedup.exact_duplicates(docs, capacity=4).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in size}
    for r in got:
        t = by_sha[r["text_sha256"]]
        assert (r["group_size"], r["keep_id"]) == (size[t], least.get(t))
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(list(by_sha))
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(size)
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_directory_doubles():
    cells = np.zeros(16, np.int64)
    cells[[0, 1, 2, 9]] = [5, 1, 1, 40]
    depth, slots, buckets = exact_dedup.build_directory(cells, 4)
    assert depth == 4 and len(slots) == 16
    for i, s in enumerate(slots):
        local, prefix = buckets[s]
        assert i >> (depth - local) == prefix
        assert local == 4 or sum(cells[j] for j in range(16) if j >> (4 - local) == prefix) <= 4


def repeats(rows, length):
    seen = Counter(tuple(w[i : i + length]) for w in (words(r[1]) for r in rows) for i in range(len(w) - length + 1))
    out = []
    for r in rows:
        w = words(r[1])
        bad = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                bad[i : i + length] = [True] * length
        out.append((r[0], len(w), sum(bad), b" ".join(x for x, b in zip(w, bad, strict=True) if not b).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length,held", [(35, 1_000_000), (35, 50), (8, 200)])
def test_remove_repeats(docs, rows, empty, length, held):
    some = [r for r in rows if r[0] != 400 or length == 35]
    got = substring_dedup.remove_repeats(docs.where("doc_id IS NULL OR doc_id <> 400 OR " + str(length == 35).lower()), length, held=held)
    assert sorted(map(tuple, got.collect()), key=str) == repeats(some, length)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_levels():
    assert substring_dedup.levels(35) == [9, 18, 35]
    assert substring_dedup.levels(5) == [5]


def test_mixing(docs, rows, empty):
    mixed = mixing.mix(docs, ["doc_id", "source"]).select("row.*", "size", "source_size", "target", "taken", "draws").collect()
    assert len(mixed) == len(rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, total, open_ = {}, float(sum(size.values())), set(order)
    while True:  # reshare what is above until nothing is
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * size[s]}
        if not over:
            break
        target |= {s: 3.0 * size[s] for s in over}
        open_ -= over
    target |= {s: weight[s] * level for s in open_}
    for s in order:
        some = [r for r in mixed if r["source"] == s]
        assert some[0]["target"] == pytest.approx(target[s])
        assert abs(sum(r["taken"] for r in some) - target[s]) <= max(r["size"] for r in some) / 2 + 1
        assert all(r["taken"] <= 3 * r["size"] for r in some)
        assert all(len(r["draws"]) * r["size"] == r["taken"] for r in some)
    made = mixing.materialise(docs, shard_column="out")
    assert made.columns == [*docs.columns, "out"]
    assert sum(len(words(r["text"])) for r in made.collect()) == sum(r["taken"] for r in mixed)
    assert mixing.mix(empty, ["doc_id"]).count() == 0 and mixing.materialise(empty).count() == 0


def test_split_is_exact(spark):
    quotas = spark.createDataFrame([("a", 1000), ("b", 37), ("c", 1), ("d", 0)], "_sk string, _quota bigint")
    parts = mixing.split_quotas(quotas, 8).collect()
    total = Counter()
    for r in parts:
        assert r["quota"] >= 0
        total[r["_sk"]] += r["quota"]
    assert total == {"a": 1000, "b": 37, "c": 1, "d": 0}
    by_shard = Counter()
    for r in parts:
        by_shard[r["shard"]] += r["quota"]
    assert max(by_shard.values()) - min(by_shard.values()) <= 1


def test_hypergeometric_has_its_mean(spark):
    draw = mixing._hypergeometric(F.lit(30).cast("bigint"), F.lit(100).cast("bigint"), F.lit(40).cast("bigint"), F.col("id"))
    got = [r[0] for r in spark.range(3000).select(draw).collect()]
    assert abs(np.mean(got) - 12) < 0.2
    assert abs(np.var(got) - 40 * 0.3 * 0.7 * 60 / 99) < 0.5


def test_bpe_equals_the_library(docs, rows, empty):
    import public_tokenizers as tokenizers
    import tiktoken

    path = tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    got = bpe.encode(docs, path, tokenizers.PATTERN).collect()
    want = sorted((str(r[0]), np.array(library.encode_ordinary(r[1] or ""), "<u4").tobytes(), (r[1] or "").encode()) for r in rows)
    assert sorted((str(r["doc_id"]), bytes(r["ids"]), bytes(r["decoded"])) for r in got) == want
    own = bpe.Bpe(tokens, tokenizers.PATTERN)
    rng = random.Random(3)
    for _ in range(4000):
        piece = bytes(rng.choice(b"abcdefgh eintaosr!.\xc3\xa9\xff012\n") for _ in range(rng.randint(1, 30)))
        assert own.encode_piece(piece) == library._encode_single_piece(piece)
    assert bpe.digests(empty, path, tokenizers.PATTERN).count() == 0


def test_simhash(docs, rows, empty):
    import xxhash

    def fingerprint(text):
        w = (text or "").encode().lower().split()
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), r["fp"] % 2**64) for r in got) == sorted((str(r[0]), fingerprint(r[1])) for r in rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r["component_id"] for r in got})
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_simhash_keeps_unrelated_rows_of_null_or_shared_id(spark):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(50)) for _ in range(8)]
    rows = [doc(None, t) for t in texts[:4]] + [doc(None, texts[0])] + [doc(5, t) for t in texts[4:]] + [doc(5, texts[4]), doc(6, texts[4])]
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r["text"] for r in kept.collect()) == sorted(texts)


def test_variant_edges_find_all_links(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    flips = [b ^ (np.uint64(1) << np.uint64(i)) ^ (np.uint64(1) << np.uint64(j)) for b in base[:20] for i, j in rng.integers(0, 64, (6, 2))]
    fp = np.unique(np.concatenate([base, np.array(flips, np.uint64), np.array([0, 1, 3, 7, 2**64 - 1], np.uint64)]))
    label = np.arange(len(fp))
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= 2
    while True:
        least = np.where(near, label[None], len(fp)).min(axis=1)
        if (least == label).all():
            break
        label = least
    table = spark.createDataFrame([(int(f),) for f in fp.view(np.int64)], "fp bigint")
    roots = {r["node"]: r["root"] for r in components(simhash.variant_edges(table)).collect()}
    group = {}
    for f, at in zip(fp.view(np.int64).tolist(), label.tolist(), strict=True):
        group.setdefault(at, set()).add(roots.get(f, f))
    assert all(len(g) == 1 for g in group.values()) and len(set().union(*group.values())) == len(group)
    parts = simhash._spanning(fp, 2, dense=4)
    assert {tuple(sorted(x)) for x in zip(*parts, strict=True)} <= {(a, b) for i, a in enumerate(fp) for b in fp[i + 1 :]}


@pytest.mark.parametrize("bits", [0, 1, 3, 4, 5])
def test_variant_edges_of_other_distances(spark, bits):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    flipped = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, n, replace=False).astype(np.uint64)) for b in base for n in (1, 2, 3, 4, 5, 6)]
    flipped += [np.uint64(0), np.uint64(0b11 | 0b11 << 32), np.uint64(2**64 - 1)]
    fp = np.unique(np.concatenate([base, np.array(flipped, np.uint64)]))
    near = {(int(a), int(b)) for i, a in enumerate(fp) for b in fp[i + 1 :] if int(a ^ b).bit_count() <= bits}
    table = spark.createDataFrame([(int(f),) for f in fp.view(np.int64)], "fp bigint")
    roots = {r["node"] % 2**64: r["root"] for r in components(simhash.variant_edges(table, bits)).collect()}
    assert all(roots[a] == roots[b] for a, b in near)
    assert len(roots) - len(set(roots.values())) == len({x for p in near for x in p}) - len(groups_of(near))
    a, b = simhash._spanning(fp, bits, dense=4)
    assert groups_of({(int(x), int(y)) for x, y in zip(a, b, strict=True)}) == groups_of(near)
    with pytest.raises(ValueError):
        simhash.segments(16)


def groups_of(pairs):
    """The connected sets of pairs, by repeated merging."""
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    out = {}
    for x in root:
        out.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, out.values()))


def test_components_with_hubs(spark, monkeypatch):
    from deltasieve.llm import _components

    monkeypatch.setattr(_components, "HUB", 3)
    rng = random.Random(5)
    edges = {(rng.randrange(300), rng.randrange(300)) for _ in range(250)} | {(500, i) for i in range(1000, 1100)} | {(i, 7) for i in range(40, 90)}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(sorted(edges), "a bigint, b bigint")).collect()}
    want = {x: g[0] for g in groups_of({e for e in edges if e[0] != e[1]}) for x in g}
    assert got == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 175)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100, 150: 150, 175: 150, 200: 150}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 16))
    x = np.concatenate([base, base[:60] + rng.normal(size=(60, 16)) * 0.35, base[:20], base[:5] * 3]).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, []), (904, [1.0, None]), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (None, [1.0] * 16)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<float>, label int, n int")
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    label = np.arange(len(x))
    while True:
        least = np.where(near, label[None], len(x)).min(axis=1)
        if (least == label).all():
            break
        label = least
    for interval in (32, 4096):
        got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(table, interval=interval).collect()}
        assert len(got) == len(rows)
        for i in range(len(x)):
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[i].sum() - 1, label[i], label[i] == i)
        assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (900, 901, 902, 903, 904, None))
        assert got[905]["n_links"] == 1 and got[906]["component_id"] == 905
    assert embedding_dedup.near_vectors(table.limit(0)).count() == 0


def test_embeddings_without_or_with_repeated_ids(spark):
    near, far = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0]
    rows = [(7, near), (None, [1.0, 0.05, 0.1]), (None, near), (5, far), (5, [2e200, 0.0, 1e199]), (None, [0.0, 0.0, 1.0])]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert sorted(map(str, ((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got))) == sorted(map(str, [(7, 3, 5, False), (None, 3, 5, False), (None, 3, 5, False), (5, 0, 5, True), (5, 3, 5, True), (None, 0, None, True)]))


TONGUES = {"en": "the quick brown fox jumps over lazy dogs while children play outside near water", "xx": "zorg blatu krim nopf vlask drubin qwelt jorpa mizk tolv", "yy": "aeio uoie iaou eeio oaui ieoa uaei aoue"}


def test_language_id(spark, docs, rows, empty):
    rng = random.Random(6)
    text = lambda lang, n: " ".join(rng.choices(TONGUES[lang].split(), k=n))
    train = spark.createDataFrame([(i, text(lang, 40), lang) for i, lang in enumerate(["en", "xx", "yy"] * 15)] + [(900, None, "en"), (901, "zz", None)], "doc_id bigint, text string, lang string")
    langs, table = langid.learn(train)
    assert langs == ["en", "xx", "yy"]
    test = spark.createDataFrame([(1, text("xx", 9)), (2, text("yy", 5)), (3, text("en", 60) + " " + text("xx", 40)), (4, None), (5, "12 !!"), (6, ""), (7, text("en", 30_000))], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in langid.identify(test, langs, table).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 8)] == ["xx", "yy", "en", "und", "und", "und", "en"]
    assert set(got[3]["langs"]) == {"en", "xx"} and got[3]["score"] == pytest.approx(0.6, abs=0.1)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(docs, langs, table).count() == len(rows)
    assert langid.identify(empty, langs, table).count() == 0
    none, nothing = langid.learn(empty)
    assert {r["lang_pred"] for r in langid.identify(test, none, nothing).collect()} == {"und"}


def test_language_id_is_a_function_of_the_text_alone(spark):
    rng = random.Random(12)
    text = lambda lang, n: " ".join(rng.choices(TONGUES[lang].split(), k=n))
    labelled = [(i, text(lang, 30) + rng.choice(["", " ", "\n", "é", "!"]), lang) for i, lang in enumerate(["en", "xx", "yy"] * 30)]
    tests = [(i, rng.choice(["ok", "q", "é", " ok", "ok ", text("en", 2), text("xx", 3) + text("yy", 4), text("yy", 200), "1", None])) for i in range(400)]
    seen: dict = {}
    for turn in range(3):
        rng.shuffle(labelled)
        rng.shuffle(tests)
        langs, table = langid.learn(spark.createDataFrame(labelled, "doc_id bigint, text string, lang string").repartition(turn + 1))
        for r in langid.identify(spark.createDataFrame(tests, "doc_id bigint, text string").repartition(2 * turn + 1), langs, table).collect():
            seen.setdefault(dict(tests)[r["doc_id"]], set()).add(tuple(map(str, (r["lang_pred"], r["score"], r["langs"], r["shares"]))))
    assert all(len(results) == 1 for results in seen.values())


def plain_mixture(text, table):
    """The same mixture, word by word: all languages, then the best nested set."""
    fold = lambda b: 32 if b in (9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b
    data = b"  " + bytes(map(fold, text)) + b"  "
    like = []
    at = 2
    while at < len(data) - 2:
        end = at
        while data[end] != 32:
            end += 1
        if end > at:
            cells = [langid._cells(data[i - 2 : i + 1])[2] for i in range(at, end + 1)]
            log = table[:, cells].astype(float).sum(axis=1) / 3
            like.append(np.exp(log - log.max()) + 1e-12)
        at = end + 1
    like, n = np.array(like), len(like)

    def em(share, steps):
        for _ in range(steps):
            part = like * share
            share = (part / part.sum(axis=1, keepdims=True)).mean(axis=0)
        return share, np.log((like * share).sum(axis=1)).sum()

    share, _ = em(np.full(len(table), 1 / len(table)), langid.STEPS)
    order, fee = np.argsort(-share, kind="stable"), langid.PENALTY + 0.5 * np.log(n)
    best = np.eye(len(table))[order[0]]
    value = np.log(like[:, order[0]]).sum() - fee
    for k in range(2, len(table) + 1):
        if share[order[k - 1]] * n <= 0.5:
            break
        some = np.zeros(len(table))
        some[order[:k]] = share[order[:k]]
        fitted, fit = em(some / some.sum(), langid.FEWER_STEPS)
        if fit - k * fee > value:
            best, value = fitted, fit - k * fee
    return best


def test_language_mixtures_equal_plain_ones(spark):
    rng = random.Random(13)
    text = lambda lang, n: " ".join(rng.choices(TONGUES[lang].split(), k=n))
    langs, table = langid.learn(spark.createDataFrame([(text(lang, 40), lang) for lang in ["en", "xx", "yy"] * 20], "text string, lang string"))
    texts = [" ".join(text(lang, rng.randint(1, 40)) for lang in rng.sample(langs, rng.randint(1, 3))).encode() for _ in range(60)]
    for got, one in zip(langid.mixture(texts, table), texts, strict=True):
        assert got == pytest.approx(plain_mixture(one, table), abs=2e-3)


def test_language_id_of_more_than_three_languages(spark):
    rng = random.Random(8)
    tongues = TONGUES | {"zz": "hxk pwtq gdbv ccnm lrrs zhhj vvwx bpkg", "qq": "ilulu anana umumu ororo ububu ededo isisa okoko"}
    text = lambda lang, n: " ".join(rng.choices(tongues[lang].split(), k=n))
    langs, table = langid.learn(spark.createDataFrame([(i, text(lang, 60), lang) for i, lang in enumerate(list(tongues) * 15)], "doc_id bigint, text string, lang string"))
    mixed = lambda names: " ".join(text(lang, 60) for lang in names)
    rows = [(4, mixed(["en", "xx", "yy", "zz"])), (5, mixed(tongues)), (2, mixed(["en", "xx"]))]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id bigint, text string"), langs, table).collect()}
    assert {i: len(r["langs"]) for i, r in got.items()} == {2: 2, 4: 4, 5: 5}
    assert got[4]["shares"] == pytest.approx([0.25] * 4, abs=0.05) and got[5]["shares"] == pytest.approx([0.2] * 5, abs=0.05)


def test_quality(spark, empty):
    rng = random.Random(9)
    good = lambda: " ".join(rng.choices(WORDS, k=60))
    bad = lambda: "!!! ".join(w.upper() for w in rng.choices(WORDS[:3], k=60))
    rows = [doc(i, good() if i % 3 else bad(), "en", f"s{i % 4}") for i in range(240)] + [doc(900, None), doc(None, "x"), doc(5, good())]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(120)] + [(1, None, 0), (5000, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.score(docs, labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["doc_id"] is not None and 120 <= r["doc_id"] < 240]
    assert np.mean([r["keep"] == (r["doc_id"] % 3 > 0) for r in held]) > 0.97
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["keep"] for r in got)
    assert all(r["keep"] for r in quality.score(docs, labels.limit(0)).collect())
    assert quality.score(empty, labels).count() == 0


def test_quality_equals_plain_co_training(spark):
    rng = random.Random(17)
    good = lambda: " ".join(rng.choices(WORDS, k=rng.randint(5, 60)))
    bad = lambda: "!! ".join(w.upper() for w in rng.choices(WORDS[:4], k=rng.randint(5, 60)))
    rows = [(i, good() if rng.random() < (0.9 if i % 3 else 0.1) else bad(), "en", f"s{i % 3}{i % 2}", 100 + i % 7) for i in range(400)]
    rows += [(None, good(), None, None, None), (7, None, None, "s0", None), (9, bad(), "de", "s1", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    label = {i: float(i % 3 > 0) for i in range(0, 150) if i not in (7, 9)}
    labels = spark.createDataFrame([(i, int(v), 0) for i, v in label.items()], "doc_id bigint, quality int, toxic int")
    x = {i: np.concatenate([quality.text_view([(t or "").encode()]), quality.meta_view([s], [g], [n])], axis=1)[0] for i, (_, t, g, s, n) in enumerate(rows)}
    order = sorted(label, key=lambda i: zlib.crc32(str(i).encode()))
    known, y = np.stack([x[i] for i in order]), np.array([label[i] for i in order])
    others = np.stack([x[i] for i, r in enumerate(rows) if r[0] not in label])
    cut = lambda m: (m[:, : quality.TEXT_WIDTH], m[:, quality.TEXT_WIDTH :])

    def ask(models):
        out = []
        for view in (0, 1):
            gradient, count = np.zeros((2, len(models[view].weight))), np.zeros(2)
            for row in others:
                parts = cut(row[None])
                sure = models[1 - view].logit(parts[1 - view])[0]
                if abs(sure) >= quality.SURE:
                    lab = int(sure > 0)
                    p = 1 / (1 + np.exp(-models[view].logit(parts[view])[0]))
                    gradient[lab] += (lab - p) * models[view].rows(parts[view])[0]
                    count[lab] += 1
            out.append((gradient, count))
        return out

    model = quality.co_train(*cut(known), y, ask)
    want = sorted((str(r[0]), *np.round(model.scores(*cut(x[i][None]))[0], 4).tolist()) for i, r in enumerate(rows))
    got = sorted((str(r["doc_id"]), *(round(r[c], 4) for c in ("text_score", "meta_score", "score"))) for r in quality.score(docs, labels).collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.abs(np.array([g[1:] for g in got]) - np.array([w[1:] for w in want])).max() < 2e-3
    assert quality.keep_good(docs.drop("n_chars", "lang"), labels).columns == ["doc_id", "text", "source"]
    tied = spark.createDataFrame([(i, k, 0) for i in range(20) for k in (0, 1)], labels.schema)
    assert all(r["keep"] for r in quality.score(docs, tied).collect())


def test_lm_scores(docs, rows, empty):
    import base64

    import public_tokenizers as tokenizers

    with open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    count = Counter()
    for r in rows:
        if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2:
            count.update(tokens(r[1]))
    n, v = sum(count.values()), len(count)
    want = sorted((str(r[0]), len(tokens(r[1])), sum(count[t] > 0 for t in tokens(r[1])), round(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens(r[1])), 5)) for r in rows)
    got = lm_scoring.score(docs, remainder(7) != 2, ranks, tokenizers.PATTERN).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert sum(r["score"] for r in got) > 1.1 * sum(r["base_score"] for r in got)  # words drawn alike: nothing to learn
    assert lm_scoring.score(empty, remainder(7) != 2, ranks, tokenizers.PATTERN).count() == 0


def trained(ids, size, starts):
    near = np.zeros((size, 2 * lm_scoring.NEIGHBOURS))
    np.add.at(near, (ids[1:], ids[:-1] % lm_scoring.NEIGHBOURS), 1)
    model = lm_scoring.Attention.fresh(np.bincount(ids, minlength=size), near, starts)
    model.train(ids)
    return model


def test_lm_windows_score_each_token_once_and_add_up():
    import base64

    import public_tokenizers as tokenizers

    with open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    tools = lm_scoring.Subwords(ranks, tokenizers.PATTERN)
    rng = random.Random(2)
    ids, _ = tools.words([w.encode() for w in rng.choices(WORDS, k=900)])
    model = trained(ids, tools.size, tools.starts)
    sizes = [0, 1, 23, 24, 25, 40, 41, 200]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    log, over = model.score(ids[: begin[-1]], begin, batch=7)
    assert np.isfinite(log).all() and (over <= 1e-6).all()
    for i, n in enumerate(sizes):  # a sequence's scores do not depend on what else is scored
        alone, _ = model.score(ids[begin[i] : begin[i] + n], np.array([0, n]))
        assert alone == pytest.approx(log[begin[i] : begin[i] + n], abs=1e-4)
    y, _ = model.forward(model.cls[ids[:24]][None], 0)
    p = np.exp(y[0, 5])
    p /= p.sum()
    assert (p[model.cls] * np.exp(model.inner)).sum() == pytest.approx(1, abs=1e-3)
    for start in (0, 8):  # what scoring takes from tables is what training computes
        y, _ = model.forward(model.cls[ids[:320]].reshape(-1, 32), start)
        chance = np.exp(y.reshape(-1, y.shape[2]))
        assert model.chances(model.cls[ids[:320]].reshape(-1, 32), start, model.tables()) == pytest.approx(chance, rel=2e-3, abs=1e-6)
        big = (*model.tables()[:2], False)
        assert model.chances(model.cls[ids[:320]].reshape(-1, 32), start, big) == pytest.approx(chance, rel=2e-3, abs=1e-6)
    y, _ = model.forward(model.cls[ids[:24]][None], 0)
    later = model.cls[ids[:24]].copy()
    later[10:] = 0
    assert model.forward(later[None], 0)[0][0, :10] == pytest.approx(y[0, :10], abs=1e-5)


def plain_contexts(words):
    """What lm_scoring.contexts() has, for one document, from its list of words: (place, what follows) by context."""
    hashes = np.array([lm_scoring.word_hashes(b"\n" + w + b"\n", np.array([1]), np.array([1 + len(w)]))[0] for w in words], np.uint64)
    out = []
    for i in range(4, len(words) + 1):
        context = lm_scoring.slice_hashes(hashes, np.array([i - 4]), np.array([i]))[0]
        if context % np.uint64(lm_scoring.SPARSE) == 0:
            out.append((i, tuple(words[i - 4 : i]), tuple([*words, None][i : i + 4])))
    return out


def test_lm_remembers_what_other_texts_have():
    rng = random.Random(21)
    passage = rng.choices(WORDS, k=60)
    texts = [[*rng.choices(WORDS, k=20), *passage, *rng.choices(WORDS, k=rng.randint(0, 9))] for _ in range(5)] + [["a", "b"], [], passage]
    texts = [[w.encode() for w in t] for t in texts]
    learned = np.array([True, True, False, True, True, True, True, True])
    distinct, _, index, first = lm_scoring._joined([b" ".join(t) for t in texts])
    doc, place, length, context, following = lm_scoring.contexts(distinct[index], first)
    plain = [(d, i, c, f) for d, t in enumerate(texts) for i, c, f in plain_contexts(t)]
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    assert [(d, p - begin[d], n) for d, p, n in zip(doc.tolist(), place.tolist(), length.tolist(), strict=True)] == [(d, i, len(f)) for d, i, _, f in plain]
    pairs, totals = Counter(), Counter()
    for d, _, c, f in plain:
        pairs[c, f] += int(learned[d])
        totals[c] += int(learned[d])
    both, at = np.unique(lm_scoring._both(context, following), return_index=True)
    memory = lm_scoring.Memory(both, np.array([pairs[plain[i][2:]] for i in at]), np.array([totals[plain[i][2]] for i in at]))
    pair, total = memory.others(doc, context, following, learned)
    for (d, _, c, f), got in zip(plain, zip(pair.tolist(), total.tolist(), strict=True), strict=True):
        own = [x for x in plain if x[0] == d and learned[d]]
        assert got == (pairs[c, f] - sum(x[2:] == (c, f) for x in own), totals[c] - sum(x[2] == c for x in own))
    assert (total > 0).any()


def test_lm_scores_twins_apart(spark):
    import public_tokenizers as tokenizers

    rng = random.Random(31)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=120)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, texts[i]) for i in range(10)] + [(None, None)]
    import base64

    with open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    got = lm_scoring.score(spark.createDataFrame(rows, "doc_id bigint, text string"), F.lit(True), ranks, tokenizers.PATTERN).collect()
    gain = {r["doc_id"]: (r["score"] - r["base_score"]) / r["n_tokens"] for r in got}
    twins = [gain[i] for i in range(10)] + [gain[100 + i] for i in range(10)]
    assert min(twins) > max(gain[i] for i in range(10, 60))
    again = lm_scoring.score(spark.createDataFrame(rows[::-1], "doc_id bigint, text string").repartition(3), F.lit(True), ranks, tokenizers.PATTERN).collect()
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in again} == {(r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got}


def test_gradients():
    rng = np.random.default_rng(0)
    starts = np.arange(300) % 2 == 0
    model = trained(rng.integers(0, 300, 200), 300, starts)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    ids, wanted = model.cls[rng.integers(0, 300, (3, 12))], model.cls[rng.integers(0, 300, (3, 12))]
    _, grads = model.step(ids, wanted)
    for name in ("embed", "place", "q", "k", "v", "o", "up", "down", "out", "bias"):
        w = model.weights[name]
        at = tuple(rng.integers(0, n) for n in w.shape) if name != "place" else (3, 2)
        at = (ids[0, 0], 1) if name == "embed" else (wanted[0, 0],) if name == "bias" else at
        old = w[at]
        w[at] = old + 1e-5
        up, _ = model.step(ids, wanted)
        w[at] = old - 1e-5
        down, _ = model.step(ids, wanted)
        w[at] = old
        assert grads[name][at] == pytest.approx((up - down) / 2e-5, rel=2e-3, abs=1e-6)


def render(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def test_preferences(spark):
    chosen = [("user", "hi"), ("assistant", "yo"), ("user", "q"), ("assistant", "good")]
    rejected = [("user", "hi"), ("assistant", "yo"), ("user", "q"), ("assistant", "bad one"), ("user", "?")]
    rows = [(1, "chosen", i, r, t) for i, (r, t) in enumerate(chosen)] + [(1, "rejected", i, r, t) for i, (r, t) in enumerate(rejected)]
    rows += [(2, "chosen", 0, None, None), (2, "rejected", 0, None, None), (3, "chosen", 0, "user", "x"), (None, "chosen", None, "assistant", "z")]
    table = spark.createDataFrame([(*r, 9) for r in rows], "pair_id bigint, side string, turn bigint, role string, text string, n_turns int")
    got = {r["pair_id"]: r for r in chat.format_preferences(table).collect()}
    assert len(got) == 4 and got[1]["prompt"] == render(chosen[:3])
    trained = lambda r, side: [r[side][int(b) : int(e)] for b, e in (s.split("-") for s in r[f"{side}_spans"].split(",") if s)]
    for side, turns in (("chosen", chosen[3:]), ("rejected", rejected[3:])):
        assert got[1][side] == render(turns)
        assert trained(got[1], side) == [t for w, t in turns if w == "assistant"]
    assert got[2]["prompt"] == render([("unknown", "")]) and got[2]["chosen"] == got[2]["rejected"] == ""
    assert got[3]["prompt"] == "" and got[3]["chosen_turns"] == 1 and got[3]["rejected_turns"] == 0
    assert got[None]["chosen"] == render([("assistant", "z")]) and trained(got[None], "chosen") == ["z"]
    assert chat.format_preferences(table.limit(0)).count() == 0


def test_preferences_by_place_not_by_number(spark):
    talk = [("user", "hi"), ("assistant", "yo"), ("user", "q")]
    rows = [(1, "chosen", i, r, t) for i, (r, t) in enumerate([*talk, ("assistant", "good")])] + [(1, "rejected", 1 + 3 * i, r, t) for i, (r, t) in enumerate([*talk, ("assistant", "bad")])]
    r = chat.format_preferences(spark.createDataFrame(rows, "pair_id bigint, side string, turn bigint, role string, text string")).first()
    assert (r["prompt"], r["chosen"], r["rejected"]) == (render(talk), render([("assistant", "good")]), render([("assistant", "bad")]))


def test_stale_replies_of_odd_conversations(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "assistant", "x"), (2, 1, "assistant", "x"), (3, None, "assistant", None), (3, 4, "assistant", "y"), (None, 0, "user", None)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["pair_id"]: (r["prompt"], r["chosen"], r["rejected"]) for r in chat.format_preferences(chat.stale_replies(table)).collect()}
    assert got[1] == (render([("user", "a")]), "", "") and got[None] == (render([("user", "")]), "", "")
    assert got[2] == (render([("assistant", "x")] * 2), "", "")
    assert got[3][1] == render([("assistant", "y")])
    assert chat.format_preferences(chat.stale_replies(table.limit(0))).count() == 0


def test_long_conversations_are_one_row(spark):
    talk = [("assistant" if i % 2 else "user", f"turn {i} " + "w" * (i % 5)) for i in range(300)]
    ends = [("assistant", "x" * 70_000), ("assistant", "same number"), ("assistant", "same number")]
    rows = [(1, s, i, r, t) for s in ("chosen", "rejected") for i, (r, t) in enumerate(talk)]
    rows += [(1, "chosen", 300 + (i > 0), r, t) for i, (r, t) in enumerate(ends)] + [(1, "chosen", 302 + i, "assistant", f"late {i}") for i in range(150)]
    rows += [(1, "rejected", 300, "assistant", "short")]
    got = chat.format_preferences(spark.createDataFrame(rows, "pair_id bigint, side string, turn bigint, role string, text string")).collect()
    assert len(got) == 1 and got[0]["prompt"] == render(talk) and got[0]["prompt_turns"] == 300
    late = [*ends, *(("assistant", f"late {i}") for i in range(150))]
    assert got[0]["chosen"] == render(late) and got[0]["rejected"] == render([("assistant", "short")])
    assert [got[0]["chosen"][int(b) : int(e)] for b, e in (s.split("-") for s in got[0]["chosen_spans"].split(","))] == [t for _, t in late]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    """The rows as the tables that the queries read."""
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_queries_have_a_row_for_each_document(spark, rows, folder):
    held = lambda i, d, k: zlib.crc32(("" if i is None else str(i)).encode()) % d == k
    one = langid.op1_language_id(spark, folder).collect()
    assert Counter((r["doc_id"], r["held_out"]) for r in one) == Counter((r[0], held(r[0], 5, 0)) for r in rows)
    five = lm_scoring.op5_lm_scoring(spark, folder).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"]) for r in five) == Counter((r[0], held(r[0], 7, 2), len(words(r[1])) + 1) for r in rows)
    four = mixing.op4_mixing(spark, folder).collect()
    assert Counter((r["doc_id"], r["size"]) for r in four) == Counter((r[0], len(words(r[1]))) for r in rows)
    assert all(len(r["shards"]) * r["size"] == r["taken"] for r in four)
    assert sorted(map(str, four)) == sorted(map(str, mixing.op4_mixing(spark, folder).collect()))
    ten = quality.op10_quality(spark, folder).collect()
    assert Counter(r["doc_id"] for r in ten) == Counter(r[0] for r in rows) and all(0 <= r["score"] <= 1 for r in ten)
    six = bpe.op6_byte_bpe(spark, folder).collect()
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in six) == Counter((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)


def test_simhash_query_against_all_pairs(spark, rows, folder):
    import xxhash

    prints = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    pairs = {(i, j) for i in range(len(rows)) for j in range(i + 1) if (prints[i] ^ prints[j]).bit_count() <= 2}
    least = {}
    for g in groups_of(pairs):
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        least |= {i: min(ids, default=None) for i in g}
    want = Counter((r[0], f"{prints[i]:016x}", least[i]) for i, r in enumerate(rows))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.op8_simhash(spark, folder).collect()) == want


def test_lm_trains_on_every_segment(spark):
    import base64

    import public_tokenizers as tokenizers

    with open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    tools = lm_scoring.Subwords(ranks, tokenizers.PATTERN)
    rng = random.Random(41)
    texts = [" ".join(rng.choices(WORDS, k=k)).upper() for k in (1, 127, 128, 129, 1000, 0)]
    training = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "k1 bigint, k2 bigint, text string")
    ranks_of, pattern = ranks, tokenizers.PATTERN
    rows = lm_scoring._segments(training, lambda: lm_scoring._loaded(ranks_of, pattern, "segments")).collect()
    got = Counter(np.concatenate([np.frombuffer(r["ids"], np.uint16) for r in rows]).tolist())
    want = Counter()
    for t in texts:
        want.update(tools.words([w.lower() for w in t.encode().split()])[0].tolist())
        want[tools.end] += 1 + max(1, -(-len(t.split()) // lm_scoring.SEGMENT))
    assert got == want and lm_scoring.SPARSE == 1


def test_lm_keys_are_packed_and_unpacked():
    keys = np.sort(np.array([0, 0, 1, 255, 256, 70_000, 2**32 - 1], np.uint32))
    for some in (keys, keys[:1], keys[:0]):
        assert lm_scoring._unpacked(lm_scoring._packed(some.tobytes())).tolist() == some.tolist()


def test_edges_are_drawn_together_into_stars():
    from deltasieve.llm._components import drawn_together

    rng = random.Random(51)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(500)]
    node, root = drawn_together(*(np.array(c, np.int64) for c in zip(*edges, strict=True)))
    got = dict(zip(node.tolist(), root.tolist(), strict=True))
    want = {i: min(g) for g in groups_of(set(edges)) for i in g if i != min(g)}
    assert len(node) == len(got) and got == want


def test_principal_directions_are_of_all_vectors(spark):
    rng = np.random.default_rng(61)
    x = rng.standard_normal((200, 6)) * [5, 4, 3, 2, 1, 0.5] + 1
    classes = spark.createDataFrame([(v.tobytes(), 6) for v in x], "unit binary, width int").repartition(3)
    got = embedding_dedup.principal(classes, 6, 2)
    values, directions = np.linalg.eigh(np.cov(x.T))
    assert np.abs(got.T @ directions[:, np.argsort(-values)[:2]]) == pytest.approx(np.eye(2), abs=1e-6)
    assert not hasattr(embedding_dedup, "FITTED")


def test_lm_answers_carry_one_hash(spark):
    """A chunk is told of a context and what follows there by one hash of both."""
    import base64
    import re

    import public_tokenizers as tokenizers

    with open(tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    rows = [(i, "one two three four five six seven eight") for i in range(3)]
    scored = lm_scoring.score(spark.createDataFrame(rows, "doc_id bigint, text string"), F.lit(True), ranks, tokenizers.PATTERN)
    used = re.search(r"\bwork\(([^)]*)\)", scored._jdf.queryExecution().analyzed().toString())[1]
    assert "word" in used and "next" not in used


def test_lm_contexts_of_many_chunks_are_ordered_once():
    """What stands more than once in all lists, of each: its time follows the numbers, not their product with the lists."""
    import time

    rng = np.random.default_rng(3)
    for _ in range(100):
        keys = [np.sort(rng.integers(0, 60, rng.integers(0, 12))).astype(np.uint32) for _ in range(rng.integers(1, 6))]
        n = Counter(np.concatenate(keys).tolist())
        want = [sorted({x for x in k.tolist() if n[x] > 1}) for k in keys]
        assert [k.tolist() for k in lm_scoring._more_than_once(keys)] == want
    keys = [np.sort(rng.integers(0, 2**22, 10_000)).astype(np.uint32) for _ in range(200)]
    begin = time.process_time()
    assert sum(map(len, lm_scoring._more_than_once(keys))) > 0
    assert time.process_time() - begin < 5  # 60 s and more with a look-up for each list
