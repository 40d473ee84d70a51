"""Token alignment, the trie of conversations and suffix-array dedup against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from deltasieve.llm import alignment, suffix_dedup, trie

tokenizers = pytest.importorskip("public_tokenizers")
A, B = (tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
DOCS = "doc_id bigint, text string"


# --- op11


def plain_tokens(texts):
    """(A's, B's) ids and bytes of each text, by the two libraries themselves; None where they don't spell the text."""
    import sentencepiece
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(A)
    own.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters)}
    out = []
    for text in texts:
        a = [(i, bytes(byte[c] for c in own.id_to_token(i))) for i in own.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()) for i in pieces.encode(text)] if text else []
        same = {b"".join(x for _, x in side) for side in (a, b)} == {(" " + text).encode()} if text else False
        out.append((a, b) if same else None)
    return out


def plain_alignment(texts):
    links, groups = [], []
    for tokens in plain_tokens(texts):
        links.append([])
        groups.append([])
        i = j = at_a = at_b = 0
        a, b = tokens or ([], [])
        begin = (0, 0)
        while i < len(a):
            links[-1].append((a[i][0], b[j][0]))
            end_a, end_b = at_a + len(a[i][1]), at_b + len(b[j][1])
            if end_a <= end_b:
                i, at_a = i + 1, end_a
            if end_b <= end_a:
                j, at_b = j + 1, end_b
            if end_a == end_b:
                groups[-1].append(",".join(str(x) for x, _ in a[begin[0] : i]) + "|" + ",".join(str(x) for x, _ in b[begin[1] : j]))
                begin = (i, j)
    counts = Counter(p for some in links for p in some)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(";".join(g), len(g), len(some), sum(counts[p] == best[p[1]] for p in some), sum(counts[p] for p in some)) for g, some in zip(groups, links, strict=True)]


TEXTS = ["hello world", "hello  world\n\n\tx", "", None, "<|endoftext|>", "▁odd", "ﬁ naïve 漢字 😀 x", "a" * 300, " lead", "trail ", "\n", "can't we'll\r\nIt's", "hello world", "x=1;\ty\x00z\x1c q", "1234567 89"] + [" ".join(random.Random(i).choices(["the", "theatre", "  ", "\n", "unbelievable", "résumé", "x1"], k=30)) for i in range(40)]


@pytest.mark.parametrize("frequent", [1_000_000, 20, 1])
def test_alignment_equals_the_plain_walk(spark, frequent):
    """Whatever part of the pairs is broadcast: all, some, or none."""
    d = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], DOCS + ", n_a bigint")
    got = {r["doc_id"]: r for r in alignment.align(d, A, tokenizers.PATTERN, B, frequent).collect()}
    for i, want in enumerate(plain_alignment(TEXTS)):
        r = got[i]
        assert (r["groups"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"]) == want, TEXTS[i]
        assert r["groups_sha256"] == (hashlib.sha256(want[0].encode()).hexdigest() if want[0] else "")
        assert (r["n_a"], r["n_b"]) == tuple(sum(len(g.split("|")[k].split(",")) for g in want[0].split(";")) if want[0] else 0 for k in (0, 1))
    short = alignment.digests(d, A, tokenizers.PATTERN, B, frequent)
    assert {r["doc_id"]: r["groups_sha256"] for r in short.collect()} == {i: r["groups_sha256"] for i, r in got.items()}


def test_alignment_of_odd_rows(spark):
    d = spark.createDataFrame([(None, "same"), (None, "same"), (1, "same"), (1, None)], DOCS)
    got = sorted((r["doc_id"] or 0, r["n_a"], r["count_sum"]) for r in alignment.digests(d, A, tokenizers.PATTERN, B).collect())
    assert got == [(0, 1, 3), (0, 1, 3), (1, 0, 0), (1, 1, 3)]
    assert alignment.digests(d.limit(0), A, tokenizers.PATTERN, B).count() == 0


def test_words_are_remembered_and_forgotten(monkeypatch):
    monkeypatch.setattr(alignment, "MEMORY", 40)
    with open(B, "rb") as file:
        encoders = alignment.Encoders(alignment.read_byte_level(A), tokenizers.PATTERN, file.read())
    rng = random.Random(1)
    texts = [" ".join(rng.choices([f"word{i}" for i in range(200)] + ["▁", "\n", "\n "], k=30)) for _ in range(60)]
    for text, want in zip(texts, plain_tokens(texts), strict=True):
        ids = [[i for i, _ in side] for side in want] if want else [[], []]
        assert [np.frombuffer(x, np.uint16).tolist() for x in encoders.encode(text)] == ids


def test_components_by_pointer_jumping():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 60)
        ends = [sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n}) for _ in range(2)]
        a, b, count = alignment.components(*(np.array(e, np.int64) for e in ends))
        cuts = sorted(set(ends[0]) & set(ends[1]))
        assert count == len(cuts)
        for label, side in ((a, ends[0]), (b, ends[1])):
            assert label.tolist() == [next(i for i, c in enumerate(cuts) if c >= e) for e in side]


# --- op12


def plain_trie(rows):
    """The nodes, from conversations as rows (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h]) + tuple(turns[h:])
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    children, leaves, saved = Counter(k[:-1] for k in nodes if k), Counter(), Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1].encode()) if k else 0
    ends = {k: hashlib.sha256(",".join(str(c) for c in sorted(m) if built[c] == k).encode()).hexdigest() for k, m in nodes.items()}
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else -1, len(m), children[k], leaves[k], saved[k], ends[k]) for k, m in nodes.items())


def nodes_of(df):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], *(r[c] for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))) for r in df.collect())


TURNS = "conv_id bigint, turn bigint, role string, text string, depth int"


@pytest.mark.parametrize("shards", [1, 4, 30])
def test_trie_equals_all_prefixes(spark, shards):
    """Copies of one conversation in many shards, hot openings, turnless conversations, nulls."""
    rng = random.Random(shards)
    rows = []
    for c in [*range(0, 150), *range(1000, 1100)]:
        hot = c % 3 == 0
        for turn in range(3 if hot else rng.randint(1, 12)):
            rows.append((c, turn, "user" if turn % 2 else None, "hot" if hot else rng.choice(["é", "yes", None, "no"])))
    rows += [(2003, None, "x", "first"), (2003, 0, "x", "then"), (None, 0, "x", "lost")]
    d = spark.createDataFrame([(*r, 0) for r in rows], TURNS).repartition(5)
    assert nodes_of(trie.trie_nodes(trie.shared_openings(d), shards)) == plain_trie(rows)


def test_trie_of_nothing_and_of_long_lists(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 80)
    empty = spark.createDataFrame([], TURNS)
    assert trie.trie_nodes(trie.shared_openings(empty), 3).count() == 0
    rows = [(c, t, "u", "same") for c in range(300) for t in range(12)]
    assert nodes_of(trie.trie_nodes(trie.shared_openings(spark.createDataFrame([(*r, 0) for r in rows], TURNS)), 6)) == plain_trie(rows)


# --- op13


def plain_removal(rows, length):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    seen, out = set(), []
    for i in order:
        data = (rows[i][1] or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            part = data[p : p + length]
            if part in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(part)
        runs = sum(1 for j, g in enumerate(gone) if g and (not j or not gone[j - 1]))
        out.append((rows[i][0], len(data), sum(gone), runs, bytes(c for c, g in zip(data, gone, strict=True) if not g)))
    return Counter(out)


def passages(n):
    rng = random.Random(n)
    words = ["alpha", "be", "gamma\n", "délta", "漢字", "x"]
    shared = [" ".join(rng.choices(words, k=rng.randint(5, 40))) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.5 else " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 4))]
        rows.append((i, "".join(parts)))
    return [*rows, (None, None), (None, shared[0] * 2), (300, rows[3][1]), (300, rows[3][1]), (301, "a" * 500), (302, ""), (303, "ab" * 200), (304, "b" * 9)]


@pytest.mark.parametrize(("length", "grams", "common"), [(20, (8,), 1000), (100, (20, 90), 3), (30, (10, 25), 1)])
def test_removal_equals_all_strings(spark, length, grams, common):
    rows = passages(60)
    d = spark.createDataFrame([(i, t, 0) for i, t in rows], DOCS + ", n_bytes int").repartition(3)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(d, length, grams, common).collect())
    assert got == plain_removal(rows, length)
    short = Counter((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.digests(d, length, grams, common).collect())
    assert short == Counter((k[0], k[2], hashlib.sha256(k[4]).hexdigest()) for k in got.elements())


def test_one_text_many_times_and_an_empty_table(spark):
    d = spark.createDataFrame([(None, "x" * 150)] * 40 + [(None, None)] * 40, DOCS)
    got = Counter((r["n_bytes"], r["n_removed"]) for r in suffix_dedup.digests(d).collect())
    assert got == Counter((k[1], k[2]) for k in plain_removal([(None, "x" * 150)] * 40 + [(None, None)] * 40, 100).elements())
    assert suffix_dedup.digests(d.limit(0)).count() == 0


def test_suffix_array_by_two_stages():
    rng = random.Random(1)
    for _ in range(150):
        length = rng.choice([8, 9, 20, 100])
        letters = rng.choice([b"ab", b"abc", b"a", bytes([0, 255]), bytes(range(256))])
        base = bytes(rng.choices(letters, k=rng.randint(length, 3 * length)))
        fragments = [base[(i := rng.randint(0, len(base) - length)) : i + rng.randint(length, 2 * length)] for _ in range(rng.randint(1, 8))]
        windows = [rng.randint(1, len(f) - length + 1) for f in fragments]
        found = suffix_dedup.SuffixArray(fragments, np.array(windows), length)
        whole = [bytes(found.bytes[p : found.end[p]][:length]) for p in found.order if found.end[p] - p >= length]
        assert whole == sorted(whole)
        order = np.array(rng.sample(range(len(fragments)), len(fragments)))
        runs = zip(*(x.tolist() for x in suffix_dedup.repeated(fragments, np.array(windows), order, length)), strict=True)
        seen, want = set(), set()
        for _, o, f in sorted((order[f], o, f) for f in range(len(fragments)) for o in range(windows[f])):
            part = fragments[f][o : o + length]
            want |= {(f, o)} if part in seen else set()
            seen.add(part)
        assert {(f, o + k) for f, o, n in runs for k in range(n)} == want
