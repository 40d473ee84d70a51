"""Alignment of two tokenizers' tokens: components of overlapping tokens by pointer jumping, and corpus-wide link counts."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import partitions, small_batches, stash

#: Pairs that make up at least one in so many of all links are broadcast: there can't be more of them than this.
FREQUENT = 1_000_000
#: Distinct pairs that a task holds before it sends their counts on, and words whose pieces a worker remembers.
HELD, MEMORY = 2_000_000, 300_000


def read_byte_level(path: str) -> list[bytes]:
    """Tokens' bytes, by id, of a byte-level vocabulary in JSON; added tokens, which plain text never gives, are left out.

    Raises if merges aren't in order of the ids they make, as ranks would then not be ids.
    """
    with open(path, encoding="utf-8") as lines:
        model = json.load(lines)["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    value = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    vocab = model["vocab"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(made):
        raise ValueError("merges are not in order of their ids")
    tokens = [b""] * (max(vocab.values()) + 1)
    usable = set(made)
    for text, i in vocab.items():
        if i in usable or len(text) == 1:
            tokens[i] = bytes(value[c] for c in text)
    return tokens


class Encoders:
    """Both tokenizers, and the ids of words met before.

    A word with the spaces and line feeds before it is encoded by itself, to the same ids: the pattern of A never goes on
    over white space that follows something else, and no piece of B goes on over a space that follows something else,
    or over a line feed. Texts with other white space or with some at their end, and all texts if a model has other pieces, are
    encoded whole.
    """

    WORD = re.compile("[ \n]+[^ \n]*")
    OTHER_SPACE = re.compile("[^\\S \n]")

    def __init__(self, tokens: list[bytes], pattern: str, model: bytes):
        import sentencepiece
        import tiktoken

        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens) if t}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.spell_a, self.spell_b = Spelling(tokens), Spelling(piece_bytes(self.b))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        lead = self.b.encode("\n")
        self.apart = len(lead) > 1 and pieces[lead[0]] == "▁" and not any(re.search("[^▁]▁|\n", p) for p in pieces)
        self.known: tuple[dict[str, bytes | None], ...] = {}, {}
        self.older: tuple[dict[str, bytes | None], ...] = {}, {}

    def _ids(self, spaced: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a text that begins with a space or line feed; None if the tokens' bytes aren't the text's."""
        whole = np.frombuffer(spaced.encode(), np.uint8)
        skip = spaced[0] == " "  # which B's encoder puts before any text; else it is a token of its own
        a = np.array(array("H", self.a.encode_ordinary(spaced)), np.uint16)
        b = np.array(array("H", self.b.encode(spaced[skip:], num_threads=1)[not skip :]), np.uint16)
        return (a, b) if self.spell_a.spells(a, whole) and self.spell_b.spells(b, whole) else None

    def _apart(self, words: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of words, encoded as one text and cut again; those that can't be spelt are searched for by halves."""
        whole = self._ids("".join(words))
        if whole is None:
            half = len(words) // 2
            return self._apart(words[:half]) + self._apart(words[half:]) if half else [None]
        ends = np.cumsum([len(w.encode()) for w in words])
        cut = [[0, *np.searchsorted(np.cumsum(spelling.size[ids]), ends).__add__(1).tolist()] for ids, spelling in zip(whole, (self.spell_a, self.spell_b), strict=True)]
        a, b = (ids.tobytes() for ids in whole)
        return [(a[2 * i : 2 * j], b[2 * m : 2 * n]) for i, j, m, n in zip(cut[0], cut[0][1:], cut[1], cut[1][1:], strict=False)]

    def _learn(self, words: set[str]) -> None:
        """Take in words not known; those that haven't been met for long are forgotten."""
        if len(self.known[0]) + len(words) > MEMORY:
            self.known, self.older = ({}, {}), self.known
        fresh = []
        for w in words.difference(self.known[0]):
            if w in self.older[0]:
                for known, older in zip(self.known, self.older, strict=True):
                    known[w] = older[w]
            else:
                fresh.append(w)
        for w, ids in zip(fresh, self._apart(fresh) if fresh else [], strict=True):
            self.known[0][w], self.known[1][w] = ids or (None, None)

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids of both; none where a text is empty or the tokens' bytes aren't those of the text after a space."""
        if not text:
            return b"", b""
        spaced = " " + text
        if not self.apart or text[-1] in " \n" or self.OTHER_SPACE.search(text):
            ids = self._ids(spaced)
            return (ids[0].tobytes(), ids[1].tobytes()) if ids else (b"", b"")
        words = self.WORD.findall(spaced)
        try:
            a = b"".join(map(self.known[0].__getitem__, words))
        except (KeyError, TypeError):  # not met yet, or not to be spelt
            self._learn(set(words))
            found = [*map(self.known[0].__getitem__, words)]
            if None in found:
                return b"", b""
            a = b"".join(found)
        return a, b"".join(map(self.known[1].__getitem__, words))


def piece_bytes(model) -> list[bytes]:
    """What each piece of a sentence-piece model stands for."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


class Spelling:
    """The bytes of tokens, by id."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def spells(self, ids: np.ndarray, whole: np.ndarray) -> bool:
        """Whether the tokens' bytes, one after the other, are these."""
        size = self.size[ids]
        end = np.cumsum(size)
        if not len(ids) or end[-1] != len(whole):
            return False
        return bool((self.bytes[np.repeat(self.begin[ids] - end + size, size) + np.arange(len(whole))] == whole).all())


def _ends_before(ends: np.ndarray, total: int) -> np.ndarray:
    """How many of the ends (ascending, up to total) come before each place from 0 to total."""
    marks = np.zeros(total + 1, np.int32)
    marks[ends] = 1
    return np.cumsum(marks, dtype=np.int32) - marks


def components(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number (from 0, in order) of each A and each B token's component of overlapping tokens, and how many there are.

    Both kinds of tokens cover the same bytes without gaps. Every token points to the token that reaches farthest right
    of those it overlaps, itself included (of two that end together, A's). Pointers are doubled until none changes: then
    all of a component point to its terminal token.
    """
    n = len(a_end)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    total = int(a_end[-1])
    last_b, last_a = _ends_before(b_end, total)[a_end], _ends_before(a_end, total)[b_end]
    next_a = np.where(b_end[last_b] > a_end, n + last_b, np.arange(n))
    next_b = np.where(a_end[last_a] >= b_end, last_a, n + np.arange(len(b_end)))
    pointer = np.concatenate([next_a, next_b])
    while True:
        jumped = pointer[pointer]
        if np.array_equal(jumped, pointer):
            break
        pointer = jumped
    terminal = np.zeros(len(pointer), np.int64)
    terminal[pointer] = 1  # all of A, in order
    label = (np.cumsum(terminal) - 1)[pointer]
    return label[:n], label[n:], int(terminal.sum())


class Aligned:
    """Links and components of a chunk of documents, whose bytes stand one after the other."""

    def __init__(self, ids_a: list[np.ndarray], ids_b: list[np.ndarray], size_a: np.ndarray, size_b: np.ndarray):
        self.n_a = np.array([len(x) for x in ids_a], np.int64)
        self.n_b = np.array([len(x) for x in ids_b], np.int64)
        none = np.zeros(0, np.int64)
        self.a = np.concatenate([none, *ids_a]).astype(np.int64)
        self.b = np.concatenate([none, *ids_b]).astype(np.int64)
        self.a_end, self.b_end = np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b])
        total = int(self.a_end[-1]) if len(self.a) else 0
        # B tokens that an A token shares a byte with: from the one its first byte is in to the one its last byte is in.
        before = np.cumsum(np.bincount(self.b_end, minlength=total + 1), dtype=np.int32)
        first, last = before[self.a_end - size_a[self.a]], before[self.a_end - 1]
        count = last - first + 1
        of = np.repeat(np.arange(len(self.a)), count)
        at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count - first, count)
        self.pairs = self.a[of] << 16 | self.b[at]
        self.doc = np.repeat(np.arange(len(ids_a)), self.n_a)[of]

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        a, b, _ = components(self.a_end, self.b_end)
        return a, b


class Writer:
    """Decimal ids, each with the mark that comes after it, as rows of bytes."""

    def __init__(self, ids: int):
        self.ids = ids
        texts = [f"{i}{mark}".encode() for mark in ",|;" for i in range(ids)]
        self.size = np.array([len(t) for t in texts], np.int64)
        width = int(self.size.max())
        self.rows = np.frombuffer(b"".join(t.ljust(width) for t in texts), np.uint8).reshape(-1, width)

    def write(self, aligned: Aligned) -> Iterator[tuple[int, bytes]]:
        """(number of groups, `a1,a2|b1;a3|b2,b3`) of each document."""
        a, b = aligned.groups()
        label = np.concatenate([a, b])
        order = np.argsort(label, kind="stable")  # a group's A tokens, then its B tokens
        side, label = order >= len(a), label[order]
        edge = np.ones(len(label), bool)
        last, turn = edge.copy(), ~edge
        last[:-1] = label[1:] != label[:-1]
        turn[:-1] = side[1:] != side[:-1]
        row = np.concatenate([aligned.a, aligned.b])[order] + np.where(last, 2, turn) * self.ids
        rows = self.rows[row]
        text = rows[rows != 32].tobytes()
        ends = np.cumsum(aligned.n_a + aligned.n_b)
        none = np.zeros(1, np.int64)
        place, groups = (np.concatenate([none, np.cumsum(x)])[np.concatenate([none, ends])].tolist() for x in (self.size[row], last))
        for i in range(len(ends)):
            yield groups[i + 1] - groups[i], text[place[i] : place[i + 1] - 1] if place[i + 1] > place[i] else b""


class _Counts:
    """Sums by key that are put together whenever many have come in."""

    def __init__(self) -> None:
        self.keys, self.sums, self.parts, self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        found, n = np.unique(keys, return_counts=True)
        self.parts.append((found, n))
        self.held += len(found)
        if self.held > max(HELD, len(self.keys)):
            self.fold()

    def fold(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.parts)])
        sums = np.concatenate([self.sums, *(n for _, n in self.parts)])
        self.keys, at = np.unique(keys, return_inverse=True)
        self.sums = np.bincount(at, sums, len(self.keys)).astype(np.int64)
        self.parts, self.held = [], 0


_loaded: dict[str, Encoders] = {}


def _encoders(shared) -> Encoders:
    """This worker's encoders, built once for a vocabulary."""
    tokens, pattern, model = shared.value
    key = hashlib.sha256(b"\n".join([*tokens, pattern.encode(), model])).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoders(tokens, pattern, model)
    return _loaded[key]


def _ids(columns: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in columns]


def encode_both(docs: DataFrame, vocabulary: str, pattern: str, model: str) -> DataFrame:
    """doc_id, a, b (ids of both tokenizers, as little-endian 16-bit integers) of each row, repeated texts and rows included.

    vocabulary is a byte-level BPE in JSON, which encodes the text after a space; model is a sentence-piece file, which
    puts that space itself. A text that is null or empty, or that either one's tokens don't spell byte by byte, has no ids.
    """
    with open(model, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast((read_byte_level(vocabulary), pattern, file.read()))

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoders = _encoders(shared)
        for batch in batches:
            done: dict[str, tuple[bytes, bytes]] = {}
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                if text not in done:
                    done[text] = encoders.encode(text)
                rows.append(done[text])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1))], ["doc_id", "a", "b"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(work, "doc_id bigint, a binary, b binary")


def _chunks(batches: Iterator, size: int = 500_000) -> Iterator:
    """(doc ids, ids of A, ids of B) of about size bytes of ids each."""
    for batch in batches:
        ids, a, b = (batch.column(c).to_pylist() for c in ("doc_id", "a", "b"))
        at = 0
        while at < len(ids):
            end, total = at, 0
            while end < len(ids) and (end == at or total < size):
                total += len(a[end]) + len(b[end])
                end += 1
            yield ids[at:end], _ids(a[at:end]), _ids(b[at:end])
            at = end


def link_counts(encoded: DataFrame, size_a: np.ndarray, size_b: np.ndarray) -> DataFrame:
    """pair (A's id << 16 | B's id), n (its links over all documents), best (no other A id has more with its B id)."""
    parts = partitions(encoded.sparkSession)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts = _Counts()
        for _, a, b in _chunks(batches):
            counts.add(Aligned(a, b, size_a, size_b).pairs)
            if len(counts.keys) > HELD:
                counts.fold()
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys), pa.array(counts.sums)], ["pair", "n"])
                counts = _Counts()
        counts.fold()
        for at in range(0, len(counts.keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys[at : at + 100_000]), pa.array(counts.sums[at : at + 100_000])], ["pair", "n"])

    summed = encoded.mapInArrow(work, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(0xFFFF))  # at most a row for each A id
    return summed.repartition(parts, F.col("pair").bitwiseAND(0xFFFF)).withColumn("best", F.col("n") == F.max("n").over(of_b))


def align(docs: DataFrame, vocabulary: str, pattern: str, model: str, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups, groups_sha256 for each row of docs.

    Tokens of the two tokenizers that share a byte are linked; components of linked tokens are groups, written as
    `a1,a2|b1;a3|b2,b3`. A pair of ids counts all its links in all documents; a link is best if no pair with its B id
    counts more (ties are all best). count_sum adds the counts of a document's links.

    Texts are encoded once, and their ids stashed. Counts of pairs with at least one in `frequent` of all links, of which
    there can't be more than that, are broadcast; other pairs' links are counted by document and joined, no pair having
    more than that part of them. Both ways are exact.

    Rows without tokens (see encode_both) have zeros and an empty groups_sha256; a null doc_id and rows that
    repeat one are rows like others. Other columns play no part; an empty table gives no rows.
    """
    return _align(docs, vocabulary, pattern, model, frequent, True)


def digests(docs: DataFrame, vocabulary: str, pattern: str, model: str, frequent: int = FREQUENT) -> DataFrame:
    """align() without the groups' text, of which only the digest leaves the task; the same rules hold."""
    return _align(docs, vocabulary, pattern, model, frequent, False)


def _align(docs: DataFrame, vocabulary: str, pattern: str, model: str, frequent: int, texts: bool) -> DataFrame:
    spark = docs.sparkSession
    import sentencepiece

    size_a = np.array([len(t) for t in read_byte_level(vocabulary)], np.int64)
    pieces = sentencepiece.SentencePieceProcessor(model_file=model)
    size_b = np.array([len(p) for p in piece_bytes(pieces)], np.int64)
    encoded = stash(encode_both(docs, vocabulary, pattern, model).withColumn("k", F.monotonically_increasing_id()), "ids")
    counts = stash(link_counts(encoded, size_a, size_b), "links")
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * frequent >= total
    rows = counts.where(often).select("pair", "n", "best").toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast(tuple(rows.column(c).to_numpy() for c in ("pair", "n", "best")))
    ids = max(len(size_a), len(size_b))

    names = ["k", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", *(["groups"] if texts else []), "groups_sha256"]
    kinds = {"groups": "string", "groups_sha256": "string"}

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pairs, n, best = shared.value
        writer = Writer(ids)
        for batch in batches:
            k, at = batch.column("k"), 0
            for own, a, b in _chunks(iter([batch])):
                found = Aligned(a, b, size_a, size_b)
                rare = _missing(pairs, found.pairs)
                doc, where = found.doc[~rare], np.searchsorted(pairs, found.pairs[~rare])
                sums, bests = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
                np.add.at(sums, doc, n[where])
                np.add.at(bests, doc, best[where])
                shown = list(writer.write(found))
                columns = {
                    "k": k.slice(at, len(own)),
                    "doc_id": pa.array(own, pa.int64()),
                    "n_a": pa.array(found.n_a),
                    "n_b": pa.array(found.n_b),
                    "n_groups": pa.array([g for g, _ in shown], pa.int64()),
                    "n_links": pa.array(np.bincount(found.doc, minlength=len(own)).astype(np.int64)),
                    "n_best": pa.array(bests),
                    "count_sum": pa.array(sums),
                    "groups_sha256": pa.array([hashlib.sha256(s).hexdigest() if s else "" for _, s in shown], pa.string()),
                }
                if texts:
                    columns["groups"] = pa.array([s.decode() for _, s in shown], pa.string())
                key, times = np.unique(found.doc[rare] << 32 | found.pairs[rare], return_counts=True)
                asks = {"k": pa.array(k.to_numpy()[at + (key >> 32)]), "pair": pa.array(key & 0xFFFFFFFF), "m": pa.array(times.astype(np.int64))}
                for some in (columns, asks):
                    size = len(some["k"])
                    yield pa.RecordBatch.from_arrays([some.get(c, pa.nulls(size, types[c])) for c in types], list(types))
                at += len(own)

    # A row with each document's results, and rows that ask for its rare pairs' counts. Ids stay where they are.
    import pyarrow as pa

    types = {c: pa.string() if c in kinds else pa.int64() for c in [*names, "pair", "m"]}
    told = stash(encoded.mapInArrow(work, ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in types)), "aligned")
    asked = told.where("pair IS NOT NULL").select("k", "pair", "m")
    tail = asked.join(counts.where(~often), "pair").groupBy("k").agg(F.sum(F.col("m") * F.col("n")).alias("tail_sum"), F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("tail_best"))
    rows = told.where("pair IS NULL").join(tail, "k", "left")
    rare_too = {c: F.col(c) + F.coalesce(t, F.lit(0)) for c, t in (("n_best", "tail_best"), ("count_sum", "tail_sum"))}
    return rows.withColumns(rare_too).select(names[1:])


def _missing(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which of the asked aren't in known, which is sorted."""
    if not len(known):
        return np.ones(len(asked), bool)
    return known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] != asked


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document, by digests() with two public vocabularies."""
    import public_tokenizers as tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, tokenizers.path("byte_bpe_50k.json"), tokenizers.PATTERN, tokenizers.path("piece_bpe_32k.model"))
