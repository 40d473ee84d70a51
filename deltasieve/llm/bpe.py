"""Byte-level BPE encoding and decoding by longest-match backtracking."""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import small_batches


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file, by id."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


class Bpe:
    """Exact merges of a piece in time linear in its length.

    The longest vocabulary entry at a position is taken if it may follow its predecessor, i.e. if encoding the
    two together gives just these two; else the next shorter prefix is tried, and with none left the predecessor
    is given up. Compatibility of adjacent tokens is found by undoing their merges and remembered. Bytes are
    mapped to Latin-1 so that the automaton, which works on characters, finds the longest entries.
    """

    def __init__(self, tokens: list[bytes], pattern: str, memory: int = 150_000):
        import ahocorasick
        import regex

        self.tokens, self.memory = tokens, memory
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        self.find = regex.compile(pattern).findall
        self.machine = ahocorasick.Automaton()
        for t, i in self.rank.items():
            self.machine.add_word(t.decode("latin-1"), i)
        self.machine.make_automaton()
        self.split = {i: (i, i) for i in self.rank.values()}
        self.pair: dict[int, int] = {}
        for i, t in enumerate(tokens):
            if len(t) > 1:
                a, b = self._parts(t, i)
                self.split[i] = (a, b)
                if a != i:
                    self.pair[a << 32 | b] = i
        self.shorter = {i: self._prefix(t) for t, i in self.rank.items()}
        self.compatible: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def _parts(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge made this one (itself twice if no merge did)."""
        parts = [bytes([c]) for c in token]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                return rank, rank
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        a, b = self.rank.get(parts[0]), self.rank.get(parts[1])
        return (a, b) if a is not None and b is not None else (rank, rank)

    def _prefix(self, token: bytes) -> int:
        """Longest vocabulary entry that is a proper prefix, or -1."""
        for n in range(len(token) - 1, 0, -1):
            if (r := self.rank.get(token[:n])) is not None:
                return r
        return -1

    def may_follow(self, left: int, right: int) -> bool:
        """Whether encoding the concatenation gives exactly the tokens left, right."""
        key = left << 32 | right
        if (known := self.compatible.get(key)) is not None:
            return known
        pair, split = self.pair, self.split
        a, b, limit, fits = left, right, 1 << 62, True
        while True:
            if pair.get(a << 32 | b, limit) < limit:  # what stands at the border would have merged earlier
                fits = False
                break
            # Undo the later of the two tokens' last merges, or the other's if that one is a single byte.
            before = a, b
            if a > b:
                limit, a = a, split[a][1]
                if a == limit:
                    limit, b = b + 1, split[b][0]
            else:
                limit, b = b + 1, split[b][0]
                if b + 1 == limit:
                    limit, a = a, split[a][1]
            if (a, b) == before:
                break
        if len(self.compatible) > 150_000:
            self.compatible.clear()
        self.compatible[key] = fits
        return fits

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.rank.get(piece)) is not None:
            return [whole]
        text, tokens, compatible = piece.decode("latin-1"), self.tokens, self.compatible
        out: list[int] = []
        at, left, token = 0, -1, -1
        for _, token in self.machine.iter_long(text):  # the longest entry at each place, while these fit together
            if left >= 0 and not (compatible.get(left << 32 | token) or self.may_follow(left, token)):
                break
            out.append(token)
            at += len(tokens[token])
            left = token
        n, dead = len(piece), bytearray(len(piece) + 1)  # dead: places from which no rest of the piece fits
        while at < n:
            while token >= 0:
                end = at + len(tokens[token])
                if not dead[end] and (not out or self.may_follow(out[-1], token)):
                    out.append(token)
                    at = end
                    if at < n:
                        token = next(self.machine.iter_long(text, at))[1]
                    break
                token = self.shorter[token]
            else:
                dead[at] = 1
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                last = out.pop()
                at -= len(tokens[last])
                token = self.shorter[last]
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        known, out = self.known, []
        for piece in self.find(text):
            ids = known.get(piece)
            if ids is None:
                got = self.encode_piece(piece.encode())
                ids = struct.pack(f"<{len(got)}I", *got)
                if len(known) >= self.memory:
                    known.clear()
                known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        got = array("I")
        got.frombytes(ids)
        return b"".join(map(self.tokens.__getitem__, got))


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Each document's doc_id, ids (little-endian uint32 binary) and decoded text (binary).

    A null text counts as empty and has no ids; texts of any length are encoded whole, piece by piece; repeated
    rows give repeated rows; other columns, whatever their names, are left out. An empty table gives no rows.
    The vocabulary is read on the driver and sent along with the tasks (a file of fixed size).
    """
    return _run(docs, vocabulary, pattern, "doc_id bigint, ids binary, decoded binary", lambda ids, text: (ids, text))


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """encode(), with each document's ids and decoded bytes reduced to counts and SHA-256 inside the task.

    Nulls, empty and long texts, repeated rows and empty tables as there.
    """

    def reduce(ids: bytes, text: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()

    return _run(docs, vocabulary, pattern, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", reduce)


def tokens(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of digests() for each row, by the same rules for nulls, repeats and empty tables."""

    def both(ids: bytes, text: bytes) -> tuple:
        return len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()

    return _run(docs, vocabulary, pattern, "doc_id bigint, n_tokens bigint, ids binary, ids_sha256 string, decoded_sha256 string", both)


_loaded: dict[str, Bpe] = {}


def loaded(tokens: list[bytes], pattern: str) -> Bpe:
    """The encoder of this worker process, built once for a task."""
    key = hashlib.sha256(b"\n".join(tokens) + pattern.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(tokens, pattern)
    return _loaded[key]


def _run(docs: DataFrame, vocabulary: str, pattern: str, schema: str, finish) -> DataFrame:
    small_batches(docs.sparkSession)
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def work(batches):
        import pyarrow as pa

        bpe = loaded(tokens.value, pattern)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                ids = bpe.encode(text or "")
                rows.append(finish(ids, bpe.decode(ids)))
            columns = [pa.array(c) for c in zip(*rows, strict=True)]
            names = [part.split()[0] for part in schema.split(", ")]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)
        _loaded.clear()  # the worker may go on with other work

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(work, schema)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, by digests() with the public vocabulary."""
    import public_tokenizers as tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
