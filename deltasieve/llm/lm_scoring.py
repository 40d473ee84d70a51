"""Scoring of texts by a causal self-attention model over subword ids, with the whole corpus's words and contexts in Spark."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import chunked, discard, mix, partitions, remainder, row_key, slice_hashes, stash, word_bounds, word_hashes

#: Tokens of a window, and of its front that only give context; the rest are scored.
WINDOW, CONTEXT = 32, 6
#: Model width, classes that start a word and that go on with one, and classes of a single id among each.
WIDTH, STARTS, GOES_ON, ALONE = 16, 48, 48, 20
#: Ids whose neighbours describe an id when classes are formed.
NEIGHBOURS = 96
#: Every training text is cut into segments of so many words, all of which train the attention weights.
SEGMENT = 128
#: The weights are trained in so many turns, each on its own segments: in every task by itself, then averaged. A task with
#: few segments goes through them again, up to so many times, until it has made LEAST steps.
TURNS, BATCH, RATE, LEAST, AGAIN = 4, 48, 0.01, 80, 20
#: Bytes of text of a chunk that is scored with one set of counts.
CHUNK_BYTES = 4_000_000
#: Weight of a word's chance by its subwords alone; the rest goes by the chance of its first subword's class and the
#: corpus's counts of the words in that class, discounted so that unseen words get what the discount frees.
SHARE, DISCOUNT = 0.3, 0.6
#: Words of a context that is remembered, with as many that follow; contexts for each that is: all are.
REMEMBERED, FOLLOWING, SPARSE = 4, 4, 1
#: Which contexts more than one chunk has is told from so many bits of hash that name a bucket, at most, and the next 32.
BUCKET_BITS = 12
#: Occurrences of a context in other texts at which what follows there weighs as much as the attention's chance.
TRUST = 4.0
#: Distinct words and contexts that a task holds before it sends its questions on.
HELD = 3_000_000
#: Up to this, powers of e and sums of some are in a float's range.
LARGEST = 60.0
_END_HASH = np.uint64(0x51ED270B7F4A7C15)


class Subwords:
    """Ids of words by the ranks of a public vocabulary; a word's first id begins with a space. The end has an id too."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.encode = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.size = max(ranks.values()) + 2
        self.end = self.size - 1
        if self.size > 1 << 16:
            raise ValueError("ids are kept in two bytes: a vocabulary of up to 65,535")
        self.starts = np.zeros(self.size, bool)
        for token, i in ranks.items():
            self.starts[i] = token[:1] == b" "
        self.starts[self.end] = True

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, first id of each word and the total): a space is never within or at the end of an id."""
        ids = np.asarray(self.encode((b" " + b" ".join(words)).decode("utf-8", "replace")) if words else [], np.int64)
        first = np.flatnonzero(self.starts[ids])
        return ids, np.append(first, len(ids))


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w over the last axis, as one product of two matrices."""
    return (x.reshape(-1, x.shape[-1]) @ w).reshape(*x.shape[:-1], w.shape[1])


def _row_sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, which is kept: as a product, which is faster than a sum over a short axis."""
    return _times(x, np.ones((x.shape[-1], 1), x.dtype))


@dataclass
class Attention:
    """One causal self-attention layer with a softmax over classes of ids; within its class an id has a fixed share.

    Classes of ids that start a word are apart from those that go on with one, so that the chance that a word is over
    is known, and the chances of all words after any context add up to one.
    """

    cls: np.ndarray
    inner: np.ndarray
    weights: dict[str, np.ndarray]

    @staticmethod
    def classes(count: np.ndarray, near: np.ndarray, starts: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Class of each id, and the log of its share of it: frequent ids have classes of their own, others are clustered.

        near[id] counts the ids beside it, before and after. Ids are alike if they have like neighbours; those seen too
        seldom to tell share the last class. The end of a text, the last id, has a class of its own.
        """
        rng, size = np.random.default_rng(seed), len(count)
        count = count.astype(float)
        cls = np.zeros(size, np.int64)
        for kind, base, total in ((True, 0, STARTS), (False, STARTS, GOES_ON)):
            some = np.flatnonzero(starts == kind)
            some = some[np.argsort(-count[some], kind="stable")]
            if kind:
                some = np.concatenate([[size - 1], some[some != size - 1]])
            cls[some[:ALONE]] = base + np.arange(min(ALONE, len(some)))
            cls[some[ALONE:]] = base + total - 1
            rest = some[ALONE:][count[some[ALONE:]] >= 4]
            k = total - ALONE - 1
            if len(rest) <= k:
                cls[rest] = base + ALONE + np.arange(len(rest))
                continue
            some_near = near[rest].astype(float)
            some_near = np.sqrt(some_near / np.maximum(1, some_near.sum(axis=1, keepdims=True)))
            centre = some_near[rng.choice(len(rest), k, replace=False, p=count[rest] / count[rest].sum())]
            for _ in range(12):
                best = np.argmin((centre**2).sum(axis=1) - 2 * some_near @ centre.T, axis=1)
                mass = np.bincount(best, weights=count[rest], minlength=k)
                total_near = np.zeros_like(centre)
                np.add.at(total_near, best, some_near * count[rest][:, None])
                centre = np.where(mass[:, None] > 0, total_near / np.maximum(mass, 1e-9)[:, None], centre)
            cls[rest] = base + ALONE + best
        smooth = count + 0.02
        return cls, np.log(smooth / np.bincount(cls, weights=smooth, minlength=STARTS + GOES_ON)[cls]).astype(np.float32)

    @classmethod
    def fresh(cls, count: np.ndarray, near: np.ndarray, starts: np.ndarray, seed: int = 1) -> Attention:
        """Untrained weights over the classes of ids so counted. The embedding has a row for each class."""
        group, inner = cls.classes(count, near, starts, seed)
        rng, c, d = np.random.default_rng(seed), STARTS + GOES_ON, WIDTH
        draw = lambda *shape, s=1.0: (rng.standard_normal(shape) * s / np.sqrt(shape[0])).astype(np.float32)
        w = {"embed": draw(c, d, s=np.sqrt(c) * 0.3), "place": draw(WINDOW, d, s=0.3), "q": draw(d, d), "k": draw(d, d), "v": draw(d, d), "o": draw(d, d), "up": draw(d, 2 * d), "down": draw(2 * d, d, s=0.3), "out": draw(d, c)}
        # Start from the classes' frequencies; a class without ids has no chance.
        often = np.bincount(group, weights=count, minlength=c)
        w["bias"] = np.where(np.bincount(group, minlength=c) == 0, -1e9, np.log((often + 0.5) / (count.sum() + 0.5 * c))).astype(np.float32)
        return cls(group, inner, w | {"mask": np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)})

    def forward(self, ids: np.ndarray, start: int) -> tuple:
        """(scores of the classes of the id after each place from start on, and what the gradient needs)."""
        w = self.weights
        b, n = ids.shape
        x = w["embed"][ids] + w["place"][:n]
        q, k, v = (_times(x, w[c]) for c in "qkv")
        a = q[:, start:] @ k.transpose(0, 2, 1)
        # What comes later has no weight; a place's own score is there, so that no row is without any.
        small = abs(a).max(initial=0) < LARGEST
        if not small:
            a += w["mask"][start:n, :n]
            a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        if small:
            a *= np.tri(n, dtype=a.dtype)[start:]
        a *= 1 / _row_sums(a)
        av = a @ v
        h = x[:, start:] + _times(av, w["o"])
        f = _times(h, w["up"])
        np.maximum(f, 0, out=f)
        z = h + _times(f, w["down"])
        y = _times(z, w["out"])
        y += w["bias"]
        return y, (x, q, k, v, a, av, h, f, z)

    def step(self, ids: np.ndarray, wanted: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """(mean loss, gradients) for predicting the classes wanted after each place of ids."""
        w = self.weights
        y, (x, q, k, v, a, av, h, f, z) = self.forward(ids, 0)
        b, n, d = x.shape
        flat = lambda t: t.reshape(b * n, -1)
        cell = np.arange(b * n), wanted.ravel()
        right = flat(y)[cell]
        # Powers are in range if none is too large and in each row one, that of the likeliest class, not too small.
        if y.max() > LARGEST or y[:, :, np.argmax(w["bias"])].min() < -LARGEST:
            top = y.max(axis=2, keepdims=True)
            y -= top
            right = right - top.ravel()
        dy = flat(np.exp(y, out=y))
        total = _row_sums(dy)
        loss = (np.log(total[:, 0]) - right).mean()
        dy *= 1 / (total * (b * n))
        dy[cell] -= 1 / (b * n)
        g = {"out": flat(z).T @ dy, "bias": np.ones(b * n, dy.dtype) @ dy}
        dz = dy @ w["out"].T
        df = dz @ w["down"].T
        df *= flat(f) > 0
        g["down"], g["up"] = flat(f).T @ dz, flat(h).T @ df
        dh = dz + df @ w["up"].T
        g["o"] = flat(av).T @ dh
        dav = (dh @ w["o"].T).reshape(b, n, d)
        ds = dav @ v.transpose(0, 2, 1)
        ds *= a
        ds -= a * _row_sums(ds)
        dv, dq, dk = a.transpose(0, 2, 1) @ dav, ds @ k, ds.transpose(0, 2, 1) @ q
        g["q"], g["k"], g["v"] = (flat(x).T @ flat(t) for t in (dq, dk, dv))
        dx = dh + flat(dq) @ w["q"].T + flat(dk) @ w["k"].T + flat(dv) @ w["v"].T
        g["place"] = np.zeros_like(w["place"])
        g["place"][:n] = dx.reshape(b, n, d).sum(axis=0)
        g["embed"] = (ids.ravel()[None] == np.arange(len(w["embed"]), dtype=ids.dtype)[:, None]).astype(np.float32) @ dx
        return float(loss), g

    def train(self, ids: np.ndarray, rate: float = RATE, seed: int = 1) -> int:
        """Adam over a sequence of ids, in windows in a random order, LEAST steps or one pass; gives the number of windows."""
        rng, seq = np.random.default_rng(seed), self.cls.astype(np.uint8)[ids]
        usable = (len(seq) - 1) // WINDOW
        x, y = (seq[i : i + usable * WINDOW].reshape(-1, WINDOW) for i in (0, 1))
        names = [n for n in self.weights if n != "mask"]
        # All weights in one row, of which each has its part.
        row = np.concatenate([self.weights[n].ravel() for n in names])
        cuts = np.cumsum([self.weights[n].size for n in names])[:-1]
        self.weights |= {n: part.reshape(self.weights[n].shape) for n, part in zip(names, np.split(row, cuts), strict=True)}
        first, second = np.zeros_like(row), np.zeros_like(row)
        steps = -(-usable // BATCH)
        passes = min(AGAIN, max(1, -(-LEAST // max(1, steps))))
        order = np.concatenate([rng.permutation(usable) for _ in range(passes)])
        for t, at in enumerate(range(0, len(order), BATCH), 1):
            some = order[at : at + BATCH]
            _, grads = self.step(x[some], y[some])
            now = rate * (1 - 0.7 * at / len(order))
            grad = np.concatenate([grads[n].ravel() for n in names])
            first += 0.1 * (grad - first)
            second += 0.01 * (grad * grad - second)
            row -= now * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        return usable

    def packed(self) -> np.ndarray:
        return np.concatenate([self.weights[n].ravel() for n in self.weights if n != "mask"]).astype(np.float64)

    def unpacked(self, flat: np.ndarray) -> Attention:
        at, out = 0, {"mask": self.weights["mask"]}
        for n, w in self.weights.items():
            if n != "mask":
                out[n] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
                at += w.size
        return Attention(self.cls, self.inner, out)

    def tables(self) -> tuple[np.ndarray, np.ndarray, bool]:
        """What a class at a place brings, by place * classes + class: (input with a one and query, key and value with a one), and more.

        An input is the sum of two rows of weights, so that there are few of them. The value has been through the output
        of the attention. Last, whether queries times keys are so small that their powers of e are in range.
        """
        w = self.weights
        x = (w["embed"][None] + w["place"][:, None]).reshape(-1, WIDTH)
        q, k, v = x @ w["q"], x @ w["k"], x @ w["v"] @ w["o"]
        bound = float(np.sqrt((q**2).sum(axis=1).max() * (k**2).sum(axis=1).max()))
        return np.concatenate([x, np.ones((len(x), 1), np.float32), q], axis=1), np.concatenate([k, v, np.ones((len(x), 1), np.float32)], axis=1), bound < LARGEST

    def chances(self, ids: np.ndarray, start: int, tables: tuple) -> np.ndarray:
        """The chances, up to a factor, of the classes of the id after each place from start on, as forward() scores them."""
        w, (own, other, small) = self.weights, tables
        b, n = ids.shape
        cell = ids + np.arange(n) * len(w["embed"])
        xq, kv = own[cell[:, start:]], other[cell]
        a = xq[..., WIDTH + 1 :] @ kv[..., :WIDTH].transpose(0, 2, 1)
        a += w["mask"][start:n, :n]
        if not small:
            a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        mixed = a @ kv[..., WIDTH:]
        mixed = mixed[..., :WIDTH] / mixed[..., WIDTH:]
        h = np.ascontiguousarray(xq[..., : WIDTH + 1]).reshape(-1, WIDTH + 1)
        h[:, :WIDTH] += mixed.reshape(-1, WIDTH)
        f = h[:, :WIDTH] @ w["up"]
        np.maximum(f, 0, out=f)
        h[:, :WIDTH] += f @ w["down"]
        y = h @ np.concatenate([w["out"], w["bias"][None]])
        return np.exp(y, out=y)

    def score(self, ids: np.ndarray, begin: np.ndarray, batch: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """(log-probability of each id, log of the chance that an id which starts a word is next) for sequences begin[i]:begin[i+1].

        Each sequence has a start, its end symbol, before it. Overlapping windows score each id once, in batches of windows of
        all sequences; the ids in a window's front give context alone, but in a sequence's first window are scored.
        """
        tables = self.tables()
        stride = WINDOW - CONTEXT
        sizes = np.diff(begin)
        seq = self.cls[ids]
        # Context ids of a place are those before it; the end symbol's class stands for the start of a text.
        start_class = self.cls[-1]
        shifted = np.empty_like(seq)
        shifted[1:] = seq[:-1]
        shifted[begin[:-1][sizes > 0]] = start_class
        log = np.empty(len(ids), np.float32)
        over = np.empty(len(ids), np.float32)
        # Sums over the classes that start a word, and over all.
        sums = np.stack([np.arange(STARTS + GOES_ON) < STARTS, np.ones(STARTS + GOES_ON, bool)], axis=1).astype(np.float32)

        def run(rows: np.ndarray, width: int, skip: int) -> None:
            """Windows that begin at rows: width places, of which those from skip on are scored (beyond the end: ignored)."""
            for at in range(0, len(rows), batch):
                place = rows[at : at + batch, None] + np.arange(width)
                inside = np.minimum(place, len(seq) - 1)
                chance = self.chances(shifted[inside], skip, tables)
                good = (place[:, skip:] < last[at : at + batch, None]).ravel()
                target = inside[:, skip:].ravel()
                starts, total = (chance @ sums).T
                got = chance[np.arange(len(target)), seq[target]]
                log[target[good]] = np.log(got / total)[good]
                over[target[good]] = np.log(starts / total)[good]

        some = np.flatnonzero(sizes > 0)
        last = begin[1:][some]
        run(begin[some], WINDOW, 0)
        more = np.maximum(0, -(-(sizes[some] - WINDOW) // stride))
        rows = np.repeat(begin[some], more) + (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1) * stride
        last = np.repeat(begin[1:][some], more)
        run(rows, WINDOW, CONTEXT)
        return log + self.inner[ids], over


def first_classes(model: Attention, tools: Subwords, words: list[bytes]) -> np.ndarray:
    """Class of each word's first id."""
    ids, begin = tools.words(words)
    return model.cls[ids[begin[:-1]]]


def _joined(docs: list[bytes]) -> tuple:
    """Distinct words of a chunk and where each stands: (hashes, words, index of each word, first word of each document)."""
    blob, starts, ends, first = word_bounds(docs)
    hashes = word_hashes(blob, starts, ends, lower=True)
    distinct, at, index = np.unique(hashes, return_index=True, return_inverse=True)
    low = blob.lower()
    return distinct, [low[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], index, first


def contexts(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, place, length, context, what follows) where a context is remembered, in order; the last two are hashes.

    hashes are of the words of a chunk, first the first word of each document. A context is REMEMBERED words in a row;
    which ones are remembered depends on these alone, so that copies of a passage agree, and so does a model that has
    only read so far. What follows are the next FOLLOWING tokens, or fewer up to the end; place is where they begin among
    the tokens of all documents, length how many there are.
    """
    tokens = np.insert(hashes, first[1:], _END_HASH)
    n = np.diff(first) + 1
    begin = first[:-1] + np.arange(len(n))
    starts = np.maximum(0, n - REMEMBERED)
    doc = np.repeat(np.arange(len(n)), starts)
    start = np.repeat(begin, starts) + np.arange(len(doc)) - np.repeat(np.cumsum(starts) - starts, starts)
    context = slice_hashes(tokens, start, start + REMEMBERED)
    here = context % np.uint64(SPARSE) == 0
    doc, place = doc[here], start[here] + REMEMBERED
    length = np.minimum(FOLLOWING, begin[doc] + n[doc] - place)
    return doc, place, length, context[here], slice_hashes(tokens, place, place + length)


def _both(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context ^ mix(word))


@dataclass
class Memory:
    """How often the training texts have a context and what follows: sorted hashes of both, and the two counts."""

    both: np.ndarray
    pair: np.ndarray
    context: np.ndarray

    def others(self, doc: np.ndarray, context: np.ndarray, following: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of (context and what follows, context) for each row, without what the row's own text has taught."""
        both = _both(context, following)
        at = np.minimum(np.searchsorted(self.both, both), max(0, len(self.both) - 1))
        known = self.both[at] == both if len(self.both) else np.zeros(len(both), bool)
        pair, total = (np.where(known, c[at], 0) if len(c) else np.zeros(len(both), np.int64) for c in (self.pair, self.context))
        # A row that a text has taught alone is not known here, or has counts that come to nothing.
        some = np.flatnonzero(known & learned[doc])
        for counts, key in ((pair, both), (total, context)):
            _, index, own = np.unique(mix(key[some] ^ mix(doc[some].astype(np.uint64))), return_inverse=True, return_counts=True)
            counts[some] -= own[index]
        return np.maximum(pair, 0), np.maximum(total, 0)


def chunk_scores(docs: list[bytes], learned: np.ndarray, known: np.ndarray, counts: np.ndarray, by_class: np.ndarray, memory: Memory, model: Attention, tools: Subwords) -> tuple[np.ndarray, ...]:
    """(tokens, known tokens, base, score) of each document; counts of the sorted word hashes known in training.

    learned says which of the documents were trained on; by_class[class] are the training tokens and distinct tokens
    whose first id is in the class.
    """
    n, v = by_class.sum(axis=0).tolist()
    distinct, words, index, first = _joined(docs)
    at = np.minimum(np.searchsorted(known, distinct), max(0, len(known) - 1))
    count = np.where(known[at] == distinct, counts[at], 0) if len(known) else np.zeros(len(distinct), np.int64)
    end_at = np.searchsorted(known, _END_HASH)
    end_count = int(counts[end_at]) if end_at < len(known) and known[end_at] == _END_HASH else 0
    base_word = np.log((count + 1) / (n + v + 1))
    base_end = float(np.log((end_count + 1) / (n + v + 1)))
    ids, begin = tools.words(words)
    sizes = np.diff(begin)
    if len(sizes) != len(words):
        raise ValueError("a word has no id of its own that starts with a space")
    # All documents' ids, in order, each with the end symbol after its last word.
    n_words = np.diff(first)
    word_ids = np.insert(index, first[1:], len(words))
    size = np.append(sizes, 1)[word_ids]
    head = np.append(begin[:-1], len(ids))[word_ids]
    ends = np.cumsum(size)
    pool = np.append(ids, tools.end)
    stream = pool[np.arange(ends[-1]) + np.repeat(head - (ends - size), size)] if len(size) else ids
    doc_words = np.concatenate([[0], np.cumsum(n_words + 1)])
    doc_ids = np.concatenate([[0], ends])[doc_words]
    log, over = model.score(stream, doc_ids)
    # A word's chance: its ids' chances, given that a word starts, times the chance that no id goes on with it.
    first_id, next_id = ends - size, ends
    word_log = np.add.reduceat(log.astype(np.float64), first_id) - over[first_id]
    after = np.append(over, 0.0)[next_id]
    after[doc_words[1:] - 1] = 0.0
    counted = np.append(count, end_count)[word_ids]
    head_id = pool[head]
    class_n, class_v = by_class[model.cls[head_id]].astype(float).T
    class_chance = np.exp(log[first_id].astype(np.float64) - model.inner[head_id] - over[first_id])
    freed = SHARE + (1 - SHARE) * np.where(class_n > 0, DISCOUNT * class_v / np.maximum(class_n, 1), 1.0)
    by_count = (1 - SHARE) * class_chance * np.maximum(counted - DISCOUNT, 0) / np.maximum(class_n, 1)
    mixed = np.log(freed * np.exp(word_log + after) + by_count + 1e-300)
    total = np.add.reduceat(mixed, doc_words[:-1])
    # Where other texts have the context too, what follows in them counts along, as a whole.
    doc, place, length, context, following = contexts(distinct[index], first)
    pair, times = memory.others(doc, context, following, learned)
    some = _apart(np.flatnonzero(times > 0), place, length)
    upto = np.concatenate([[0.0], np.cumsum(mixed)])
    alone, trusted = upto[place[some] + length[some]] - upto[place[some]], times[some] / (times[some] + TRUST)
    seen_there = np.log(np.maximum(trusted * pair[some] / np.maximum(times[some], 1), 1e-300))
    np.add.at(total, doc[some], np.logaddexp(np.log1p(-trusted) + alone, seen_there) - alone)
    total /= np.log(10)
    base = np.add.reduceat(np.append(base_word, base_end)[word_ids], doc_words[:-1]) / np.log(10)
    seen = np.add.reduceat((counted > 0).astype(np.int64), doc_words[:-1])
    return n_words + 1, seen, base, total


def _apart(some: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Those of some, in order, that begin where the one before has ended, or later."""
    after = np.searchsorted(place[some], place[some] + length[some]).tolist()
    kept, i = [], 0
    while i < len(after):
        kept.append(i)
        i = after[i]
    return some[np.array(kept, np.int64)]


def _by_chunk(chunk: list[int]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, c in enumerate(chunk):
        out.setdefault(c, []).append(i)
    return out


def _packed(keys: bytes) -> bytes:
    """Sorted 32-bit numbers as steps, byte by byte of all of them: most high bytes are zero, which compression takes out."""
    values = np.frombuffer(keys, np.uint32)
    return np.ascontiguousarray(np.diff(values, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


def _more_than_once(keys: list[np.ndarray]) -> list[np.ndarray]:
    """Of each of these sorted arrays, its distinct numbers that stand more than once in all of them.

    All are ordered once: looking each array up in what stands more than once would take their number times that.
    """
    values = np.concatenate(keys)
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    same = np.concatenate([[False], ordered[1:] == ordered[:-1]])
    many = np.zeros(len(values), bool)
    many[order] = same | np.append(same[1:], False)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    ends = np.cumsum([len(k) for k in keys])
    new[ends[:-1][ends[:-1] < len(values)]] = True
    kept = many & new
    return [k[some] for k, some in zip(keys, np.split(kept, ends[:-1]), strict=True)]


_tools: dict[str, Subwords] = {}


def _loaded(ranks: dict[bytes, int], pattern: str, name: str) -> Subwords:
    """The encoder of this worker process; name tells vocabularies and patterns apart."""
    if name not in _tools:
        _tools[name] = Subwords(ranks, pattern)
    return _tools[name]


def _segments(training: DataFrame, loaded) -> DataFrame:
    """turn, ids (two bytes each): all segments of training texts (k1, k2, text), those of a turn and of some megabytes in a row."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tools = loaded()
        for texts, k1, k2 in chunked(batches, ["k1", "k2"]):
            _, words, index, first = _joined(texts)
            pieces = np.maximum(1, -(-np.diff(first) // SEGMENT))
            doc = np.repeat(np.arange(len(texts)), pieces)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            key = np.asarray(k1, np.int64).view(np.uint64)[doc] ^ mix(np.asarray(k2, np.int64).view(np.uint64)[doc] + nth.astype(np.uint64))
            draw = (mix(key) % np.uint64(TURNS)).astype(np.int8)
            begin = first[doc] + nth * SEGMENT
            # The end stands after each text, and before each segment: that follows the end of another text, or words that aren't there.
            ends = np.concatenate([first[1:], begin])
            turn = np.insert(np.repeat(draw, np.minimum(begin + SEGMENT, first[doc + 1]) - begin), ends, np.concatenate([draw[np.cumsum(pieces) - 1], draw]))
            word = np.insert(index, ends, len(words))
            ids, head = tools.words(words)
            pool, size = np.append(ids, tools.end).astype(np.uint16), np.append(np.diff(head), 1)
            rows = [pool[_spans(head[word[turn == t]], size[word[turn == t]])].tobytes() for t in range(TURNS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(TURNS), pa.int32()), pa.array(rows, pa.binary())], ["turn", "ids"])

    return stash(training.select("k1", "k2", "text").mapInArrow(work, "turn int, ids binary"), "lm-segments")


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, .. size[i] numbers, for each i in turn."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def _sequence(batches: Iterator) -> np.ndarray:
    rows = [b for batch in batches for b in batch.column("ids").to_pylist()]
    return np.frombuffer(b"".join(rows), np.uint16)


def _counted(segments: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(occurrences of each id, counts of the most frequent ids before and after it): summed in Spark, bounded by the vocabulary."""
    import pyarrow as pa

    def count(batches: Iterator) -> Iterator:
        n = np.bincount(_sequence(batches), minlength=size)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["id", "n"])

    total = np.zeros(size, np.int64)
    for i, n in segments.mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas().to_numpy(np.int64):
        total[i] = n
    top = np.argsort(-total, kind="stable")[:NEIGHBOURS]
    column = np.full(size, -1)
    column[top] = np.arange(len(top))

    def beside(batches: Iterator) -> Iterator:
        ids, found = _sequence(batches), np.zeros(size * 2 * NEIGHBOURS, np.int32)
        for at in range(0, len(ids) - 1, 4_000_000):
            some = ids[at : at + 4_000_001]
            for own, other, shift in ((some[1:], some[:-1], 0), (some[:-1], some[1:], NEIGHBOURS)):
                both = np.flatnonzero((column[other] >= 0) & (total[own] >= 4))
                found += np.bincount(own[both].astype(np.int64) * (2 * NEIGHBOURS) + column[other[both]] + shift, minlength=len(found)).astype(np.int32)
        cell = np.flatnonzero(found).astype(np.int32)
        for at in range(0, len(cell), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(cell[at : at + 100_000]), pa.array(found[cell[at : at + 100_000]])], ["cell", "n"])

    near = np.zeros(size * 2 * NEIGHBOURS, np.float32)
    # Eight bytes for each pair of ids that is met: some tens of MB at most.
    cells = segments.mapInArrow(beside, "cell int, n int").groupBy("cell").agg(F.sum("n").cast("float").alias("n")).toPandas()
    near[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.float32)
    return total, near.reshape(size, -1)


def fit_model(training: DataFrame, loaded) -> Attention:
    """The attention model of training texts (k1, k2, text): all segments of all of them train the weights.

    In each turn every task goes through its own segments, starting from the same weights; those it ends with are
    averaged by the number of windows. Only counts by id and weights, of a fixed size each, come to the driver.
    """
    import pyarrow as pa

    segments = _segments(training, loaded)
    tools = loaded()
    model = Attention.fresh(*_counted(segments, tools.size), tools.starts)
    context = training.sparkSession.sparkContext

    def added(batches: Iterator) -> Iterator:
        weight, total = 0, 0.0
        for batch in batches:
            for n, w in zip(batch.column("n").to_pylist(), batch.column("w").to_pylist(), strict=True):
                weight, total = weight + n, total + n * np.frombuffer(w)
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([weight], pa.int64()), pa.array([(total / weight).tobytes()], pa.binary())], ["n", "w"])

    for turn in range(TURNS):
        sent = context.broadcast(model)

        def learn(batches: Iterator, turn: int = turn, sent=sent) -> Iterator:
            own = sent.value.unpacked(sent.value.packed())
            n = own.train(_sequence(batches), RATE * (1 - 0.75 * turn / TURNS), seed=turn)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([own.packed().tobytes()], pa.binary())], ["n", "w"])

        trained = segments.where(F.col("turn") == turn).mapInArrow(learn, "n bigint, w binary").where("n > 0")
        # Two rounds of averages: the driver gets a few rows, however many tasks there are.
        parts = list(trained.repartition(16).mapInArrow(added, "n bigint, w binary").toPandas().itertuples(index=False))
        if parts:
            n = np.array([p.n for p in parts], float)
            model = model.unpacked(np.average([np.frombuffer(p.w) for p in parts], axis=0, weights=n))
    discard(segments)
    return model


def score(docs: DataFrame, training, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row; training says which rows to learn from.

    Tokens are words in lower case (A-Z) and one end for each text. base_score is the log10 probability by add-one
    word counts, score that of the model: the attention's chance of a word's subwords (SHARE), and of its first
    subword's class times the word's share of the corpus's counts in that class, discounted in favour of the former.
    After contexts (see contexts()) that other training texts have too, what follows there is
    counted along; no text is its own memory, so that texts learned from and others compare.

    A null text is empty and has the end alone. Repeated rows are texts of their own; other columns play no part; an
    empty table gives no rows, and one without training texts is scored by an untrained model.

    Texts are dealt over chunks of some megabytes. Chunks first tell which contexts they have, by few bits each, and learn
    which of these stand anywhere else. A chunk then asks for each of its distinct words and of those contexts, telling
    how often its training texts have it; counts are added up over the chunks and sent back to them. So a
    frequent word has few rows for each chunk, however often it stands in it.
    """
    spark = docs.sparkSession
    name = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    n_parts = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
    chunks = max(2 * n_parts, -(-n_bytes // CHUNK_BYTES))
    tools = spark.sparkContext.broadcast(ranks)

    def loaded() -> Subwords:
        return _loaded(tools.value, pattern, name)

    model = fit_model(rows.where("train").select(*row_key(), "text"), loaded)
    fitted = spark.sparkContext.broadcast(model)
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")).repartition(n_parts, "chunk")

    bits = min(BUCKET_BITS, max(6, (n_parts - 1).bit_length()))
    near_bits = np.uint64(32 - bits)

    def have(batches: Iterator) -> Iterator:
        """Each chunk's contexts, by bucket, in order: 32 bits each, twice those that the chunk has more than once."""
        import pyarrow as pa

        held: dict[int, list] = {}

        def flush() -> Iterator:
            for c, parts in held.items():
                keys, n = np.unique(np.concatenate(parts) >> near_bits, return_counts=True)
                keys = np.repeat(keys, np.minimum(n, 2))
                bucket, begin = np.unique(keys >> np.uint64(32), return_index=True)
                blobs = [k.astype(np.uint32).tobytes() for k in np.split(keys, begin[1:])] if len(keys) else []
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(blobs), c, np.int32)), pa.array(bucket.astype(np.int32)), pa.array([_packed(b) for b in blobs], pa.binary())], ["chunk", "bucket", "keys"])
            held.clear()

        size = 0
        for texts, chunk in chunked(batches, ["chunk"]):
            for c, some in _by_chunk(chunk).items():
                blob, starts, ends, first = word_bounds([texts[i] for i in some])
                held.setdefault(c, []).append(contexts(word_hashes(blob, starts, ends, lower=True), first)[3])
                size += len(held[c][-1])
            if size > HELD:
                yield from flush()
                size = 0
        yield from flush()

    def meet(table):
        """Of each chunk's contexts in a bucket, those that stand there more than once."""
        import pyarrow as pa

        kept = _more_than_once([_unpacked(k) for k in table.column("keys").to_pylist()])
        return pa.Table.from_arrays([table.column("chunk"), table.column("bucket"), pa.array([_packed(k.tobytes()) for k in kept], pa.binary())], ["chunk", "bucket", "keys"])

    schema = "chunk int, bucket int, keys binary"
    had = dealt.mapInArrow(have, schema).repartition(n_parts, "bucket").groupBy("bucket").applyInArrow(meet, schema)

    def ask(left, right):
        import pyarrow as pa

        shared = [np.uint64(b) << np.uint64(32) | _unpacked(k).astype(np.uint64) for b, k in zip(right.column("bucket").to_pylist(), right.column("keys").to_pylist(), strict=True)]
        shared = np.sort(np.concatenate(shared)) if shared else np.zeros(0, np.uint64)
        names = ["chunk", "word", "next", "n", "class"]
        parts = list(asked_of(left.to_batches(), shared))
        return pa.Table.from_batches(parts) if parts else pa.Table.from_arrays([pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())], names)

    def asked_of(batches, shared: np.ndarray) -> Iterator:
        import pyarrow as pa

        held: dict[int, list] = {}

        def flush() -> Iterator:
            for c, parts in held.items():
                key, val, n, cls = (np.concatenate(p) for p in zip(*parts, strict=True))
                _, at, index = np.unique(np.where(cls < 0, val, key), return_index=True, return_inverse=True)
                total = np.bincount(index, weights=n, minlength=len(at)).astype(np.int32)
                cells = (np.full(len(at), c, np.int32), key[at].view(np.int64), val[at].view(np.int64), total, cls[at])
                yield pa.RecordBatch.from_arrays(list(map(pa.array, cells)), ["chunk", "word", "next", "n", "class"])
            held.clear()

        size = 0
        for texts, chunk, train in chunked(batches, ["chunk", "train"]):
            for c, some in _by_chunk(chunk).items():
                distinct, words, index, first = _joined([texts[i] for i in some])
                learn = np.array([train[i] for i in some], bool)
                count = np.bincount(index, weights=np.repeat(learn, np.diff(first)), minlength=len(distinct))
                cls = first_classes(fitted.value, loaded(), words)
                doc, _, _, context, word = contexts(distinct[index], first)
                # What no other place has would be told of nothing.
                met = np.isin(context >> near_bits, shared)
                doc, context, word = doc[met], context[met], word[met]
                key = np.concatenate([distinct, [_END_HASH], context])
                val = np.concatenate([np.zeros(len(distinct) + 1, np.uint64), _both(context, word)])
                cls = np.concatenate([cls, [fitted.value.cls[-1]], np.full(len(doc), -1)]).astype(np.int32)
                held.setdefault(c, []).append((key, val, np.concatenate([count, [learn.sum()], learn[doc]]).astype(np.int32), cls))
                size += len(key)
            if size > HELD:
                yield from flush()
                size = 0
        yield from flush()

    # All columns of dealt and of asked are used wherever they are read, so that each of the two is dealt out once.
    asked = dealt.groupBy("chunk").cogroup(had.groupBy("chunk")).applyInArrow(ask, "chunk int, word bigint, next bigint, n int, class int").repartition(n_parts, "word")
    of_word, of_pair = Window.partitionBy("word"), Window.partitionBy("word", "next")
    met = asked.withColumns({"c": F.sum("n").over(of_pair), "t": F.sum("n").over(of_word)})
    # A context is told of if a text that isn't the asker's own can have it.
    met = met.where("(class >= 0 AND c > 0) OR (class < 0 AND (t > 1 OR t > n))")
    # next names a context and what follows there by itself, so that an answer needs one of the two hashes alone.
    about = F.when(F.col("class") < 0, F.col("next")).otherwise(F.col("word")).alias("word")
    answers = met.select("chunk", about, "c", F.when(F.col("class") < 0, F.col("t")).otherwise(0).alias("t"), F.when(F.col("class") < 0, -1).otherwise(0).alias("kind"))
    # Every chunk is also told the training tokens and distinct ones of each class: as many rows as there are classes.
    types = asked.groupBy("word").agg(F.sum("n").alias("c"), F.max("class").alias("class"), F.max("chunk").alias("chunk"), F.max("next").alias("next")).where("c > 0 AND class >= 0 AND chunk >= 0 AND next IS NOT NULL")
    totals = types.groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"))
    told = totals.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.col("n").alias("word"), F.col("v").alias("c"), F.lit(0).cast("bigint").alias("t"), (F.col("class") + 1).alias("kind"))

    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def work(left, right):
        import pyarrow as pa

        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        if not left.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in types], names)
        kind, word, c, t = (right.column(n).to_numpy() for n in ("kind", "word", "c", "t"))
        by_class = np.zeros((STARTS + GOES_ON, 2), np.int64)
        by_class[kind[kind > 0] - 1] = np.stack([word[kind > 0], c[kind > 0]], axis=1)
        known, order = np.unique(word[kind == 0].view(np.uint64), return_index=True)
        far = kind < 0
        both, at = np.unique(word[far].view(np.uint64), return_index=True)
        memory, counts = Memory(both, c[far][at], t[far][at]), c[kind == 0][order]
        results = []
        for texts, ids, train in chunked(left.to_batches(), ["doc_id", "train"], size=500_000):
            results.append((ids, *chunk_scores(texts, np.array(train, bool), known, counts, by_class, memory, fitted.value, loaded())))
        ids, tokens, seen, base, total = (np.concatenate(r) if k else sum(r, []) for k, r in enumerate(zip(*results, strict=True)))
        columns = (ids, tokens, seen, np.full(len(tokens), by_class[:, 0].sum(), np.int64), base, total)
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)

    schema = "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return dealt.groupBy("chunk").cogroup(answers.unionByName(told).groupBy("chunk")).applyInArrow(work, schema)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document, by score()."""
    import base64

    import public_tokenizers as tokenizers

    with open(tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, remainder(7) != 2, ranks, tokenizers.PATTERN)
    return scored.withColumn("held_out", remainder(7) == 2)
