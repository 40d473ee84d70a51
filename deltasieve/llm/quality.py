"""Quality classifier co-trained on two views: the text, and what is known about the page."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import IS_SPACE, mix, small_batches, stash, word_bounds, word_hashes

#: Labelled documents that are learned from: so many at most, those least by hash of doc_id.
LABELLED = 12_000
#: Rounds of exchange, logit from which a view is sure of a document, and ridge of the views and of their calibration.
ROUNDS, SURE, PENALTY, MILD = 5, 1.0, 120.0, 1.0
BIGRAMS, WORDS, PAIRS, SOURCES, LANGS = 128, 128, 128, 64, 16
_KIND = np.zeros(256, np.uint8)
_KIND[128:] = 1
_KIND[97:123] = 2
_KIND[65:91] = 3
_KIND[48:58] = 4
_KIND[IS_SPACE] = 5
_KIND[[33, 34, 35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126]] = 6
_KIND[[39, 40, 41, 44, 45, 46, 58, 59, 63]] = 7
TEXT_WIDTH, META_WIDTH = 8 + 7 + BIGRAMS + WORDS + PAIRS, SOURCES + LANGS + 2


def text_view(texts: list[bytes]) -> np.ndarray:
    """Features of whole texts: shares of byte classes, word statistics, repetition, hashed byte bigrams, words and word pairs."""
    blob, starts, ends, first = word_bounds(texts)
    data = np.frombuffer(blob, np.uint8)
    n = len(texts)
    offsets = np.cumsum([1] + [len(t) + 1 for t in texts])
    doc = np.repeat(np.arange(n), np.diff(offsets))
    body = data[1:]
    size = np.maximum(1, np.diff(offsets))[:, None]
    kinds = np.bincount(doc * 8 + _KIND[body], minlength=8 * n).reshape(n, 8)
    pair = (body.astype(np.uint32) * np.uint32(40503) + data[:-1] * np.uint32(30011)) >> np.uint32(3)
    pairs = np.bincount(doc * BIGRAMS + (pair % np.uint32(BIGRAMS)), minlength=BIGRAMS * n).reshape(n, BIGRAMS)
    words = np.diff(first)
    at = np.repeat(np.arange(n), words)
    lengths = ends - starts
    hashes = word_hashes(blob, starts, ends, lower=True)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (at[1:] == at[:-1])
    order = np.lexsort((hashes, at))
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (at[order][1:] != at[order][:-1])
    per = np.maximum(words, 1)
    marked = _KIND[data[ends - 1]]

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(at, weights=values, minlength=n) / per

    both = np.flatnonzero(at[1:] == at[:-1]) + 1
    grams = [
        np.bincount(at * WORDS + (hashes % np.uint64(WORDS)).astype(np.int64), minlength=WORDS * n).reshape(n, WORDS),
        np.bincount(at[both] * PAIRS + (mix(hashes[both] + hashes[both - 1] * np.uint64(3)) % np.uint64(PAIRS)).astype(np.int64), minlength=PAIRS * n).reshape(n, PAIRS),
    ]
    long_ = mean(lengths)
    stats = [np.log1p(words), long_, np.sqrt(np.maximum(0, mean(lengths.astype(float) ** 2) - long_**2)), mean(same), np.bincount(at[order][new], minlength=n) / per, mean(marked == 6), mean(marked == 7)]
    return np.concatenate([kinds / size, np.stack(stats, axis=1), np.sqrt(pairs / size), *(np.sqrt(g / per[:, None]) for g in grams)], axis=1).astype(np.float32)


def meta_view(sources: list, langs: list, sizes: list) -> np.ndarray:
    """Features of the page: hashed source and language, and its stated number of characters (null has a mark)."""
    out = np.zeros((len(sources), META_WIDTH), np.float32)
    for i, (source, lang, size) in enumerate(zip(sources, langs, sizes, strict=True)):
        out[i, zlib.crc32(("" if source is None else f"={source}").encode()) % SOURCES] = 1
        out[i, SOURCES + zlib.crc32(("" if lang is None else f"={lang}").encode()) % LANGS] = 1
        out[i, -2] = np.log1p(max(0, size or 0))
        out[i, -1] = size is None
    return out


@dataclass
class Logistic:
    """Ridge logistic regression on standardised features, by Newton steps."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 12) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-9] = 1
        model = cls(mean, scale, np.zeros(x.shape[1] + 1))
        for _ in range(steps):
            if np.abs(model.step(x, y, penalty)).max() < 1e-6:
                break
        return model

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Standardised features and a one."""
        return np.concatenate([(x - self.mean) / self.scale, np.ones((len(x), 1))], axis=1).astype(float)

    def step(self, x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, more: np.ndarray | None = None, weight: float = 1.0) -> np.ndarray:
        """One Newton step on rows x and labels y.

        more is the gradient of other rows, and weight what all rows weigh against these; as the others' curvature isn't
        known, it is then taken at its bound of a quarter, so that the step is never too long.
        """
        z = self.rows(x)
        p = 1 / (1 + np.exp(-np.clip(z @ self.weight, -30, 30)))
        ridge = np.full(len(self.weight), penalty)
        ridge[-1] = 1e-6
        curve = np.maximum(p * (1 - p), 1e-6) if more is None else np.full(len(z), weight / 4)
        gradient = z.T @ (y - p) - ridge * self.weight + (0 if more is None else more)
        step = np.linalg.solve((z * curve[:, None]).T @ z + np.diag(ridge), gradient)
        self.weight = self.weight + step
        return step

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.rows(x) @ self.weight, -30, 30)


@dataclass
class CoTrained:
    """Two views' classifiers, each with its calibration, and the weights that combine them."""

    text: Logistic
    meta: Logistic
    text_scale: Logistic
    meta_scale: Logistic
    both: Logistic

    def scores(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Probability of good quality by [text, meta, both]."""
        a, b = self.text_scale.logit(self.text.logit(text)[:, None]), self.meta_scale.logit(self.meta.logit(meta)[:, None])
        return 1 / (1 + np.exp(-np.stack([a, b, self.both.logit(np.stack([a, b], axis=1))], axis=1)))


def told(models: tuple[Logistic, Logistic], views: tuple[np.ndarray, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each view: by label, the gradient of the rows that the other view is sure of, and their number."""
    logits = [m.logit(x) for m, x in zip(models, views, strict=True)]
    out = []
    for view in (0, 1):
        z, other = models[view].rows(views[view]), logits[1 - view]
        gradient, count = np.zeros((2, z.shape[1])), np.zeros(2)
        for label, sure in enumerate((other <= -SURE, other >= SURE)):
            p = 1 / (1 + np.exp(-logits[view][sure]))
            gradient[label], count[label] = z[sure].T @ (label - p), sure.sum()
        out.append((gradient, count))
    return out


def co_train(text: np.ndarray, meta: np.ndarray, label: np.ndarray, ask) -> CoTrained | None:
    """Fit on labelled rows (label 0 or 1) and, through ask, on all others; None without both labels.

    Every third labelled row is held back to calibrate. In each round ask(models) gives what told() does, summed over
    all other rows; each view then takes a step on the labelled rows and on those that the other view is sure of,
    which together weigh as much as the labelled ones, in the labels' ratio, however many they are.
    """
    held = np.arange(len(label)) % 3 == 2
    if len(set(label[~held].tolist())) < 2:
        return None
    held = held if len(set(label[held].tolist())) == 2 else ~held
    known = label[~held]
    share = np.clip([1 - known.mean(), known.mean()], 0.02, 0.98)
    views = (text, meta)
    models = tuple(Logistic.fit(x[~held], known) for x in views)
    for _ in range(ROUNDS):
        for model, x, (gradient, count) in zip(models, views, ask(models), strict=True):
            weight = np.where(count > 0, share * len(known) / np.maximum(count, 1), 0.0)
            model.step(x[~held], known, more=weight @ gradient, weight=1 + float((weight * count).sum()) / len(known))
    scaled = [Logistic.fit(m.logit(x[held])[:, None], label[held], MILD) for m, x in zip(models, views, strict=True)]
    logits = np.stack([s.logit(m.logit(x[held])[:, None]) for s, m, x in zip(scaled, models, views, strict=True)], axis=1)
    return CoTrained(*models, *scaled, Logistic.fit(logits, label[held], MILD))


def _lists(batch) -> tuple:
    """Texts as bytes and sources, languages and lengths of a batch; a column that isn't there is null."""
    import pyarrow as pa

    def column(name: str, kind) -> list:
        if name not in batch.schema.names:
            return [None] * batch.num_rows
        return batch.column(name).cast(pa.string() if kind == pa.binary() else kind, safe=False).cast(kind).to_pylist()

    return [t or b"" for t in column("text", pa.binary())], column("source", pa.string()), column("lang", pa.string()), column("n_chars", pa.int64())


def _views(batch) -> Iterator[np.ndarray]:
    """Both views of a batch's rows side by side, some hundred rows at a time."""
    for at in range(0, batch.num_rows, 500):
        texts, sources, langs, sizes = _lists(batch.slice(at, 500))
        yield np.concatenate([text_view(texts), meta_view(sources, langs, sizes)], axis=1)


def features(docs: DataFrame) -> DataFrame:
    """doc_id and x (both views) of each row, written once: what is learned and what is scored reads no text again."""
    small_batches(docs.sparkSession)
    kinds = {"text": "string", "source": "string", "lang": "string", "n_chars": "bigint"}
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[F.col(c).cast(t).alias(c) for c, t in kinds.items() if c in docs.columns])

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = [row.tobytes() for part in _views(batch) for row in part]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.binary())], ["doc_id", "x"])

    return stash(plain.mapInArrow(work, "doc_id bigint, x binary"), "features")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, TEXT_WIDTH + META_WIDTH)


def learn(found: DataFrame, labels: DataFrame) -> CoTrained | None:
    """Fit on features() of documents: on at most LABELLED with a label, and on all others as unlabelled ones.

    A document's label is the majority of its rows in labels, a tie counting as good; null labels and ids don't count.
    The labelled rows' features come to the driver; of all others only sums do, of a fixed size, in each round.
    """
    marks = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    ids = found.select("doc_id").where("doc_id IS NOT NULL").distinct().join(marks, "doc_id")
    some = stash(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED), "quality-sample")
    # At most LABELLED rows of two numbers are broadcast.
    rows = found.join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id"]).toPandas()
    if rows.empty:
        return None
    rows = rows.sort_values("doc_id", key=lambda s: s.map(lambda i: zlib.crc32(str(i).encode())), kind="stable")
    x = np.stack([np.frombuffer(b, np.float32) for b in rows["x"]])
    context = found.sparkSession.sparkContext
    taken = context.broadcast(np.sort(rows["doc_id"].to_numpy(np.int64)))

    def ask(models: tuple[Logistic, Logistic]) -> list[tuple[np.ndarray, np.ndarray]]:
        sent = context.broadcast(models)

        def work(batches: Iterator) -> Iterator:
            import pyarrow as pa

            total: list | None = None
            for batch in batches:
                ids = batch.column("doc_id").fill_null(-(2**63)).to_numpy(zero_copy_only=False)
                all_ = _matrix(batch.column("x"))[~np.isin(ids, taken.value)]
                parts = told(sent.value, (all_[:, :TEXT_WIDTH], all_[:, TEXT_WIDTH:]))
                total = parts if total is None else [(g + h, n + m) for (g, n), (h, m) in zip(total, parts, strict=True)]
            for view, (gradient, count) in enumerate(total or []):
                for label in (0, 1):
                    v = np.append(gradient[label], count[label])
                    same = [np.full(len(v), k, np.int32) for k in (view, label)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, same), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["view", "label", "at", "v"])

        sums = found.mapInArrow(work, "view int, label int, at int, v double").groupBy("view", "label", "at").agg(F.sum("v").alias("v")).collect()
        out = [(np.zeros((2, len(m.weight))), np.zeros(2)) for m in models]
        for view, label, at, v in sums:
            gradient, count = out[view]
            if at < gradient.shape[1]:
                gradient[label, at] = v
            else:
                count[label] = v
        return out

    return co_train(x[:, :TEXT_WIDTH], x[:, TEXT_WIDTH:], rows["label"].to_numpy(), ask)


def _scores(model: CoTrained | None, x: np.ndarray) -> np.ndarray:
    return np.ones((len(x), 3)) if model is None else model.scores(x[:, :TEXT_WIDTH], x[:, TEXT_WIDTH:])


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, text_score, meta_score, score (probability of good quality) and keep (score >= threshold) for each row.

    Null texts count as empty and null or absent metadata (source, lang, n_chars) as a value of its own; repeated rows
    give repeated results; other columns play no part; an empty table gives no rows. Without labels of both kinds
    everything scores 1.
    """
    found = features(docs)
    model = docs.sparkSession.sparkContext.broadcast(learn(found, labels))

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            s = _scores(model.value, _matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(s[:, i]) for i in range(3)), pa.array(s[:, 2] >= threshold)], ["doc_id", "text_score", "meta_score", "score", "keep"])

    return found.mapInArrow(work, "doc_id bigint, text_score double, meta_score double, score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score() keeps, with all their columns; nulls, repeated rows and empty tables as there."""
    model = docs.sparkSession.sparkContext.broadcast(learn(features(docs), labels))

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            good = [_scores(model.value, x)[:, 2] >= threshold for x in _views(batch)]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *good])))

    return docs.mapInArrow(work, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text_score, meta_score, score and keep of every document, by score() with the given labels."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
