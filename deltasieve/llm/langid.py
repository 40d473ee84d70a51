"""Language proportions of documents by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import chunked, remainder, word_bounds

#: Byte trigrams are hashed to so many cells; a language's profile is that many counts.
CELLS = 1 << 15
#: Pseudo-count of a cell. Trigrams overlap, so a word's log-likelihood is scaled down by their length.
SMOOTHING, TEMPER = 0.5, 1 / 3
#: Between documents, so that no trigram reaches from one into the next.
GAP = b"\n\n"
#: Languages that may be learned: what the driver and each task hold grows with them.
MOST_LANGS = 1000
#: EM steps for the full set and for each smaller one, and the fee for one more language.
STEPS, FEWER_STEPS, PENALTY = 8, 4, 6.0
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _cells(blob: bytes) -> np.ndarray:
    """Cell of the trigram that ends at each byte, A-Z in lower case and white space as one kind of space."""
    b = _FOLD[np.frombuffer(blob, np.uint8)].astype(np.uint32)
    code = b * np.uint32(0x9E3779B1)
    code[1:] += b[:-1] * np.uint32(0x85EBCA6B)
    code[2:] += b[:-2] * np.uint32(0xC2B2AE35)
    code ^= code >> np.uint32(15)
    return (code & np.uint32(CELLS - 1)).astype(np.int32)


def count_profiles(docs: DataFrame) -> DataFrame:
    """lang, cell, n over every whole text of docs that has a lang; summed within each task before the shuffle."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total: dict[str, np.ndarray] = {}
        for texts, langs in chunked(batches, ["lang"]):
            by_lang: dict[str, list[bytes]] = {}
            for text, lang in zip(texts, langs, strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, some in by_lang.items():
                # The leading gap belongs to no text.
                count = np.bincount(_cells(GAP + GAP.join(some) + GAP)[len(GAP) :], minlength=CELLS)
                total[lang] = total.get(lang, 0) + count
        for lang, count in total.items():
            cell = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cell), pa.string()), pa.array(cell.astype(np.int32)), pa.array(count[cell])], ["lang", "cell", "n"])

    parts = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(work, "lang string, cell int, n bigint")
    return parts.groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages in order, log-probability of each cell in each): CELLS numbers a language, whatever the corpus.

    Without any text that has a lang there are no languages; over MOST_LANGS of them are an error, none is left out.
    """
    if docs.where("lang IS NOT NULL").select("lang").distinct().limit(MOST_LANGS + 1).count() > MOST_LANGS:
        raise ValueError(f"over {MOST_LANGS} values of lang: their profiles are more than the driver should hold")
    found = count_profiles(docs).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.zeros((len(langs), CELLS))
    at = {lang: i for i, lang in enumerate(langs)}
    counts[found["lang"].map(at).to_numpy(int), found["cell"].to_numpy(int)] = found["n"].to_numpy(float)
    return langs, np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * CELLS)).astype(np.float32) if langs else counts


def _em(like: np.ndarray, doc: np.ndarray, begin: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihood) of each document; like[word, lang], a document's words from begin on."""
    n = np.diff(np.concatenate([begin, [len(doc)]]))[:, None]
    for _ in range(steps):
        part = like * share[doc]
        part /= part.sum(axis=1, keepdims=True)
        share = np.add.reduceat(part, begin, axis=0) / n
    return share, np.add.reduceat(np.log((like * share[doc]).sum(axis=1)), begin)


def mixture(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """Proportions [document, language] of a chunk: zero outside the chosen set, all zero without words.

    The word is the unit that has one language; its likelihood is that of its trigrams, with the spaces around it. The
    languages of the fitted mixture, in order of their share, give nested sets; the one with the best
    log-likelihood less half of log(words) and PENALTY for each language is chosen and fitted again.
    """
    blob, starts, ends, first = word_bounds(texts, GAP)
    out = np.zeros((len(texts), len(table)))
    rows = np.flatnonzero(np.diff(first))
    if not len(rows) or not len(table):
        return out
    cells = _cells(blob)
    edges = np.stack([starts, ends + 1], axis=1).ravel()
    edges[-1] = min(edges[-1], len(blob) - 1)
    log = np.stack([np.add.reduceat(row[cells], edges)[::2] for row in table], axis=1) * np.float32(TEMPER)
    top = log.max(axis=1, keepdims=True)
    like = np.exp(log - top) + np.float32(1e-12)
    begin, n = first[rows], np.diff(first)[rows]
    doc = np.repeat(np.arange(len(rows)), n)
    share, _ = _em(like, doc, begin, np.full((len(rows), len(table)), 1 / len(table), np.float32), STEPS)
    order = np.argsort(-share, axis=1, kind="stable")
    fee = PENALTY + 0.5 * np.log(n)
    best = np.zeros_like(share)
    best[np.arange(len(rows)), order[:, 0]] = 1
    value = np.add.reduceat(np.log(like[np.arange(len(doc)), order[doc, 0]]), begin) - fee
    for k in range(2, len(table) + 1):
        # Only documents whose k-th language has a share that could pay its fee are fitted again.
        some = np.flatnonzero(share[np.arange(len(rows)), order[:, k - 1]] * n > 0.5)
        if not len(some):
            break
        words = np.flatnonzero(np.isin(doc, some)) if len(some) < len(rows) else np.arange(len(doc))
        size = n[some]
        inner, at = np.repeat(np.arange(len(some)), size), np.concatenate([[0], np.cumsum(size)[:-1]])
        start = np.zeros((len(some), len(table)), np.float32)
        np.put_along_axis(start, order[some, :k], np.take_along_axis(share[some], order[some, :k], 1), 1)
        fitted, fit = _em(like[words], inner, at, start / start.sum(axis=1, keepdims=True), FEWER_STEPS)
        fit = fit - k * fee[some]
        better = fit > value[some]
        best[some[better]], value[some[better]] = fitted[better], fit[better]
    out[rows] = best
    return out


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def identify(docs: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score (its share, 0 to 1), langs and shares (the chosen set, by share) for each row of docs.

    lang_pred is 'und', with score 0 and empty sets, for a null text, one without a letter, or if nothing was learned.
    Only the text is looked at, the whole of it; ties go to the language first in order. Repeated rows give repeated
    results, other columns play no part, and an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(table)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for texts, ids in chunked(batches, ["doc_id"]):
            share = mixture(texts, model.value)
            pred, score, sets, shares = [], [], [], []
            for text, row in zip(texts, share, strict=True):
                seen = np.frombuffer(text, np.uint8)
                if not row.any() or not (_LETTER[seen].any() or _has_letter(text)):
                    row = row * 0
                order = [i for i in np.argsort(-row, kind="stable").tolist() if row[i] > 0]
                pred.append(langs[order[0]] if order else "und")
                score.append(min(1.0, float(row[order[0]])) if order else 0.0)
                sets.append([langs[i] for i in order])
                shares.append([float(row[i]) for i in order])
            columns = [pa.array(ids, pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "langs", "shares"])

    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string"))
    return plain.mapInArrow(work, "doc_id bigint, lang_pred string, score double, langs array<string>, shares array<double>")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, langs, shares of every document; the held-out fifth is not learned from.

    Null texts and texts without letters are 'und' with score 0; repeated rows give equal rows; ties as in identify().
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    langs, table = learn(docs.where(remainder(5) != 0))
    found = identify(docs, langs, table)
    return found.select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score", "langs", "shares")
