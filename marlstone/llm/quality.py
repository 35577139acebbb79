"""Operator 5: supervised subword embeddings.

A document is the mean of learned vectors of its hashed words and character n-grams; a softmax layer turns it into class
probabilities. Vectors and layer are trained together by stochastic gradient descent in numpy on at most ``fit_rows``
labelled documents of each class (the documented bound); every document is then scored on its whole text. As the layer
is linear, each bucket's contribution to the logit is one number, so scoring looks up one float for each feature.

Only rows whose crc32(doc_id as text) modulo ``folds`` is not 0 teach; scores see the text alone.

Edge cases: null and empty texts are scored by the layer's offset alone; repeated rows score alike; a null ``doc_id`` is
scored and counts as held out false; labels that are null, out of range or doubled with different values for one
doc_id do not teach; without two classes to learn from every score is the share of class 1 (1.0 without any label);
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, begin, byte_hasher, joined, mix64, release, text_slices, word_bounds

WORD_BUCKETS, GRAM_BUCKETS, GRAMS = 1 << 16, 1 << 17, (3, 4)
#: One more bucket for a word that repeats the word before it.
AGAIN = WORD_BUCKETS + GRAM_BUCKETS
BUCKETS = AGAIN + 1
U = np.uint64


def features(texts: list[str]):
    """Arrays (text number, bucket), one pair for each feature, in no order across kinds."""
    data, at = joined(texts)
    start, end = word_bounds(data)
    words = byte_hasher()(data, start, end)
    owner = (np.searchsorted(at, start, "right") - 1).astype(np.int32)
    again = np.flatnonzero((words[1:] == words[:-1]) & (owner[1:] == owner[:-1])) + 1
    out = [(owner, (words % U(WORD_BUCKETS)).astype(np.int32)), (owner[again], np.full(len(again), AGAIN, dtype=np.int32))]
    gap = SPACE[data]
    plain = np.where(gap, np.uint8(32), data).astype(np.uint64)
    text_of = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(at))
    for n in GRAMS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        h = np.full(m, U(n))
        for j in range(n):
            h = h * U(0x100000001B3) + plain[j : j + m]
        inner = np.zeros(m, dtype=bool)
        for j in range(1, n - 1):
            inner |= gap[j : j + m]
        ok = np.flatnonzero(~inner & (text_of[:m] == text_of[n - 1 :]))
        out.append((text_of[ok], (WORD_BUCKETS + (mix64(h[ok]) % U(GRAM_BUCKETS)).astype(np.int64)).astype(np.int32)))
    return [x[0] for x in out], [x[1] for x in out]


def train(texts: list[str], labels: np.ndarray, dim: int = 16, steps: int = 20_000, rate: float = 0.5, seed: int = 5):
    """(logit of each bucket, offset): vectors and softmax layer by SGD, folded into one number a bucket.

    About ``steps`` single-document steps are made however few documents there are, so that small sets are learned too.
    """
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    w, b = np.zeros((dim, 2)), np.zeros(2)
    bags = []
    for i in range(0, len(texts), 64):
        owner, bucket = (np.concatenate(x) for x in features(texts[i : i + 64]))
        key, count = np.unique(owner.astype(np.int64) * BUCKETS + bucket, return_counts=True)
        cut = np.searchsorted(key, np.arange(len(texts[i : i + 64]) + 1) * BUCKETS)
        share = count.astype(np.float32)
        bags += [((key[x:y] % BUCKETS).astype(np.int32), share[x:y] / max(1.0, float(share[x:y].sum()))) for x, y in zip(cut, cut[1:])]
    epochs = max(1, -(-steps // len(bags)))
    steps, t = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)).tolist():
            at, share = bags[i]
            lr = rate * (1 - t / steps)
            t += 1
            rows = e[at]
            h = share @ rows
            z = h @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1.0
            back = w @ p
            w -= lr * np.outer(h, p)
            b -= lr * p
            # each bucket moves by its share, scaled up as a document's mean moves by the sum of squared shares
            e[at] = rows - (lr * share / max(share @ share, 1e-3))[:, None] * back * 0.1
    return (e @ (w[:, 1] - w[:, 0])).astype(np.float32), float(b[1] - b[0])


def score_texts(texts: list[str], logit: np.ndarray, offset: float) -> np.ndarray:
    """Probability of class 1 for each text."""
    total, held = np.zeros(len(texts)), np.zeros(len(texts))
    for owner, bucket in zip(*features(texts)):
        total += np.bincount(owner, weights=logit[bucket], minlength=len(texts))
        held += np.bincount(owner, minlength=len(texts))
    z = np.clip(total / np.maximum(held, 1) + offset, -60, 60)
    return 1.0 / (1.0 + np.exp(-z))


def score_series(texts, logit: np.ndarray, offset: float, rows: int = 256, size: int = 1 << 18) -> np.ndarray:
    """:func:`score_texts` of a pandas Series, from some ``rows`` rows and ``size`` bytes at a time: features take some
    fifty times the room of their texts."""
    out = [np.zeros(0)]
    for at in range(0, len(texts), rows):
        part = pa.array(texts.iloc[at : at + rows], pa.string(), from_pandas=True)
        out += [score_texts(t, logit, offset) for _, t in text_slices(part, size)]
    return np.concatenate(out)


def held_out(folds: int = 5):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", fit_rows: int = 2500, folds: int = 5):
    """(logit of each bucket, offset) learned from at most ``fit_rows`` teaching rows of each class.

    Rows are those with the smallest hashes of their doc_id, so reruns agree. Only they leave the executors.
    """
    good = labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & ~held_out(folds))
    good = good.groupBy("doc_id").agg(F.min(target).alias("y"), F.max(target).alias("y2")).where("y = y2")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picks = [good.where(F.col("y") == c).orderBy(*order).limit(fit_rows).select("doc_id", "y") for c in (0, 1)]
    chosen = F.broadcast(picks[0].unionByName(picks[1]))  # 2 * fit_rows rows at most
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    got = rows.dropDuplicates(["doc_id"]).orderBy("doc_id").select("text", "y").toArrow()
    texts, y = got.column(0).to_pylist(), got.column(1).to_numpy().astype(np.int64)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 1.0
        return np.zeros(BUCKETS, dtype=np.float32), float(np.log(max(share, 1e-12)) - np.log(max(1 - share, 1e-12)))
    model = train(texts, y)
    release()  # the driver keeps the model only
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, keep_text: bool = False, threshold: float = 0.3, folds: int = 5, **how) -> DataFrame:
    """Each row of ``docs`` with held_out, score and predicted; only doc_id besides unless ``keep_text``."""
    logit, offset = fit(docs, labels, folds=folds, **how)
    model = docs.sparkSession.sparkContext.broadcast((logit, offset))  # BUCKETS floats: under 1 MB

    def score(series):
        import pandas as pd

        begin(byte_hasher)
        for texts in series:
            yield pd.Series(score_series(texts, *model.value))
        release()

    from typing import Iterator

    import pandas as pd

    score.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    scored = docs.withColumn("score", F.pandas_udf(score, "double")(F.col("text")))
    scored = scored if keep_text else scored.select("doc_id", "score")
    return scored.withColumn("held_out", held_out(folds)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
