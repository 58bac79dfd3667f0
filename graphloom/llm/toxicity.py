"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier in numpy over the presence of hashed words and their first letters
(so that inflected forms of one stem count together) learns from confirmed toxic
documents and unlabelled ones. With class prior p and logistic losses, the risk is
p R+(positives) + max(0, R-(unlabelled) - p R-(positives)): the unlabelled texts stand
for both classes, and the correction takes the hidden positives out of them; when the
corrected part turns negative, the step ascends on it instead, so the model can't
overfit by making it ever more negative.

The fit takes at most FIT_POSITIVES positives and FIT_UNLABELLED other documents, those
with the smallest hashes of their ids outside the held-out fold; p is the share of the
label among the labelled rows outside that fold. Words outside the sample's vocabulary
(at least MIN_DOCS documents) weigh nothing, weights are not negative (a text can't make up for
an insult), and a penalty by the standard error of what chance gives a feature keeps all
but clear ones at zero; those that stay are then weighed anew. Defined results: without positives or
without unlabelled documents every score is p (0 without labels); null and blank texts
score by the bias alone; texts are read whole; repeated rows are scored each.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import cache, held_out, raw, trim
from graphloom.llm.quality import training_rows

FIT_POSITIVES, FIT_UNLABELLED = 3_000, 6_000
MIN_DOCS = 4
BITS = 18
STEPS, RATE = 200, 0.05
#: Penalty on weights: a constant, and standard errors of the pull that chance gives a feature.
LASSO, ERRORS = 4e-4, 3.0
#: Lengths of the first letters of a word that are features besides the word.
STEMS = (4, 5)
PUNCTUATION = b".,;:!?\"'()[]{}<>|*#$%&-_"


class Buckets(dict):
    """word (bytes) -> its buckets, remembered up to a bound."""

    LIMIT = 75_000

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        w = word.strip(PUNCTUATION).decode("utf-8", "replace").lower()
        keys = [w, *(w[:n] + "*" for n in STEMS if len(w) >= n)] if w else []
        b = self[word] = tuple(xxhash.xxh3_64_intdigest(k) & ((1 << BITS) - 1) for k in keys)
        return b


def _buckets() -> Buckets:
    return cache("word buckets", Buckets)


def words(text: bytes) -> np.ndarray:
    """Distinct buckets of the words of a text."""
    return np.unique(np.fromiter(chain.from_iterable(map(_buckets().__getitem__, set(text.lower().split()))), np.int64))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def word_buckets(texts: pa.Array) -> pa.Array:
    return pa.array([words(t.as_py()).astype(np.int32) for t in texts], pa.list_(pa.int32()))


@dataclass
class Linear:
    """weights by bucket, and the bias."""

    weights: np.ndarray | None
    bias: float

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(rows), self.bias)
        z = np.array([self.weights[r].sum() for r in rows]) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _csr(rows: list[np.ndarray], column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, columns) of the kept buckets."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = column[np.concatenate(rows)] if len(rows) else np.empty(0, np.int64)
    at = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)
    return at[flat >= 0], flat[flat >= 0]


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Linear:
    """Non-negative risk minimisation by full-batch Adam."""
    if not positive or not unlabelled or not 0 < prior < 1:
        return Linear(None, prior)
    seen = np.bincount(np.concatenate([*positive, *unlabelled]), minlength=1 << BITS)
    kept = np.flatnonzero(seen >= MIN_DOCS)
    column = np.full(1 << BITS, -1, np.int32)
    column[kept] = np.arange(len(kept))
    m = len(kept)
    pairs = _csr(positive, column), _csr(unlabelled, column)
    n_p, n_u = len(positive), len(unlabelled)
    null = np.bincount(pairs[1][1], minlength=m) / n_u + 1 / n_p
    penalty = LASSO + ERRORS * prior * np.sqrt(null * np.maximum(1 - null, 0) / n_p)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def descend(theta, free, penalty):
        (pr, pc), (ur, uc) = ((r[free[c]], c[free[c]]) for r, c in pairs)

        def back(g, rows, cols):
            return np.append(np.bincount(cols, g[rows], m), g.sum())

        m1, m2 = np.zeros(m + 1), np.zeros(m + 1)
        for step in range(1, STEPS + 1):
            zp = np.bincount(pr, theta[pc], n_p) + theta[m]
            zu = np.bincount(ur, theta[uc], n_u) + theta[m]
            sp, su = sigmoid(zp), sigmoid(zu)
            # logistic losses: -log(s) for the positive label, -log(1-s) for the negative one
            corrected = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            hidden = back(su / n_u, ur, uc) - prior * back(sp / n_p, pr, pc)
            grad = prior * back((sp - 1) / n_p, pr, pc) + hidden if corrected >= 0 else -hidden
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
            scale = RATE / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-4)
            theta = theta - scale * m1 / (1 - 0.9**step)
            theta[:m] = np.where(free, np.maximum(theta[:m] - scale[:m] * penalty, 0), 0)
        return theta

    theta = np.zeros(m + 1)
    theta[m] = np.log(prior / (1 - prior))
    theta = descend(theta, np.ones(m, bool), penalty)
    theta = descend(theta, theta[:m] > 0, LASSO / 4)  # the features that stay are weighed anew, almost freely
    weights = np.zeros(1 << BITS, np.float32)
    weights[kept] = theta[:m]
    return Linear(weights, float(theta[m]))


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    positives: int = FIT_POSITIVES, unlabelled: int = FIT_UNLABELLED,
) -> Linear:
    """Fit on bounded samples; the driver holds their word buckets only."""
    marked = labels.filter(~held_out(key) & F.col(label).isin(0, 1))
    prior = marked.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    p = training_rows(labels.filter(F.col(label) == 1), key, label, positives).select("__key", F.lit(1).alias("__y"))
    others = docs.select(F.col(key).alias("__key")).filter(~held_out("__key") & F.col("__key").isNotNull())
    u = others.distinct().orderBy(F.xxhash64("__key"), "__key").limit(unlabelled).select("__key", F.lit(0).alias("__y"))
    chosen = F.broadcast(p.unionByName(u))
    found = docs.select(F.col(key).alias("__key"), raw(text).alias("__text")).join(chosen, "__key")
    got = found.select("__key", "__y", word_buckets("__text").alias("b")).toArrow()
    y, k, rows = got.column("__y").to_numpy(), got.column("__key").to_numpy(), got.column("b").combine_chunks()
    values, ends = rows.flatten().to_numpy(), np.asarray(rows.offsets)
    every = [values[ends[i] - ends[0] : ends[i + 1] - ends[0]] for i in range(len(y))]
    order = np.lexsort((k, y))
    return fit([every[i] for i in order if y[i] == 1], [every[i] for i in order if y[i] == 0], prior)


def score(model: Linear, text: Column | str = "text") -> Column:
    """Probability that a text is toxic. The weights go to the executors in the function: 2**BITS floats."""

    @F.arrow_udf("double")
    def toxicity_score(texts: pa.Array) -> pa.Array:
        trim()
        return pa.array(model.score([words(t.as_py()) for t in texts]))

    return toxicity_score(raw(text))
