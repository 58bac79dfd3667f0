"""Quality classifier: regularised quadratic discriminant over document statistics.

Each document is a vector of transformed statistics of its whole text. Each class has a
mean and a covariance shrunk towards the pooled one and towards its diagonal; the
inverses of their Cholesky factors are computed once and kept in the model. The score is a
logistic curve (fitted on the same training rows) of the difference of the two log
densities: Mahalanobis distances, by one product with such an inverse, and log determinants.

The fit takes at most FIT_ROWS labelled rows, those with the smallest hashes of their
ids. Defined results: null labels are left out; a null, blank or very long text has a
vector like any other; with one class only, or no labels, every score is that class's
share (0.5 without labels); repeated rows are scored each.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import LOWER, TEXT_BYTES, by_bytes, bytes_of, hash_words, held_out, raw, shingle_hashes, split_words, trim
from graphloom.llm.rules import NOT_FIRST, SPACE, SYMBOLS, repeated_words

#: Bound on the labelled rows of a fit.
FIT_ROWS = 20_000
#: Shrinkage of each class covariance towards the pooled one, and then towards its diagonal.
TO_POOLED, TO_DIAGONAL = 0.3, 0.1

UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
STOPS = b".!?"
#: Common short words of the languages at hand (fixed values).
FUNCTION_WORDS = frozenset(
    b"the of and to in is that it for on with as be by this are from or an at was "
    b"de la le et les des un une du en que qui pour dans par sur au est "
    b"der die und den von das mit sich dem ein ist nicht auf als "
    b"el los las y se del una con su para es al".split()
)
MARK = np.zeros(256, bool)
MARK[list(b".,;:!?")] = True


@functools.lru_cache(1)
def _function_hashes() -> np.ndarray:
    words = sorted(FUNCTION_WORDS)
    ends = np.cumsum([0, *map(len, words)])
    return hash_words(np.frombuffer(b"".join(words), np.uint8), ends[:-1], ends[1:])


class Words:
    """Per word of some texts: hash, length, and whether it is all upper case, capitalised, followed by a mark, a function word."""

    def __init__(self, texts: pa.Array):
        data, bounds = bytes_of(texts)
        starts, stops, self.ends = split_words(data, bounds)
        self.hashes, self.lengths = hash_words(data, starts, stops), stops - starts
        first, last = data[starts], data[stops - 1]
        self.capital = (first >= 65) & (first <= 90)
        self.marked = MARK[last]
        self.function = np.isin(hash_words(LOWER.take(data), starts, stops), _function_hashes())
        letters = np.cumsum(np.concatenate([[0], np.where((data >= 97) & (data <= 122), 1 << 32, 0) + ((data >= 65) & (data <= 90))]))
        cased = letters[stops] - letters[starts]
        self.upper = (cased > 0) & (cased < 1 << 32)

    def of(self, text: int) -> slice:
        return slice(self.ends[text], self.ends[text + 1])


def statistics(text: bytes, all_words: Words, own: slice) -> list[float]:
    """Transformed statistics of a text, each of about unit scale; `own` are its words."""
    n = own.stop - own.start
    if not n:
        return [0.0] * N_STATISTICS
    size = len(text)
    letters = len(text.translate(None, SPACE + NOT_FIRST))
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    count = lambda chars: size - len(text.translate(None, chars))
    h, lengths = all_words.hashes[own], all_words.lengths[own]
    triples = shingle_hashes(h, 3)
    root = lambda x: float(np.sqrt(max(x, 0.0)))
    return [
        np.log1p(n) / 3,
        np.log(letters / n + 0.1),
        np.log1p(len(lines)) / 2,
        np.log1p(n / len(lines)) / 2,
        root((len(lines) - len(set(lines))) / len(lines)),
        root(repeated_words(h) / n),
        root(count(SYMBOLS) / n),
        root(text.count(b"!") / n),
        root(text.count(b"|") / n),
        root(count(UPPER) / letters),
        root(count(DIGITS) / letters),
        root(count(b".") / n),
        root(count(b",") / n),
        root(all_words.upper[own].sum() / n),
        root(len(np.unique(h)) / n),
        root(len(np.unique(triples)) / len(triples)),
        root(all_words.function[own].sum() / n),
        root(float((lengths <= 3).mean())),
        root(float((lengths > 12).mean())),
        float(np.log1p(lengths.std())),
        np.log1p(n / max(1, count(STOPS))) / 3,
        root(all_words.capital[own].sum() / n),
        root(all_words.marked[own].sum() / n),
    ]


N_STATISTICS = 23


def table_of(texts: pa.Array) -> np.ndarray:
    """The statistics of BINARY texts, a row each."""
    rows = []
    for part in by_bytes(texts, TEXT_BYTES):
        words = Words(part)
        rows += [statistics(t.as_py(), words, words.of(k)) for k, t in enumerate(part)]
    return np.array(rows, np.float32).reshape(len(texts), N_STATISTICS)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def document_statistics(texts: pa.Array) -> pa.Array:
    return pa.array(list(table_of(texts)), pa.list_(pa.float32()))


@dataclass
class Discriminant:
    """A fitted model: means, lower Cholesky factors and log terms of both classes, and the curve's slope and offset."""

    prior: float
    means: tuple = ()
    factors: tuple = ()
    logs: tuple = ()
    slope: float = 0.0
    offset: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, per dimension."""
        out = np.zeros(len(x))
        for sign, m, inverse, log in zip((-1, 1), self.means, self.factors, self.logs):
            z = (x - m) @ inverse.T
            out += sign * (log - 0.5 * np.einsum("ij,ij->i", z, z))
        return np.clip(out / x.shape[1], -30, 30)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-(self.slope * self.difference(x) + self.offset)))


def fit(x: np.ndarray, y: np.ndarray) -> Discriminant:
    """Fit from vectors and labels 0/1."""
    n1 = int(y.sum())
    prior = n1 / len(y) if len(y) else 0.5
    if min(n1, len(y) - n1) < 2:
        return Discriminant(prior)
    d = x.shape[1]
    parts = [x[y == c] for c in (0, 1)]
    own = [np.cov(p.T, bias=True) for p in parts]
    pooled = sum(len(p) * c for p, c in zip(parts, own)) / len(y)
    floor = 1e-4 + 0.01 * np.trace(pooled) / d
    means, inverses, logs = [], [], []
    for p, c in zip(parts, own):
        s = (1 - TO_POOLED) * c + TO_POOLED * pooled
        s = (1 - TO_DIAGONAL) * s + TO_DIAGONAL * np.diag(np.diag(s)) + floor * np.eye(d)
        low = np.linalg.cholesky(s)
        means.append(p.mean(0))
        inverses.append(np.linalg.solve(low, np.eye(d)))  # the factor's inverse: distances by one product
        logs.append(-np.log(np.diag(low)).sum())
    model = Discriminant(prior, tuple(means), tuple(inverses), tuple(logs))
    # the curve: logistic regression on the difference, by Newton's method with a little ridge
    a, b, z = 1.0, float(np.log(prior / (1 - prior))), model.difference(x)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - y) * z).sum() + 1e-3 * a, (p - y).sum()])
        hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(hess, g), -2, 2)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    model.slope, model.offset = max(a, 1e-3), b
    return model


def training_rows(labels: DataFrame, key: str, label: str, rows: int) -> DataFrame:
    """At most `rows` labelled rows outside the held-out fold, by the smallest hash of the key: key, label."""
    known = labels.filter(~held_out(key) & F.col(label).isin(0, 1) & F.col(key).isNotNull())
    one = known.groupBy(F.col(key).alias("__key")).agg(F.max(F.col(label)).alias("__label"))
    return one.orderBy(F.xxhash64("__key"), "__key").limit(rows)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> Discriminant:
    """Fit on at most `rows` labelled documents; the driver holds their vectors only."""
    chosen = F.broadcast(training_rows(labels, key, label, rows))
    found = docs.select(F.col(key).alias("__key"), raw(text).alias("__text")).join(chosen, "__key")
    got = found.select(document_statistics("__text").alias("x"), F.col("__label").cast("int").alias("y")).toArrow()
    if not got.num_rows:
        return Discriminant(0.5)
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1).astype(float)
    y = got.column("y").to_numpy()
    order = np.lexsort((*x.T, y))  # the sum's order, and so the model, doesn't follow the partitions
    return fit(x[order], y[order])


def score(model: Discriminant, text: Column | str = "text") -> Column:
    """Probability that a text has label 1."""

    @F.arrow_udf("double")
    def quality_score(texts: pa.Array) -> pa.Array:
        trim()
        x = table_of(texts).astype(float)
        return pa.array(model.score(x) if len(x) else np.empty(0))

    return quality_score(raw(text))
