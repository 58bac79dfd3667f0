"""Edges for outside models: text readers, taggers, triple extractors, embedders and writers.

Each is a Python object with one method over a list of texts; the defaults are
deterministic, so the rest of the engine runs and is tested without a network. Providers
are tried in order, and the first answer that isn't empty wins.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Provider(Protocol):
    name: str

    def answer(self, texts: list[str]) -> list[str]: ...


class Echo:
    """Reads nothing but its input: the stub of text recognition and sanitising."""

    name = "echo"

    def answer(self, texts: list[str]) -> list[str]:
        return texts


class Silent:
    """Never answers."""

    name = "silent"

    def answer(self, texts: list[str]) -> list[str]:
        return [""] * len(texts)


def ask(text: Column, providers: Sequence[Provider]) -> Column:
    """Struct of answer and method: of the first provider with an answer; null answers where none has one."""

    def run(x: pa.Array) -> pa.Array:
        texts = [v.as_py() or "" for v in x]
        answers, methods = [None] * len(texts), [None] * len(texts)
        for p in providers:
            left = [i for i, a in enumerate(answers) if a is None]
            if not left:
                break
            for i, a in zip(left, p.answer([texts[i] for i in left])):
                if a and a.strip():
                    answers[i], methods[i] = a, p.name
        return pa.StructArray.from_arrays([pa.array(answers, pa.string()), pa.array(methods, pa.string())], names=["answer", "method"])

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.StructType([T.StructField("answer", T.StringType()), T.StructField("method", T.StringType())]))(text)


SENTENCE = re.compile(r"\b([A-Z][\w#-]*(?: [A-Z][\w#-]*)*) (is|has|uses|was|and|of) ([\w#-]+(?: [\w#-]+)?)")


def extract_triples(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, subject, predicate, object: 'A is B' sentences by a regular expression, the stand-in for a model."""
    found = F.regexp_extract_all(F.col(text), F.lit(SENTENCE.pattern), F.lit(0))
    one = lambda g: F.regexp_extract("s", SENTENCE.pattern, g)
    return docs.select(F.col(key), F.explode(found).alias("s")).select(key, one(1).alias("subject"), one(2).alias("predicate"), one(3).alias("object"))


def hash_embedding(text: str, size: int = 64) -> list[float]:
    """Unit vector of hashed words: the stand-in for an embedding model."""
    v = np.zeros(size)
    for w in text.lower().split():
        h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
        v[h % size] += 1 if h >> 31 else -1
    n = np.sqrt((v * v).sum())
    return (v / n if n else v).tolist()


def embed(text: Column, size: int = 64) -> Column:
    def run(x: pa.Array) -> pa.Array:
        return pa.array([hash_embedding(v.as_py() or "", size) for v in x], pa.list_(pa.float32()))

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.ArrayType(T.FloatType()))(text)
