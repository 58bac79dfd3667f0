"""Periodic runs against their definition."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from graphloom.llm import periodic, queries


def brute(words, least=6, times=4):
    """Runs by the definition: maximal stretches of agreement at each lag, with the smallest period."""
    n, best = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in best.items())


def sequences():
    rng = random.Random(5)
    yield from ([], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 700, ["a", "b"] * 4, ["a", "b"] * 300 + ["a"], ["x"] + ["a", "a", "b"] * 90 + ["y"])
    for size in (20, 90, 300, 900):
        for letters in (1, 2, 3, 8, 200):
            for _ in range(6):
                words = [str(rng.randrange(letters)) for _ in range(size)]
                for _ in range(rng.randrange(4)):  # plant periods, some inside others
                    at, p = rng.randrange(size), rng.choice([1, 2, 3, 7, 20, 45, 100])
                    for i in range(at + p, min(size, at + p * rng.randrange(3, 9) + rng.randrange(p))):
                        words[i] = words[i - p]
                yield words
    a, b = ["0"], ["0", "1"]
    for _ in range(11):  # Fibonacci words hold many runs
        a, b = b, b + a
    yield b
    yield (["0", "0", "1"] * 8 + ["2"]) * 9


@pytest.mark.parametrize("leaf", [8, 128])
def test_runs_equal_the_definition(monkeypatch, leaf):
    monkeypatch.setattr(periodic, "LEAF", leaf)
    for words in sequences():
        names = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = np.array([names[w] for w in words], np.int64)
        back = periodic.last_seen(ids, np.array([], np.int64))
        assert periodic.find_runs(ids, back) == brute(words)
        assert periodic.find_runs(ids, back, least=5, times=2) == brute(words, 5, 2)


def test_z_function():
    rng = random.Random(3)
    for _ in range(300):
        s = np.array([rng.randrange(rng.choice([1, 2, 5])) for _ in range(rng.randrange(80))], np.int64)
        want = [next((k for k in range(len(s) - i) if s[i + k] != s[k]), len(s) - i) for i in range(len(s))]
        assert periodic.z_function(s).tolist() == want


def test_words_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(periodic, "hash_words", lambda data, starts, stops: np.zeros(len(starts), np.uint64))
    data = np.frombuffer(b"longer-than-eight longer-than-nine a a longer-than-eight", np.uint8)
    starts, stops, _ = periodic.split_words(data, np.array([0, len(data)]))
    assert periodic.intern(data, starts, stops).tolist() == [0, 1, 2, 2, 0]


def texts():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["é", " ", "x" * 90]
    for i in range(120):
        size = rng.choice([0, 1, 5, 6, 30, 200, 900])
        t = [rng.choice(words) for _ in range(size)]
        if i % 3 == 0 and t:
            p = rng.choice([1, 2, 9, 40])
            at = rng.randrange(size)
            t[at : at + p] *= rng.randrange(1, 8)
        yield "".join(w + rng.choice([" ", "\n", "\t\x0b", "\r\n"]) for w in t)
    yield from ("", None, " \n ", "a " * 6, "A a A a A a A a", "z " * 30_000)


def test_query_equals_the_definition(spark, tmp_path):
    """The whole contract, on rows with planted periods, null and repeated ids, and columns of the outputs' names."""
    rows = [(i, t, 1, "x") for i, t in enumerate(texts())] + [(None, "b " * 9, 1, "x"), (3, "c d " * 9, 1, "x"), (3, "c d " * 9, 1, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()]
    want = []
    for doc, text, *_ in rows:
        words = [w for w in (text or "").encode().split()]
        n = len(words)
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        found = brute(words) if n < 20_000 else [(0, n, 1)]
        gone = {i for s, size, q in found for i in range(s + q, s + size)}
        top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        want.append((
            doc, len(found), *top, 1000 * top[1] // top[2] if found else None,
            hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
        ))
    key = lambda r: str(r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[1] > 0 for r in got) > 20


def test_empty_table(spark):
    assert periodic.runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
