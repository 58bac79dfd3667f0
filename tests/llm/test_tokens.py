"""BPE, token files and packing against the tokenizers library and exact round trips."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from graphloom.llm import bpe, packing, tokenfile  # noqa: E402
from graphloom.llm.common import new_path  # noqa: E402
from graphloom.llm.queries import INDEX_END, PACK_END, tokenizer_path  # noqa: E402

ODD = [
    None, "", " \n\t ", "a", "It's we'll I'd", "<|endoftext|> x<|startoftext|>", "Σας ΣΣ ς", "İstanbul ß ﬁ", "é é", "漢字 한글 한",
    "x" * 3000, "ab " * 4000, "\x1c\x85  z", "12 ½ ² 😀!!", "\x00",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def expected(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encode_and_decode_equal_the_library(spark, library):
    rng = random.Random(5)
    letters = ["th", "e", "A", "é", "'s", " ", "\n", "!", "1", "Σ", "́", "<|endoftext|>"]
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = tokenizer_path()
    out = docs.select("doc_id", bpe.encode("text", path).alias("a"), bpe.library_encode("text", path).alias("b"), bpe.round_trip("text", path).alias("t"))
    for r in out.withColumn("back", bpe.decode("a", path)).collect():
        ids = expected(library, texts[r["doc_id"]])
        data = np.array(ids, "<u4").tobytes()
        assert r["a"] == data and r["b"] == data and r["t"]["ids"] == data
        assert r["back"] == library.decode(ids, skip_special_tokens=False) == r["t"]["decoded"]


def test_every_plane_and_all_short_letters(spark, library):
    rng = random.Random(6)
    planes = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 7 == 0)]
    some = lambda: "".join(rng.choice(planes) if rng.random() < 0.5 else rng.choice("aZ 9.\n'<é") for _ in range(rng.randint(1, 9)))
    texts = [f"a{chr(c)}B {chr(c)}" for c in range(0x250)] + [some() for _ in range(6000)] + ["\U00012477 x\U00018ed1 \U00019164y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = tokenizer_path()
    for r in docs.select("doc_id", bpe.encode("text", path).alias("a"), bpe.library_encode("text", path).alias("b")).collect():
        data = np.array(expected(library, texts[r["doc_id"]]), "<u4").tobytes()
        assert r["a"] == data and r["b"] == data, texts[r["doc_id"]]


def test_the_table_of_units_grows_and_forgets(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    units = bpe.Units(bpe.vocabulary(tokenizer_path()), lambda us: [library.encode(u, add_special_tokens=False).ids for u in us])
    rng = random.Random(3)
    for _ in range(30):
        texts = [" ".join(rng.choice("ab") * rng.randint(1, 60) for _ in range(rng.randint(0, 40))) for _ in range(9)]
        got = units.ids(pa.array([t.encode() for t in texts], pa.binary()).slice(2))
        assert [np.frombuffer(x.as_py(), "<u4").tolist() for x in got] == [expected(library, t) for t in texts[2:]]


def test_long_words_merge_alike():
    v = bpe.vocabulary(tokenizer_path())
    rng = random.Random(1)
    for n in (1, 2, 300):
        word = "".join(rng.choice("theaionr") for _ in range(n)).encode()
        parts = [v.inner[b] for b in word]
        parts[-1] = v.last[word[-1]]
        assert v._long(parts) == v.word(word)


def ids_frame(spark, rows, end):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.select("doc_id", F.concat(bpe.library_encode("text", tokenizer_path()), F.lit(end)).alias("ids"))


def test_token_file_round_trip_and_lookup(spark, library):
    rows = [(i * 7 % 101, f"text number {i} " * (i % 9)) for i in range(101)] + [(5, "again"), (None, "no key"), (7, None)]
    ids = ids_frame(spark, rows, INDEX_END)
    path = new_path(spark, "test-file")
    tokenfile.write(ids, path, "doc_id", "ids", [20, 50, 90], 49_408)
    got = tokenfile.read(spark, path).collect()
    data = sorted(((k is not None, k or 0, np.array(expected(library, t) + [2], "<u4").tobytes()) for k, t in rows))
    start, want = 0, []
    for known, k, b in data:
        want.append((k if known else None, start, b))
        start += len(b) // 4
    assert sorted(map(tuple, got), key=lambda r: r[1]) == [(k, s, bytearray(b)) for k, s, b in want] or sorted(
        ((r["key"], r["start"], bytes(r["ids"])) for r in got), key=lambda r: r[1]
    ) == want
    keys = spark.createDataFrame([(5,), (77,), (1000,), (-3,), (None,)], "k long")
    found = sorted((r["key"], r["start"], bytes(r["ids"])) for r in tokenfile.lookup(keys, path).collect())
    assert found == sorted(w for w in want if w[0] in (5, 77))


def test_empty_token_file(spark):
    ids = ids_frame(spark, [], INDEX_END)
    path = new_path(spark, "test-empty")
    tokenfile.write(ids, path, "doc_id", "ids", [], 49_408)
    assert tokenfile.read(spark, path).count() == 0
    assert tokenfile.bounds(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", 100) == []


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000])
def test_minimal_perfect_hash(n):
    keys = np.array(random.Random(n).sample(range(-(10**12), 10**12), n))
    displace, slot = tokenfile.build_mph(keys)
    assert sorted(slot) == list(range(n))
    assert (tokenfile.mph_slots(displace, n, keys) == slot).all()


def test_differencing_is_near_equal():
    rng = random.Random(3)
    sizes = [rng.randint(1, 1000) for _ in range(500)]
    window = packing.differencing(sizes, 16)
    sums = np.bincount(window, sizes, 16)
    assert sums.sum() == sum(sizes) and sums.max() - sums.min() <= 20


@pytest.mark.parametrize("lengths", [[], [1], [2048], [2049], [5000, 1, 1, 700], [1500] * 400, list(range(1, 900)), [100_000]])
def test_plan_places_each_id_once(lengths):
    seen = [np.zeros(n, int) for n in lengths]
    for window in packing.plan(enumerate(lengths), 2048):
        total = sum(p[2] for p in window)
        assert 0 < total <= 2048
        for d, s, n in window:
            assert n > 0
            seen[d][s : s + n] += 1
    assert all((s == 1).all() for s in seen)


def test_packing_returns_all_ids(spark, library):
    rows = [(i, ODD[i % len(ODD)]) for i in range(60)] + [(3, "again"), (None, "no key")]
    out = packing.pack(ids_frame(spark, rows, PACK_END), "doc_id", "ids").collect()
    by, sums = {}, {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(bytes(r["ids"]))
        sums.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"]
    want = {}
    for k, t in rows:
        want.setdefault(k, []).append(np.array(expected(library, t) + [1], "<u4").tobytes())
    assert {k: sum(map(len, v)) for k, v in by.items()} == {k: sum(map(len, v)) for k, v in want.items()}
    for spans in sums.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2048
    one = [r for r in out if r["doc_id"] == 11]
    joined = b"".join(bytes(r["ids"]) for r in sorted(one, key=lambda r: r["start"]))
    assert zlib.crc32(joined) == zlib.crc32(want[11][0]) and {r["doc_tokens"] for r in one} == {len(want[11][0]) // 4}


def test_the_least_key_and_null_keys_are_told_apart(spark):
    rows = [(None, "one"), (-(1 << 63), "two words"), (-(1 << 63), "three"), (None, "four"), (7, "five")]
    path = new_path(spark, "least")
    tokenfile.write(ids_frame(spark, rows, INDEX_END), path, "doc_id", "ids", [], 49408)
    got = sorted(((r["key"], len(r["ids"])) for r in tokenfile.read(spark, path).collect()), key=str)
    plain = {(i, t): len(ids) for i, t, ids in ((r["doc_id"], r["text"], r["ids"]) for r in spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", bpe.library_encode("text", tokenizer_path(), INDEX_END)).collect())}
    assert got == sorted(((i, plain[i, t]) for i, t in rows), key=str)
