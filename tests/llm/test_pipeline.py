"""The pipeline's stages, one after another, against plain-Python versions of what each must do."""

import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as C  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from graphloom.llm import common  # noqa: E402
from graphloom.llm.queries import tokenizer_path  # noqa: E402


def corpus():
    rng = random.Random(11)
    words = [f"word{i}" for i in range(3000)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels = [], []
    for i in range(700):
        text = "\n".join(line(rng.randint(22, 40)) + "." for _ in range(3))
        toxic, poor = i % 5 == 1, i % 7 == 2
        if toxic:
            t = text.split(" ")
            for _ in range(4):
                t.insert(rng.randrange(len(t)), rng.choice(["vile", "rotten", "vilest"]))
            text = " ".join(t)
        if poor:
            text = " ".join(w + "$$%%" for w in text.split())
        rows.append([i, text, "en", "s", len(text)])
        labels.append((i, int(not poor), int(toxic)))
    clean = [i for i in range(700) if i % 5 != 1 and i % 7 != 2]
    passage = line(60)
    for k, i in enumerate(clean[10:14]):
        rows[i][1] += "\n" + passage
    copy = rows[clean[20]][1].split(" ")
    copy[5] = "changed"
    rows.append([900, rows[clean[20]][1], "en", "s", 0])
    rows.append([901, " ".join(copy), "en", "s", 0])
    rows += [[902, None, None, None, None], [903, "", "en", "s", 0], [None, rows[clean[30]][1], "en", "s", 0]]
    return rows, labels, clean, passage


def shingles(text, n=5):
    w = text.encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def test_stages(spark, tmp_path):
    rows, labels, clean, passage = corpus()
    docs = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    steps = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, steps[-1], str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        steps.append(spark.read.parquet(f"{tmp_path}/out{k}"))
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in steps]
    for s in steps[1:5]:
        assert s.dtypes == steps[0].dtypes
    numbered = set(range(700))
    assert {i for i in numbered if i % 5 != 1} == ids[1] & numbered  # toxic documents went, clean ones stayed
    assert set(clean) == ids[2] & numbered  # and poor ones
    # near copies: the smallest id of each component stays
    before = {r["doc_id"]: shingles(r["text"]) for r in steps[2].collect() if r["doc_id"] is not None and r["text"]}
    keys, parent = sorted(before), {k: k for k in before}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if before[a] & before[b]]
    for a, b in near:
        both = len(before[a] & before[b])
        if 100 * both >= 80 * (len(before[a]) + len(before[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert {find(k) for k in keys} == {i for i in ids[3] if i in before}
    assert 900 not in ids[3] and 901 not in ids[3] and None in ids[3]
    # the passage stays in the first document only, and nothing else is lost there
    texts = {r["doc_id"]: r["text"] for r in steps[4].collect()}
    old = {r["doc_id"]: r["text"] for r in steps[3].collect()}
    holders = clean[10:14]
    assert [passage in texts[i] for i in holders] == [True, False, False, False]
    assert all(texts[i] == old[i] for i in texts if i not in holders and i is not None)
    assert all(texts[i] + "\n" + passage == old[i] or i == holders[0] for i in holders)
    # packing: every id of every document once
    t = Tokenizer.from_file(tokenizer_path())
    want = {}
    for i, text in ((r["doc_id"], r["text"]) for r in steps[4].collect()):
        want[i] = want.get(i, 0) + len(t.encode(text or "", add_special_tokens=False).ids) + 1
    got = {}
    for r in steps[5].collect():
        assert np.frombuffer(bytes(r["ids"]), "<u4").size == r["length"]
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_rows_that_share_an_id_are_told_apart(spark, tmp_path):
    rng = random.Random(4)
    line = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    a, b, c, passage = line(80), line(90), line(70), line(60)
    near = a.split()
    near[40] = "changed"
    rows = [(5, a), (5, b), (5, b), (6, " ".join(near)), (7, c), (None, c), (None, None), (8, ""), (8, ""), (9, None), (2, passage), (11, line(30) + "\n" + passage), (11, line(33))]
    docs = spark.createDataFrame([(*r, "en", "s", 1, 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, component int")
    left = C.drop_near_copies(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str)
    assert got == sorted([r for k, r in enumerate(rows) if k not in (2, 3, 8)], key=str)
    cut = C.cut_repeats(spark, left, str(tmp_path))
    assert cut.columns == docs.columns
    texts = sorted(((r["doc_id"], r["text"]) for r in cut.collect()), key=str)
    want = [r for k, r in enumerate(rows) if k not in (2, 3, 5, 8, 11)] + [(11, rows[11][1].split("\n")[0])]  # the row without an id is a copy of 7
    assert texts == sorted(want, key=str)


def test_tasks_give_free_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(common, "trim", lambda: given.append(1))
    task = common.trimmed(lambda batches: (b + 1 for b in batches))
    assert list(task(iter([1, 2]))) == [2, 3] and given == [1]  # at the end, else what a stage needed counts in the next ones
    whole = task(iter([1, 2]))
    next(whole)
    whole.close()
    assert given == [1, 1]
