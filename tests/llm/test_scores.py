"""Quality, toxicity and rules: brute force, held-out accuracy, odd inputs."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import quality, rules, toxicity
from graphloom.llm.common import held_out

ODD = [None, "", " \n\n ", "a", "é b", "x " * 30000, "#*$%&|<>", "a\na\nb\na\n\n \n", "one two three four five one two three four five"]


def brute_rules(text):
    space = " \t\n\r\x0b\x0c"
    words, cur = [], ""
    for c in text or "":
        if c in space:
            words += [cur] if cur else []
            cur = ""
        else:
            cur += c
    words += [cur] if cur else []
    lines = [x for x in (text or "").split("\n") if x.strip(space)]
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = {}
    for r in runs:
        count[r] = count.get(r, 0) + 1
    covered = {i + k for i, r in enumerate(runs) if count[r] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_rules_equal_brute_force(spark):
    rng = random.Random(6)
    texts = ODD + ["".join(rng.choice(["ab ", "cd ", "é\n", "# ", "ef", "\x0b", "\n"]) for _ in range(rng.randint(0, 80))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, failed_bits string")
    table = rules.ledger(docs)
    got = table.withColumn("base", ~rules.passes("base")).collect()
    for r in got:
        n, chars, symbols, dup, repeat = want = brute_rules(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base"] == (n < 10 or 100 * repeat > 20 * n)
    bits = [r["failed_bits"] for r in got]
    m = rules.mask("v1")
    for r in rules.ablation(table, "v1").collect():
        b = rules.BIT[r["rule"]]
        assert r["failed"] == sum(x & b > 0 for x in bits)
        assert r["failed_alone"] == sum(x & m == b for x in bits)
        assert r["kept_without"] == sum(x & m & ~b == 0 for x in bits)


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        bad, toxic = rng.random() < 0.3, rng.random() < 0.2
        if toxic:
            for _ in range(4):
                t[rng.randrange(len(t))] = rng.choice(["vile", "vilest", "rotten"])
        if bad:
            t = [w + "$$%" for w in t]
        rows.append((i, " ".join(t), int(not bad), int(toxic)))
    return rows


def test_held_out_fold_is_crc32(spark):
    got = spark.range(50).select("id", held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


@pytest.mark.parametrize("module,label,column", [(quality, 2, "quality"), (toxicity, 3, "toxic")])
def test_classifiers_on_held_out_rows(spark, module, label, column):
    rows = corpus(1500, 1)
    docs = spark.createDataFrame([(r[0], r[1], 9) for r in rows] + [(-1, None, 9), (-2, "", 9), (0, rows[0][1], 9)], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(r[0], r[label]) for r in rows] + [(None, 1), (3, None)], f"doc_id long, {column} int")
    model = module.train(docs, labels)
    again = module.train(docs.repartition(7), labels.repartition(5))
    out = docs.select("doc_id", held_out("doc_id").alias("h"), module.score(model).alias("s"), module.score(again).alias("z")).collect()
    assert all(0 <= r["s"] <= 1 and r["s"] == pytest.approx(r["z"]) for r in out)
    truth = {r[0]: r[label] for r in rows}
    held = [r for r in out if r["h"] and r["doc_id"] in truth]
    right = np.mean([(r["s"] >= (0.3 if module is quality else 0.5)) == truth[r["doc_id"]] for r in held])
    assert len(held) > 200 and right > 0.95


@pytest.mark.parametrize("module,column", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_without_labels(spark, module, column):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], f"doc_id long, {column} int")
    one = spark.createDataFrame([(1, 1)], f"doc_id long, {column} int")
    for labels in (none, one):
        assert all(0 <= r[0] <= 1 for r in docs.select(module.score(module.train(docs, labels))).collect())
    empty = docs.filter(F.lit(False))
    assert empty.select(module.score(module.train(empty, none))).count() == 0
