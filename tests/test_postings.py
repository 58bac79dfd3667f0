"""The text index against plain counting."""

import math
import random
import re

from graphloom.operators import postings as I
from graphloom.plans import textindex

TEXTS = ["the Pump and the motor", "", None, "motor the", "THE the the", "der Über-Pump 7, the pump", "and the and", "pump the motor and the", " ... "]


def plain(texts, asked, every=False, phrases=()):
    docs = {i: re.findall(r"[^\W_]+", t.lower()) for i, t in enumerate(texts) if t}
    docs = {i: w for i, w in docs.items() if w}
    n, average = len(docs), sum(map(len, docs.values())) / len(docs)
    wanted = sorted({*asked, *(t for p in phrases for t in p)})
    df = {t: sum(t in w for w in docs.values()) for t in wanted}
    out = {}
    for i, w in docs.items():
        has = [t for t in wanted if t in w]
        if not has or every and not set(asked) <= set(w) or not all(any(w[k : k + len(p)] == list(p) for k in range(len(w))) for p in phrases):
            continue
        score = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / average)) for t in has)
        out[i] = (round(score, 9), len(set(asked) & set(w)))
    return out


def test_scores_words_and_phrases(spark):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice(["the", "pump", "motor", "and", "x1", "ü"]) for _ in range(rng.randrange(1, 30))) for _ in range(80)]
    index = I.write_index(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), ["id"])
    for asked, every, phrases in (
        (["the"], False, ()), (["pump", "motor"], False, ()), (["pump", "motor", "über"], True, ()), (["x1", "nowhere"], True, ()), (["nowhere"], False, ()),
        (["the"], False, [("the", "motor")]), (["and"], False, [("the", "pump", "the"), ("and", "the")]), (["the", "the"], True, [("the", "the")]),
    ):
        got = {r["id"]: (round(r["score"], 9), r["matched"]) for r in I.search(index, asked, every, phrases).collect()}
        assert got == plain(texts, asked, every, phrases)


def test_a_search_reads_the_rows_of_its_terms(spark, sf):
    plan = textindex.document_index(spark, sf).of(["the", "pump"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan and "PushedFilters: [In(term, [pump,the])]" in plan.replace("IsNotNull(term), ", "")


def test_empty_index(spark):
    index = I.write_index(spark.createDataFrame([(1, None)], "id long, text string"), ["id"])
    assert I.search(index, ["a"]).count() == 0 and I.search(index, ["a"], True, [("a", "b")]).count() == 0
