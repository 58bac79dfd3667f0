"""Outside models asked in attempts: defined rows whatever fails."""

import time

from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import attempts as A
from graphloom.plans import models
from graphloom.sources.tables import table


def failing():
    class Failing:
        """Fails by the text: at the first attempts, by quota, by an error, or for good."""

        name = "failing"

        def answer_at(self, texts, attempt):
            if any(t.startswith("quota") for t in texts) and attempt == 1:
                raise A.Quota
            if any(t.startswith("error") for t in texts):
                raise ValueError
            return ["" if t.startswith("late") and attempt < 3 else t.upper() for t in texts]

    return Failing()


def test_what_fails_is_asked_again(spark):
    rows = [(1, "fine"), (2, "late one"), (3, "quota"), (4, "error"), (5, None), (6, "fine too")]
    df = spark.createDataFrame(rows, "id long, t string").repartition(6, "id")
    ask = lambda most: tuple({tuple(r) for r in x.collect()} for x in A.ask_again(df, ["id"], "t", failing(), A.text_in, most, at_once=1))
    good, bad = ask(3)
    assert good == {(1, 1, "FINE"), (6, 1, "FINE TOO"), (3, 2, "QUOTA"), (2, 3, "LATE ONE")}
    assert bad == {(2, 1, "empty"), (2, 2, "empty"), (3, 1, "quota"), *((4, k, "error: ValueError") for k in (1, 2, 3)), *((5, k, "empty") for k in (1, 2, 3))}
    good, bad = ask(1)
    assert {r[0] for r in good} == {1, 6} and {r[0] for r in bad} == {2, 3, 4, 5}


def test_replies_are_judged():
    assert A.triples_in("") == (None, "empty") and A.triples_in("no") == (None, "no json") and A.triples_in("[]") == (None, "no triples")
    reply = 'Sure: [{"subject": "a", "predicate": "has", "object": "b"}, {"subject": "", "predicate": "p", "object": "o"}, {"subject": "s", "predicate": "one two three four", "object": "o"}, 7]'
    assert A.triples_in(reply) == ('[{"subject": "a", "predicate": "has", "object": "b"}]', None)


def test_rate_limit(spark):
    df = spark.range(20).select("id", F.lit("x").alias("t")).coalesce(1)
    begun = time.monotonic()
    good, _ = A.ask_again(df, ["id"], "t", models.Rule("same", lambda t: t), A.text_in, per_second=20, at_once=5)
    assert good.count() == 20 and time.monotonic() - begun > 0.7


def test_cleaning_falls_back_chunk_by_chunk(spark, sf):
    docs = table(spark, sf, "documents")
    clean = {r["doc_id"]: r["c"] for r in docs.select("doc_id", X.clean_ocr(F.col("text")).alias("c")).collect()}

    def want(text):
        w = text.split()
        pieces = [" ".join(w[i : i + models.CLEAN_WORDS]) for i in range(0, len(w), models.CLEAN_WORDS)]
        done = [len(p) % 11 != 0 for p in pieces]
        method = "rules" if not any(done) else "model" if all(done) else "mixed"
        shown = ["Sorry, no." if ok and len(p) % 3 == 0 else p.capitalize() if ok else p for p, ok in zip(pieces, done)]
        return "\n".join(shown), method

    got = {r["doc_id"]: (r["text"], r["method"]) for r in models.txt_sanitize_llm(spark, sf).collect()}
    assert got == {k: want(t) for k, t in clean.items()} and {m for _, m in got.values()} >= {"model", "mixed"}
