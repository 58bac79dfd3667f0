"""Names in texts against a search for each name."""

import random

import pytest

from graphloom.operators import gazetteer as G
from graphloom.operators.plugins import ask
from graphloom.plans import entities, registry


def fixture():
    rng = random.Random(9)
    words = ["New", "York", "New York", "York City", "a", "Ä", "x_1", "#7", "co.", "é", "Pump"]
    names = sorted({(rng.choice(["ORG", "GPE"]), " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))) for _ in range(60)})
    texts = [rng.choice(["", " ", "x"]).join(rng.choice(words + ["_", ",", " "]) + rng.choice([" ", " ", ""]) for _ in range(rng.randrange(40))) for _ in range(150)]
    return names, texts + [None, "", "New York", "New York City", "NewYork New York"]


@pytest.mark.parametrize("at_once", [1000, 7])
def test_names_equal_a_search_for_each(spark, at_once):
    names, texts = fixture()
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, "Pump New York")], "id long, t string")
    table = spark.createDataFrame(names + names[:5] + [("ORG", ""), ("ORG", None)], "label string, name string")
    got = sorted((r["id"], [tuple(x) for x in r["found"]]) for r in G.tag(docs, table, "id", "t", at_once).collect())
    assert got == sorted([(i, G.brute(names, t)) for i, t in enumerate(texts)] + [(0, G.brute(names, "Pump New York"))])
    assert sum(len(f) for _, f in got) > 100


def test_no_names(spark):
    docs = spark.createDataFrame([(1, "text")], "id long, t string")
    assert G.tag(docs, spark.createDataFrame([], "label string, name string"), "id", "t").collect()[0]["found"] == []


def test_query_finds_names(spark, sf):
    got = registry.queries()["doc_entities_ner"](spark, sf).collect()
    assert sum(r["orgs"] != "" for r in got) > 50 and sum(r["places"] != "" for r in got) > 50


def test_the_tagger_is_a_provider(spark, sf):
    names = [(r["label"], r["name"]) for r in entities.business_names(spark, sf).collect()]
    rows = entities.letters(spark, sf).filter("doc_id < 20").select("doc_id", "text").withColumn("a", ask("text", [G.NameTagger(names)])["answer"]).collect()
    assert all((r["a"] or "").split("\n")[0] == "\t".join(G.brute(names, r["text"])[0][:2] if G.brute(names, r["text"]) else ()) for r in rows)


def test_names_that_begin_alike_are_not_one_task(spark):
    """Of 300 names with one beginning, each text brings what it names to the join, not itself to all names' task."""
    names = [("PERSON", f"Customer#{i:09d}") for i in range(300)]
    docs = spark.createDataFrame([(i, f"To Customer#{i:09d}, about Customer#{i + 500:09d}.") for i in range(300)], "id long, t string")
    found = G.tag(docs, spark.createDataFrame(names, "label string, name string"), "id", "t", 10)
    assert sorted((r["id"], [x["name"] for x in r["found"]]) for r in found.collect()) == [(i, [names[i][1]]) for i in range(300)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "hashpartitioning(name" in plan or "BroadcastHashJoin" in plan
