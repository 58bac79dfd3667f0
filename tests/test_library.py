"""Library functions on small literal inputs, against results worked out by hand."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import chunkers as C
from graphloom.functions import questions as Q
from graphloom.functions import text as X
from graphloom.operators import operations as O
from graphloom.operators import plugins as G
from graphloom.operators import triples as K
from graphloom.operators import vectors as V
from graphloom.sources import files as S

TRIPLE = "subject string, subject_type string, predicate string, object string, object_type string, ord long, inferred boolean"


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def triples(spark, rows):
    return spark.createDataFrame([(s, st_, p, o, ot, i, inf) for i, (s, st_, p, o, ot, inf) in enumerate(rows)], TRIPLE)


def test_quality_of_blank_and_short_texts(spark):
    df = spark.createDataFrame([("",), ("one",), ("Hello there. A world of words, is it?",)], "v string")
    q = [r[0] for r in df.select(X.quality(F.col("v"), F.lit(0.7))).collect()]
    assert q[0]["quality_score"] == 0 and q[0]["issues"] == ["empty_text"] and q[0]["complexity"] == "unknown"
    assert q[1]["issues"] == ["insufficient_text", "few_sentences"] and q[1]["word_count"] == 1
    assert q[2]["sentence_count"] == 2 and "special_characters" not in q[2]["issues"]
    assert q[1]["quality_score"] == pytest.approx((0.7 + 0.01 + 3 / 5 + 0.7) / 4)


def test_classes_and_ties(spark):
    df = spark.createDataFrame([("nothing", "x"), ("an invoice", "x"), ("report and law", "scan"), ("plain", "my_invoice_7")], "t string, f string")
    got = [r[0]["document_type"] for r in df.select(X.classify(F.col("t"), F.col("f"))).collect()]
    assert got == ["unknown", "invoice", "report", "invoice"]


@pytest.mark.parametrize("n,size,want", [(0, 3, []), (3, 3, [3]), (4, 3, [3, 1]), (7, 3, [3, 3, 1])])
def test_word_windows(spark, n, size, want):
    got = column(spark, [" ".join(map(str, range(n)))], lambda c: X.chunks(c, size))[0]
    assert [c["word_count"] for c in got] == want and " ".join(c["chunk_text"] for c in got) == " ".join(map(str, range(n)))


def test_predicates_and_names(spark):
    assert column(spark, ["is", "is part of", "a b of c", "one two three four", "a b"], X.limit_predicate) == ["is", "is part of", "a b", "one two three", "a b"]
    assert column(spark, ["made by!", "9 lives", "__x--y__"], X.sanitize_predicate) == ["MADE_BY", "_9_LIVES", "X_Y"]
    assert column(spark, ["Work Order", "9x", "é"], X.sanitize_label) == ["WorkOrder", None, None]
    assert column(spark, ["The Acme Corp", "ACME, Ltd.", "Café-7 #2"], X.normalize_name) == ["acme", "acme", "café-7 #2"]


def test_entities_keep_their_digits(spark):
    got = column(spark, ["A-10 and B-12A near Bakken Shale"], X.entities)[0]
    assert got["wells"] == ["A-10", "B-12A"] and got["formations"] == ["Bakken Shale"]


def test_ocr_repairs(spark):
    assert column(spark, ["the fank 0f oil  is l 5, O5 and 1O2"], X.clean_ocr) == ["the tank of oil is 1 5, 05 and 102"]
    assert column(spark, ["camelCase"], X.clean_ocr) == ["camel Case"]
    assert column(spark, ["hello"], lambda c: X.clean_ocr(c, True)) == ["h el lo"]


def test_masks_titles_snippets(spark):
    assert column(spark, ["abc", "secret-key"], X.mask) == ["********", "secr******"]
    assert column(spark, ["one two three four five six seven", "w" * 60], X.title) == ["one two three four five six", "w" * 47 + "..."]
    assert column(spark, ["x" * 80 + "HIT" + "y" * 80, "none"], lambda c: X.snippet(c, "hit")) == ["..." + "x" * 50 + "HIT" + "y" * 50 + "...", "none"]


def test_standardise(spark):
    t = triples(spark, [
        ("The Acme Corp", "Company", "is located in the", "Oslo", "Location", False), ("acme", "Company", "owns", "pump unit", "Equipment", False),
        ("ACME Ltd.", "Company", "sells", "pump", "Equipment", False), ("acme", "Company", "is", "ACME", "Company", False), ("x", "Asset", " ", "y", "Asset", False),
    ])
    got = {(r["subject"], r["predicate"], r["object"]) for r in K.standardize(t).collect()}
    assert got == {("acme", "is located", "oslo"), ("acme", "owns", "pump unit"), ("acme", "sells", "pump unit")}


def test_transitive_and_lexical(spark):
    t = triples(spark, [("a", "T", "p one", "b", "T", False), ("a", "T", "last", "b", "T", False), ("b", "T", "q", "c", "T", False), ("cat", "T", "r", "dog", "T", False), ("catalog", "T", "r", "red dog", "T", False)])
    assert {(r["subject"], r["predicate"], r["object"]) for r in K.transitive(t).collect()} == {("a", "last via b", "c")}
    assert {(r["subject"], r["predicate"], r["object"]) for r in K.lexical(t).collect()} == {
        ("catalog", "is type of", "cat"), ("dog", "related to", "red dog"), *((long, "is type of", short) for long in ("cat", "catalog") for short in "ac")
    }


def test_dedupe_prefers_originals(spark):
    t = triples(spark, [("a", "T", "p", "b", "T", True), ("a", "T", "p", "b", "T", False), ("a", "T", "p", None, "T", True)])
    got = {(r["object"], r["inferred"]) for r in K.dedupe(t).collect()}
    assert got == {("b", False), (None, True)}


def test_graph_measures(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "y")], "a string, b string")
    assert {r["node"]: r["component"] for r in K.components(pairs).collect()} == dict.fromkeys("abcde", "a") | dict.fromkeys("xy", "x")
    path = pairs.filter("a <> 'x'")
    b = {r["node"]: r["betweenness"] for r in K.betweenness(path).collect()}
    assert b["c"] == pytest.approx(4 / 6) and b["b"] == pytest.approx(3 / 6) and b["a"] == 0
    e = {r["node"]: r["eigenvector"] for r in K.eigenvector(path).collect()}
    assert e["c"] > e["b"] > e["a"] and e["b"] == pytest.approx(e["d"], abs=1e-4)
    assert {r["node"]: r["degree"] for r in K.degree(path).collect()} == {"a": 1, "b": 2, "c": 2, "d": 2, "e": 1}


def test_vectors(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (5, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["similarity"]) for r in V.top_k(items, [1.0, 0.0], 4).orderBy("rank").collect()] == [(1, 1.0), (5, 1.0), (2, 0.0), (3, -1.0)]
    assert V.top_k(items, [1.0, 0.0], 9, F.col("vec_id") == 3).count() == 1


def test_questions(spark):
    asked = ["What is the total due?", "Who maintains pump P-1?", "How many in stock?", "Where is it?", "What horsepower?", "Hi"]
    assert column(spark, asked, Q.question_class) == ["cost", "work_order", "inventory", "location", "specification", "general"]
    assert column(spark, ["Show me 'Pump 12' at Site A-1"], Q.mentions)[0][:2] == ["Site A-1", "Pump 12"]
    assert column(spark, ["MATCH (n RETURN n"], Q.query_warnings)[0] == ["parentheses", "no LIMIT"]
    assert column(spark, ["Sure:\n```cypher\n// c\nMATCH (n) RETURN n\n```"], Q.clean_query) == ["MATCH (n) RETURN n"]


def test_latest_and_updates(spark):
    e = spark.createDataFrame([("j", "f", 1, 10), ("j", "f", 3, 30), ("j", "f", 2, 20), ("k", "f", 1, 5)], "job string, file string, ts int, pct int")
    assert {(r["job"], r["pct"]) for r in O.latest(e, ["job", "file"], ["ts"]).collect()} == {("j", 30), ("k", 5)}
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, s string, n int")
    new = spark.createDataFrame([(2, None, 9)], "id int, s string, n int")
    assert {tuple(r) for r in O.with_updates(base, new, "id").collect()} == {(1, "a", 1), (2, "b", 9)}


def test_json_and_fuzzy():
    assert json.loads(C.salvage_json('Sure! ```json\n[{"a": 1,}, {b: "x"}]\n```')) == [{"a": 1}, {"b": "x"}]
    assert json.loads(C.salvage_json('[{"a": 1}, {"b": 2')) == [{"a": 1}]
    assert C.salvage_json("no json") is None
    assert C.ratio("pump 7", "PUMP 7") == 100 and C.ratio("unit pump", "pump unit") == 100 and C.ratio("abc", "xyz") == 0


@settings(max_examples=60, deadline=None)
@given(st.text("ab .\n?,", max_size=400), st.integers(5, 60))
def test_recursive_chunks_lose_nothing_and_fit(text, size):
    out = C.recursive(text, size, 0)
    assert all(len(c) <= size for c in out)
    assert "".join("".join(out).split()) == "".join(text.split())


@settings(max_examples=60, deadline=None)
@given(st.text("ab .\n?", max_size=400))
def test_token_chunks_hold_every_sentence(text):
    out = C.by_tokens(text, 10, 0)
    assert "".join("".join(out).split()) == "".join(text.split())


def test_providers_in_order(spark):
    df = spark.createDataFrame([("x",), ("",), (None,)], "t string")
    got = [tuple(r[0]) for r in df.select(G.ask(F.col("t"), [G.Silent(), G.Echo()])).collect()]
    assert got == [("x", "echo"), (None, None), (None, None)]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode())
    (tmp_path / "b.txt").write_bytes("é".encode("latin-1"))
    assert [r["text"] for r in S.read_text(spark, str(tmp_path)).collect()] == ["é", "é"]
    cache = spark.createDataFrame([("h1",)], "file_hash string")
    files = spark.createDataFrame([("h1",), ("h2",)], "file_hash string")
    assert [r[0] for r in S.cache_misses(files, cache, "file_hash").collect()] == ["h2"]
