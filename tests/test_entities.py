"""Patterns of entities against RE2, where letters beyond ASCII stand at their edges."""

import duckdb
import pytest

from graphloom.functions import text as X
from graphloom.plans import registry
from graphloom.plans.text import ENTITIES_SQL
from pyspark.sql import functions as F


def test_edges_spaces_and_case_equal_the_sql(spark):
    texts = [
        "lieux 3 et \u00e9eux 3, ch\u00e2teau 187", "\u00f1A-12\u00e9", "A\u017f 7 b\u212a-9", "e\u017f\u212a1 Well", "Well\u000bX9 and Well\tX9", "a\u017fandy \u017fand x \u017fHALE",
        "pump jac\u212a", "drilling rig DR\u0131LLING rig", "\u00c9lite Formation \u00e9\u00e9 Sand", "W 12 Well", "", "x\n7",
    ]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = df.select("doc_id", F.explode(X.entities(F.col("text"))).alias("t", "n")).select("doc_id", "t", F.array_join("n", "|")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(map(tuple, got)) == sorted(con.execute(ENTITIES_SQL).fetchall()) and len(got) > 8


def both(spark, folder, name, texts):
    """Rows of a query and of its SQL over (number, text) documents with a vector for each number."""
    d = spark.createDataFrame([(i, t, "fr", "web", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    d.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    v = spark.createDataFrame([(i, [1.0, float(i)], 0) for i in {i for i, _ in texts}], "vec_id long, embedding array<float>, label int")
    v.coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    found = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    got = registry.queries()[name](spark, str(folder)).select(columns).collect()
    return sorted(map(tuple, got), key=repr), sorted(found.fetchall(), key=repr)


@pytest.mark.parametrize("name", ["sink_document_meta", "sink_vectors_meta", "v_multi_filter_entities", "v_by_entity_type"])
def test_names_beside_accented_letters_count_in_the_query(spark, tmp_path, name):
    """Only edges beyond ASCII: where Java's word edges hold, these documents have no name, or another one."""
    texts = ["j'\u00e9tai 44", "d\u00e9gel\u00e9e\u00e8ai 93 \u00e0", "\u00e9\u00e9 Sand \u00e9t\u00e9t Sand", "\u00fcWell\tX9", "rien", "", None]
    got, want = both(spark, tmp_path, name, list(enumerate(texts)))
    assert got == want and want


def test_a_vector_of_two_documents_comes_once(spark, tmp_path):
    got, want = both(spark, tmp_path, "v_multi_filter_entities", [(7, "W-12"), (7, "the Bakken Shale"), (8, "W-13"), (9, "nothing")])
    assert got == want == [(7,), (8,)]
