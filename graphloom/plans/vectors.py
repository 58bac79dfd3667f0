"""Queries over the vector collection: embeddings with the metadata of the documents of the same number."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import cells as I
from graphloom.operators import vectors as V
from graphloom.plans.text import ENTITIES_SQL, METHOD, METHOD_SQL, W
from graphloom.sources.store import once
from graphloom.sources.tables import table


def items(spark, sf):
    return table(spark, sf, "embeddings")


def query_vector(spark, sf, k=0):
    return items(spark, sf).filter(F.col("vec_id") == k).select("embedding").first()[0]  # one row


def meta(spark, sf):
    """Vectors with metadata: document text, type, method, quality and lists of entities."""
    d = table(spark, sf, "documents")
    t = F.col("text")
    e = X.entities(t)
    get = lambda k: F.coalesce(F.try_element_at(e, F.lit(k)), F.array().cast("array<string>")).alias(k)
    quality = F.round(F.least(F.size(X.words(t)) / 500.0, F.lit(1.0)), 6)
    rows = d.select("doc_id", t, F.col("lang").alias("document_type"), METHOD().alias("method"), quality.alias("quality"), get("wells"), get("formations"))
    return items(spark, sf).join(rows, F.col("vec_id") == F.col("doc_id"))


COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {0}))"
META = f"(SELECT e.vec_id, embedding, label, text, lang AS document_type, {METHOD_SQL} AS method, round(least(len({W}) / 500.0, 1.0)::DOUBLE, 6) AS quality FROM embeddings e JOIN documents ON vec_id = doc_id)"
ENT = "(" + ENTITIES_SQL + ")"


def rounded(df, *columns):
    return df.select(*[F.round(c, 5).alias(c) if c in (columns or ("similarity",)) else F.col(c) for c in df.columns])


def top_sql(where="true", k=10, source="embeddings"):
    return f"SELECT vec_id, round(s, 5) AS similarity, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM (SELECT vec_id, {COS.format(0)} AS s FROM {source} WHERE {where}) ORDER BY s DESC, vec_id LIMIT {k}"


def index(spark, sf) -> I.Cells:
    """The vectors with their labels by cells, stored once per session and state of the table."""
    return once(spark, sf, "cells", ["embeddings"], lambda: I.write_index(items(spark, sf), keep=["label"]))


def v_topk(spark, sf):
    """The ten vectors most like vector 0."""
    return rounded(I.nearest(index(spark, sf), query_vector(spark, sf), 10))


def v_topk_filtered(spark, sf):
    """The ten vectors of three labels that are most like vector 0."""
    return rounded(I.nearest(index(spark, sf), query_vector(spark, sf), 10, F.col("label").isin(1, 2, 3)))


def v_topk_batch(spark, sf):
    """The five vectors most like each whose number 100 divides."""
    qs = items(spark, sf).filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return rounded(I.nearest_batch(index(spark, sf), qs, 5))


def v_context_search(spark, sf):
    """Previews of the three documents whose vectors are most like vector 3."""
    docs = table(spark, sf, "documents")
    best = I.nearest(index(spark, sf), query_vector(spark, sf, 3), 3, within=docs.select(F.col("doc_id").alias("vec_id")))
    return best.join(docs, F.col("vec_id") == F.col("doc_id")).select("rank", "vec_id", X.truncate(F.col("text"), 100).alias("preview"))


def multi_filter(df, quality=None, types=None, methods=None, entity_types=None):
    """Conjunction of whatever filters are given; entity types ask for at least one entity of any of them."""
    out = df
    if quality:
        out = out.filter(F.col("quality").between(*quality))
    if types:
        out = out.filter(F.col("document_type").isin(*types))
    if methods:
        out = out.filter(F.col("method").isin(*methods))
    if entity_types:
        any_of = F.lit(False)
        for e in entity_types:
            any_of = any_of | (F.size(e) > 0)
        out = out.filter(any_of)
    return out


def v_collection_stats(spark, sf):
    m = meta(spark, sf)
    return m.groupBy("document_type", "method").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("quality") > 0, F.col("quality"))), 6).alias("avg_quality"), F.min("quality").alias("min_quality"), F.max("quality").alias("max_quality"))


def v_hybrid(spark, sf):
    near = V.top_k(items(spark, sf), query_vector(spark, sf), 20)
    docs = table(spark, sf, "documents")
    hits = docs.select("doc_id", F.size(F.regexp_extract_all(F.lower("text"), F.lit("the"), 0)).alias("n")).filter("n > 0")
    words = hits.orderBy(F.desc("n"), "doc_id").limit(20).select(F.col("doc_id").alias("vec_id"), "n")
    words = words.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "vec_id")).cast("long"))  # twenty rows
    return V.hybrid(near, words, "vec_id", 10).select("vec_id", F.round("score", 6).alias("score"))


QUERIES = {
    "v_topk": (v_topk, top_sql()),
    "v_topk_filtered": (v_topk_filtered, top_sql("label IN (1, 2, 3)")),
    "v_topk_batch": (v_topk_batch, "SELECT * FROM (SELECT query_id, vec_id, round(s, 5) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)) WHERE rank <= 5"),
    "v_context_search": (v_context_search, f"WITH b AS (SELECT vec_id, {COS.format(3)} AS s FROM {META} ORDER BY s DESC, vec_id LIMIT 3) SELECT row_number() OVER (ORDER BY s DESC, vec_id) AS rank, vec_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS preview FROM b JOIN documents ON vec_id = doc_id"),
    "v_by_entity_type": (lambda s, d: meta(s, d).filter(F.size("wells") > 0).select("vec_id", F.array_join("wells", "|").alias("wells")), f"SELECT vec_id, names AS wells FROM embeddings JOIN {ENT} ON vec_id = doc_id WHERE entity_type = 'wells'"),
    "v_by_doc_type": (lambda s, d: meta(s, d).filter("document_type = 'de' and quality >= 0.5").select("vec_id", "quality"), f"SELECT vec_id, quality FROM {META} WHERE document_type = 'de' AND quality >= 0.5"),
    "v_multi_filter": (lambda s, d: multi_filter(meta(s, d), (0.2, 0.9), ["en", "fr"], ["gemini", "mistral"]).select("vec_id", "document_type", "method", "quality"), f"SELECT vec_id, document_type, method, quality FROM {META} WHERE quality BETWEEN 0.2 AND 0.9 AND document_type IN ('en', 'fr') AND method IN ('gemini', 'mistral')"),
    "v_multi_filter_entities": (lambda s, d: multi_filter(meta(s, d), entity_types=["wells", "formations"]).select("vec_id").distinct(), f"SELECT DISTINCT vec_id FROM embeddings JOIN {ENT} ON vec_id = doc_id WHERE entity_type IN ('wells', 'formations')"),
    "v_collection_stats": (v_collection_stats, f"SELECT document_type, method, count(*) AS n, round(avg(quality) FILTER (quality > 0), 6) AS avg_quality, min(quality) AS min_quality, max(quality) AS max_quality FROM {META} GROUP BY 1, 2"),
    "v_entity_stats": (
        lambda s, d: V.entity_statistics(meta(s, d), ["wells", "formations"]),
        f"WITH n AS (SELECT entity_type AS kind, vec_id, unnest(string_split(names, '|')) AS value FROM embeddings JOIN {ENT} ON vec_id = doc_id WHERE entity_type IN ('wells', 'formations')), c AS (SELECT kind, value, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, value) AS r FROM n GROUP BY 1, 2), k AS (SELECT unnest(['wells', 'formations']) AS kind) SELECT kind, (SELECT count(DISTINCT vec_id) FROM n WHERE n.kind = k.kind) AS items_with, (SELECT count(*) FROM n WHERE n.kind = k.kind) AS mentions, (SELECT count(*) FROM c WHERE c.kind = k.kind) AS \"unique\", round((SELECT count(DISTINCT vec_id) FROM n WHERE n.kind = k.kind) * 100.0::DOUBLE / (SELECT count(*) FROM {META}), 4) AS coverage_percent, coalesce((SELECT string_agg(value || ':' || n, '|' ORDER BY r) FROM c WHERE c.kind = k.kind AND r <= 10), '') AS top FROM k",
    ),
    "v_count": (lambda s, d: items(s, d).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM embeddings"),
    "v_exact": (lambda s, d: table(s, d, "documents").filter(F.lower("text").contains("idiot")).select("doc_id"), "SELECT doc_id FROM documents WHERE contains(lower(text), 'idiot')"),
    "v_hybrid": (v_hybrid, f"WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY {COS.format(0)} DESC, vec_id) AS rank FROM embeddings), b AS (SELECT doc_id AS vec_id, row_number() OVER (ORDER BY len(regexp_extract_all(lower(text), 'the')) DESC, doc_id) AS rank FROM documents WHERE contains(lower(text), 'the')), u AS (SELECT vec_id, 1.0::DOUBLE / (60 + rank) AS s FROM a WHERE rank <= 20 UNION ALL SELECT vec_id, 1.0::DOUBLE / (60 + rank) FROM b WHERE rank <= 20) SELECT vec_id, round(sum(s), 6) AS score FROM u GROUP BY 1 ORDER BY sum(s) DESC, vec_id LIMIT 10"),
    "src_chroma_get": (lambda s, d: items(s, d).filter("label = 4").select("vec_id", "label").orderBy("vec_id").limit(50), "SELECT vec_id, label FROM embeddings WHERE label = 4 ORDER BY vec_id LIMIT 50"),
    "sink_vectors_meta": (lambda s, d: meta(s, d).select("vec_id", "document_type", "method", "quality", F.size("wells").cast("long").alias("wells_count")), f"SELECT vec_id, document_type, method, quality, coalesce((SELECT len(string_split(names, '|')) FROM {ENT} x WHERE x.doc_id = m.vec_id AND entity_type = 'wells'), 0) AS wells_count FROM {META} m"),
}
