"""Queries over the property graph: patterns, catalogue, neighbourhoods and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import patterns
from graphloom.sources.store import edges, graph, nodes, once_through
from graphloom.sources.tables import GRAPH_SQL, table

#: Search values of the pattern queries, over the names of the tables at hand.
VALUES = {
    "gp01_wo_maintenance": "ring", "gp02_person_assignments": "customer#00000001", "gp03_wo_details": "wo-1", "gp04_asset_history": "ring",
    "gp05_wo_status": "wo-2", "gp06_wo_by_approver": "supplier", "gp07_asset_maintenance": "ring 1", "gp08_cost": "wo-3",
    "gp09_personnel": "1", "gp10_inventory": "ring", "gp11_location": "a", "gp12_temporal": "1996-0", "gp13_hierarchy": "a",
    "gp14_vendor": "1", "gl01_entity_lookup": "ring", "gl02_wo_technician": "1", "gl03_contains_path": "a", "gl04_compliance": "ring",
}


def _pattern(name: str):
    p, value = patterns.PATTERNS[name], VALUES[name]
    return lambda spark, sf: patterns.run(p, *graph(spark, sf), value), GRAPH_SQL + patterns.sql(p, value)


def related_facts(n, e, name: str, types=None):
    """Outgoing and incoming facts of the named entity, each once, optionally of some edge types."""
    e = e.filter(F.col("type").isin(*types)) if types else e
    me = n.filter(F.lower("name") == name.lower()).select("id", F.col("name").alias("me"))
    other = n.select(F.col("id").alias("oid"), F.col("name").alias("other"))
    out = me.join(e, F.col("id") == F.col("src")).join(other, F.col("oid") == F.col("dst")).select(F.col("me").alias("subject"), "type", F.col("other").alias("object"))
    back = me.join(e, F.col("id") == F.col("dst")).join(other, F.col("oid") == F.col("src")).select(F.col("other").alias("subject"), "type", F.col("me").alias("object"))
    return out.union(back).distinct()


def stats(n, e):
    """Counts of nodes, entities, edges, types, dated edges and the share of these; one row."""
    a = n.agg(F.count("*").alias("n_nodes"), F.count_if(F.array_contains("labels", "WorkOrder")).alias("n_work_orders"), F.count_if(F.array_contains("labels", "Person")).alias("n_persons"))
    b = e.agg(F.count("*").alias("n_edges"), F.count_distinct("type").alias("n_types"), F.count("when").alias("n_dated"))
    return a.crossJoin(b).withColumn("dated_percent", F.round(F.coalesce(F.try_divide(F.col("n_dated") * 100.0, F.col("n_edges")), F.lit(0.0)), 4))


def g_schema_labels(spark, sf):
    return nodes(spark, sf).select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def g_rel_frequency(spark, sf):
    return edges(spark, sf).groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type").limit(20)


def g_common_patterns(spark, sf):
    n, e = graph(spark, sf)
    first = lambda k, c: n.select(F.col("id").alias(k), F.element_at("labels", 2).alias(c))
    rows = e.join(first("src", "source_label"), "src").join(first("dst", "target_label"), "dst")
    return rows.groupBy("source_label", "type", "target_label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_label", "type", "target_label").limit(20)


def g_label_sample(spark, sf):
    return nodes(spark, sf).select("name", F.array_join("labels", "|").alias("labels")).orderBy("name", "labels").limit(50)


def g_label_props(spark, sf):
    """Which properties the edges of each type carry."""
    e = edges(spark, sf).select("type", F.explode(F.array_compact(F.array(F.when(F.col("when").isNotNull(), F.lit("when")), F.when(F.col("status").isNotNull(), F.lit("status"))))).alias("property"))
    return e.groupBy("type").agg(F.array_join(F.array_sort(F.collect_set("property")), ",").alias("properties"))


def g_viz_degree(spark, sf):
    """Nodes with more than two edges, with their degrees: the 100 largest."""
    n, e = once_through(spark, sf)
    ends = e.select(F.col("src").alias("id")).unionAll(e.select(F.col("dst").alias("id")))
    d = ends.groupBy("id").agg(F.count("*").alias("degree")).filter("degree > 2")
    named = d.join(n.select("id"), "id", "left_semi").orderBy(F.desc("degree"), "id").limit(100)  # names only for those
    return F.broadcast(named).join(n.select("id", "name"), "id").orderBy(F.desc("degree"), "id")


def g_viz_all(spark, sf):
    return edges(spark, sf).select("src", "type", "dst").orderBy("src", "type", "dst").limit(100)


def g_viz_recent(spark, sf):
    return edges(spark, sf).filter(F.col("when").isNotNull()).select("src", "type", "dst", "when").orderBy(F.desc("when"), "src", "dst").limit(50)


def g_viz_doc(spark, sf):
    """Clusters of the documents: entities mentioned per source, through the chunks."""
    return _mentions(spark, sf).groupBy("doc_id").agg(F.count_distinct("entity").alias("entities"), F.count_distinct("chunk").alias("chunks")).filter("entities > 1")


def g_entity_types(spark, sf):
    n = nodes(spark, sf)
    return n.select(F.coalesce(F.try_element_at("labels", F.lit(3)), F.try_element_at("labels", F.lit(2)), F.lit("Entity")).alias("entity_type")).distinct().orderBy("entity_type").limit(20)


def _mentions(spark, sf):
    """doc_id, chunk, entity: entities are words that start upper case in a line, chunks the lines of a document."""
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk", "line"))
    return docs.select("doc_id", F.col("chunk").cast("long").alias("chunk"), "line", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit("[A-Z][a-z]{3,}"), 0))).alias("entity"))


_MENTIONS_SQL = (
    "WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk FROM documents), "
    "mentions AS (SELECT doc_id, chunk, line, unnest(list_distinct(regexp_extract_all(line, '[A-Z][a-z]{3,}'))) AS entity FROM lines)"
)


def g_doc_entities(spark, sf):
    """The 20 entities that each document mentions most."""
    counts = _mentions(spark, sf).groupBy("doc_id", "entity").agg(F.count("*").alias("mentions"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("mentions"), "entity")
    return counts.withColumn("rank", F.row_number().over(w)).filter("rank <= 20").withColumn("rank", F.col("rank").cast("long"))


def g_doc_relationships(spark, sf):
    """Pairs of entities that chunks of a document mention together, by frequency over all documents: the first ten."""
    m = _mentions(spark, sf).select("doc_id", "chunk", "entity")
    pairs = m.join(m.select("doc_id", "chunk", F.col("entity").alias("other")), ["doc_id", "chunk"]).filter("entity < other")
    g = pairs.groupBy("entity", "other").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))
    return g.orderBy(F.desc("n"), "entity", "other").limit(10)


def g_doc_chunks(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    words = F.size(F.filter(F.split("line", " "), lambda w: w != ""))
    return lines.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.round(F.avg(words), 6).alias("avg_words"))


def g_quality_sample(spark, sf):
    return edges(spark, sf).filter("type = 'APPROVED_BY'").select("src", "type", "dst").orderBy("src", "dst").limit(10)


def g_sanitized_merge(spark, sf):
    """Edges upserted by (src, type, dst), with counts of rows processed and merged away per type."""
    e = edges(spark, sf)
    return e.groupBy("type", "src", "dst").agg(F.count("*").alias("k")).groupBy("type").agg(F.sum("k").alias("processed"), F.count("*").alias("stored"), (F.sum("k") - F.count("*")).alias("merged"))


QUERIES = {name: _pattern(name) for name in patterns.PATTERNS} | {
    "g_related_facts": (
        lambda spark, sf: related_facts(*once_through(spark, sf), "WO-7"),
        GRAPH_SQL + ", me AS (SELECT id, name FROM nodes WHERE lower(name) = 'wo-7') SELECT me.name AS subject, type, o.name AS object FROM me JOIN edges ON src = me.id JOIN nodes o ON o.id = dst UNION SELECT o.name, type, me.name FROM me JOIN edges ON dst = me.id JOIN nodes o ON o.id = src",
    ),
    "g_related_facts_typed": (
        lambda spark, sf: related_facts(*once_through(spark, sf), "WO-7", ["ASSIGNED_TO", "PROVIDES"]),
        GRAPH_SQL + ", me AS (SELECT id, name FROM nodes WHERE lower(name) = 'wo-7'), f AS (SELECT * FROM edges WHERE type IN ('ASSIGNED_TO', 'PROVIDES')) SELECT me.name AS subject, type, o.name AS object FROM me JOIN f ON src = me.id JOIN nodes o ON o.id = dst UNION SELECT o.name, type, me.name FROM me JOIN f ON dst = me.id JOIN nodes o ON o.id = src",
    ),
    "g_stats": (
        lambda spark, sf: stats(nodes(spark, sf), edges(spark, sf)),
        GRAPH_SQL + " SELECT * FROM (SELECT count(*) AS n_nodes, count(*) FILTER (list_contains(labels, 'WorkOrder')) AS n_work_orders, count(*) FILTER (list_contains(labels, 'Person')) AS n_persons FROM nodes), (SELECT count(*) AS n_edges, count(DISTINCT type) AS n_types, count(\"when\") AS n_dated, round(count(\"when\") * 100.0::DOUBLE / count(*), 4) AS dated_percent FROM edges)",
    ),
    "g_schema_labels": (g_schema_labels, GRAPH_SQL + " SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM nodes) GROUP BY 1"),
    "g_schema_rels": (lambda s, d: edges(s, d).select("type").distinct(), GRAPH_SQL + " SELECT DISTINCT type FROM edges"),
    "g_rel_frequency": (g_rel_frequency, GRAPH_SQL + " SELECT type, count(*) AS n FROM edges GROUP BY 1 ORDER BY n DESC, type LIMIT 20"),
    "g_common_patterns": (g_common_patterns, GRAPH_SQL + " SELECT a.labels[2] AS source_label, type, b.labels[2] AS target_label, count(*) AS n FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst GROUP BY 1, 2, 3 ORDER BY n DESC, 1, 2, 3 LIMIT 20"),
    "g_label_sample": (g_label_sample, GRAPH_SQL + " SELECT name, array_to_string(labels, '|') AS labels FROM nodes ORDER BY 1, 2 LIMIT 50"),
    "g_label_props": (g_label_props, GRAPH_SQL + " SELECT type, array_to_string(list_sort(list(DISTINCT p)), ',') AS properties FROM (SELECT type, 'when' AS p FROM edges WHERE \"when\" IS NOT NULL UNION ALL SELECT type, 'status' FROM edges WHERE status IS NOT NULL) GROUP BY 1"),
    "g_viz_degree": (g_viz_degree, GRAPH_SQL + " SELECT id, degree, name FROM (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1 HAVING count(*) > 2) JOIN nodes USING (id) ORDER BY degree DESC, id LIMIT 100"),
    "g_viz_all": (g_viz_all, GRAPH_SQL + " SELECT src, type, dst FROM edges ORDER BY 1, 2, 3 LIMIT 100"),
    "g_viz_recent": (g_viz_recent, GRAPH_SQL + ' SELECT src, type, dst, "when" FROM edges WHERE "when" IS NOT NULL ORDER BY 4 DESC, 1, 3 LIMIT 50'),
    "g_viz_doc": (g_viz_doc, _MENTIONS_SQL + " SELECT doc_id, count(DISTINCT entity) AS entities, count(DISTINCT chunk) AS chunks FROM mentions GROUP BY 1 HAVING count(DISTINCT entity) > 1"),
    "g_entity_types": (g_entity_types, GRAPH_SQL + " SELECT DISTINCT coalesce(labels[3], labels[2], 'Entity') AS entity_type FROM nodes ORDER BY 1 LIMIT 20"),
    "g_doc_entities": (g_doc_entities, _MENTIONS_SQL + ", c AS (SELECT doc_id, entity, count(*) AS mentions FROM mentions GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY mentions DESC, entity) AS rank FROM c) WHERE rank <= 20"),
    "g_doc_relationships": (g_doc_relationships, _MENTIONS_SQL + " SELECT a.entity, b.entity AS other, count(*) AS n, count(DISTINCT a.doc_id) AS docs FROM mentions a JOIN mentions b ON a.doc_id = b.doc_id AND a.chunk = b.chunk AND a.entity < b.entity GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10"),
    "g_doc_chunks": (g_doc_chunks, "SELECT doc_id, count(*) AS chunks, round(avg(len(list_filter(string_split(line, ' '), lambda w: w <> ''))), 6) AS avg_words FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1"),
    "g_quality_sample": (g_quality_sample, GRAPH_SQL + " SELECT src, type, dst FROM edges WHERE type = 'APPROVED_BY' ORDER BY 1, 3 LIMIT 10"),
    "g_sanitized_merge": (g_sanitized_merge, GRAPH_SQL + " SELECT type, sum(k)::BIGINT AS processed, count(*) AS stored, (sum(k) - count(*))::BIGINT AS merged FROM (SELECT type, src, dst, count(*) AS k FROM edges GROUP BY 1, 2, 3) GROUP BY 1"),
    "src_neo4j_scan": (
        lambda s, d: nodes(s, d).filter(F.array_contains("labels", "Vendor")).select("id", "name"),
        GRAPH_SQL + " SELECT id, name FROM nodes WHERE list_contains(labels, 'Vendor')",
    ),
}
