"""Queries over triples made from the tables: standardising, inference, components and centrality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import triples as K
from graphloom.plans.text import NSTOPS, STOPS, q
from graphloom.sources.store import stored
from graphloom.sources.tables import table


def triples(spark, sf):
    """Suppliers, brands and places as triples; names come in several casings and with company endings."""
    s, n, p, r = (table(spark, sf, t) for t in ("supplier", "nation", "part", "region"))
    col = lambda *c: dict(zip(K.KEYS, c))

    def rows(df, base, c):
        cols = [F.lit(v[1:]) if isinstance(v, str) and v[0] == "=" else v for v in c.values()]
        return df.select(*[F.col(v).alias(k) if isinstance(v, str) else v.alias(k) for k, v in zip(c, cols)], (F.lit(base) + F.monotonically_increasing_id() * 0).alias("base"), "key")

    located = s.join(n, s["s_nationkey"] == n["n_nationkey"]).withColumn("key", F.col("s_suppkey"))
    a = rows(located, 0, col(F.concat(F.when(F.col("s_suppkey") % 2 == 0, "The ").otherwise(""), "s_name", F.when(F.col("s_suppkey") % 3 == 0, " Ltd").otherwise("")), "=Company", "=is located in the", "n_name", "=Location"))
    b = rows(n.join(r, n["n_regionkey"] == r["r_regionkey"]).withColumn("key", F.col("n_nationkey").cast("long")), 10**9, col(F.lower("n_name"), "=Location", "=part of", "r_name", "=Location"))
    c = rows(p.withColumn("key", F.col("p_partkey")), 2 * 10**9, col("p_name", "=Equipment", "=made by", "p_brand", "=Asset"))
    d = rows(p.filter("p_size < 10").withColumn("key", F.col("p_partkey")), 3 * 10**9, col("p_brand", "=Asset", "=has", "p_type", "=Material"))
    e = rows(p.filter("p_partkey % 50 = 0").withColumn("key", F.col("p_partkey")), 4 * 10**9, col("p_name", "=Equipment", F.lit(" "), "p_type", "=Material"))
    out = a
    for x in (b, c, d, e):
        out = out.unionByName(x)
    return out.select(*K.KEYS, (F.col("base") + F.col("key")).alias("ord"), F.lit(False).alias("inferred"))


SQL = """WITH RECURSIVE t AS (
SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'The ' ELSE '' END || s_name || CASE WHEN s_suppkey % 3 = 0 THEN ' Ltd' ELSE '' END AS subject, 'Company' AS subject_type, 'is located in the' AS predicate, n_name AS object, 'Location' AS object_type, s_suppkey AS ord FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT lower(n_name), 'Location', 'part of', r_name, 'Location', 1000000000 + n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT p_name, 'Equipment', 'made by', p_brand, 'Asset', 2000000000 + p_partkey FROM part
UNION ALL SELECT p_brand, 'Asset', 'has', p_type, 'Material', 3000000000 + p_partkey FROM part WHERE p_size < 10
UNION ALL SELECT p_name, 'Equipment', ' ', p_type, 'Material', 4000000000 + p_partkey FROM part WHERE p_partkey % 50 = 0),
valid AS (SELECT * FROM t WHERE trim(subject) <> '' AND trim(predicate) <> '' AND trim(object) <> ''),
ends AS (SELECT subject AS n, subject_type AS y FROM valid UNION ALL SELECT object, object_type FROM valid),
details AS (SELECT lower(n) AS name, list_sort(list(DISTINCT n)) AS casings, list_sort(list(DISTINCT y)) AS types, count(*) AS mentions FROM ends GROUP BY 1)"""
NORMAL = f"array_to_string(list_filter(regexp_split_to_array(regexp_replace(name, '[^\\w\\s#-]', '', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN ({NSTOPS})), ' ')"
GROUPS = f", norm AS (SELECT name, mentions, types, coalesce(nullif({NORMAL}, ''), name) AS normal FROM details), groups AS (SELECT name, types, first_value(name) OVER (PARTITION BY normal ORDER BY mentions DESC, length(name) DESC, name) AS standard FROM norm)"
ALLOWED = " OR ".join(f"(x = {q(a)} AND y = {q(b)}) OR (x = {q(b)} AND y = {q(a)})" for a, b in K.TYPE_PAIRS)
PAIR = ", pair AS (SELECT subject, object, arg_max(predicate, ord) AS p FROM valid GROUP BY 1, 2)"
LIMIT = "CASE WHEN len({0}) <= 3 THEN {1} WHEN lower({0}[3]) IN (" + STOPS + ") THEN array_to_string({0}[1:2], ' ') ELSE array_to_string({0}[1:3], ' ') END"
TRANSITIVE = PAIR + ", hops AS (SELECT a.subject AS s, b.object AS o, list_filter(string_split(a.p || ' via ' || a.object || ' leading to ' || b.p, ' '), lambda w: w <> '') AS w FROM pair a JOIN pair b ON a.object = b.subject WHERE a.subject <> b.object), trans AS (SELECT DISTINCT s AS subject, " + LIMIT.format("w", "array_to_string(w, ' ')") + " AS predicate, o AS object FROM hops WHERE NOT EXISTS (SELECT 1 FROM pair WHERE subject = s AND object = o))"
LEXICAL = """, nm AS (SELECT DISTINCT lower(subject) AS n FROM valid UNION SELECT lower(object) FROM valid),
linked AS (SELECT DISTINCT least(lower(subject), lower(object)) AS a, greatest(lower(subject), lower(object)) AS b FROM valid),
pairs AS (SELECT x.n AS a, y.n AS b, list_has_any(list_filter(string_split(x.n, ' '), lambda w: w <> ''), list_filter(string_split(y.n, ' '), lambda w: w <> '')) AS shared FROM nm x JOIN nm y ON x.n < y.n WHERE NOT EXISTS (SELECT 1 FROM linked l WHERE l.a = x.n AND l.b = y.n)),
lex AS (SELECT a AS subject, 'related to' AS predicate, b AS object FROM pairs WHERE shared
UNION ALL SELECT a, 'is type of', b FROM pairs WHERE NOT shared AND contains(a, b) AND length(a) > length(b) AND b <> ''
UNION ALL SELECT b, 'is type of', a FROM pairs WHERE NOT shared AND contains(b, a) AND length(b) > length(a) AND a <> '')"""
UNDIRECTED = ", u AS (SELECT DISTINCT least(subject, object) AS a, greatest(subject, object) AS b FROM valid)"
DEGREE = UNDIRECTED + ", d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM u UNION ALL SELECT b FROM u) GROUP BY 1)"


def valid(spark, sf):
    return K.validate(triples(spark, sf), ("subject", "predicate", "object"))


def kg_validate(spark, sf):
    return triples(spark, sf).withColumn("reasons", F.array_join(K.invalid_reasons(), ",")).groupBy("reasons").agg(F.count("*").alias("n"))


def kg_validate3(spark, sf):
    t = K.validate(triples(spark, sf).withColumn("subject_type", F.when(F.col("ord") % 2 == 0, F.col("subject_type"))), ("subject", "predicate", "object"))
    return t.select("ord", F.coalesce("subject_type", F.lit("Unknown")).alias("subject_type"))


def kg_entity_details(spark, sf):
    d = K.entity_details(valid(spark, sf))
    return d.select("name", F.array_join("casings", "|").alias("casings"), F.array_join("types", "|").alias("types"), "mentions")


def kg_type_compat(spark, sf):
    d = K.entity_details(valid(spark, sf)).select("name", "types")
    k = d.select("types", F.array_join("types", "|").alias("t")).groupBy("t").agg(F.first("types").alias("types"))
    pairs = k.join(k.select(F.col("t").alias("u"), F.col("types").alias("other")), F.col("t") <= F.col("u"))  # a few distinct lists of types
    return pairs.select("t", "u", K.compatible(F.col("types"), F.col("other")).alias("compatible"))


def kg_merge_subset(spark, sf):
    d = K.entity_details(valid(spark, sf))
    return K.subset_merges(d.select("name", "types"))


MERGES = (
    ", w0 AS (SELECT name, types, list_filter(string_split(name, ' '), lambda x: x <> '') AS w FROM {0}), w1 AS (SELECT *, list_distinct(list_transform(list_filter(w, lambda x: length(x) > 4), lambda x: x[1:4])) AS stems FROM w0), "
    "fit AS (SELECT a.name, b.name AS target FROM w1 a JOIN w1 b ON length(b.name) > length(a.name) OR (length(b.name) = length(a.name) AND b.name > a.name) "
    "WHERE ((len(list_filter(a.w, lambda x: NOT list_contains(b.w, x))) = 0) OR (least(len(a.stems), len(b.stems)) > 0 AND len(list_intersect(a.stems, b.stems)) > 0.5 * least(len(a.stems), len(b.stems)))) "
    "AND (len(a.types) = 0 OR len(b.types) = 0 OR EXISTS (SELECT 1 FROM unnest(a.types) p(x), unnest(b.types) r(y) WHERE x = y OR " + ALLOWED + "))), "
    "merges AS (SELECT name, arg_max(target, lpad(length(target)::VARCHAR, 9, '0') || target) AS target FROM fit GROUP BY 1)"
)
FIX = ", walk AS (SELECT name, target, 1 AS k FROM merges UNION ALL SELECT w.name, m.target, k + 1 FROM walk w JOIN merges m ON m.name = w.target), ended AS (SELECT name, arg_max(target, k) AS target FROM walk GROUP BY 1)"
STD = GROUPS + ", std AS (SELECT standard AS name, list_distinct(flatten(list(types))) AS types FROM groups GROUP BY 1)" + MERGES.format("std") + FIX + ", named AS (SELECT g.name, coalesce(e.target, g.standard) AS standard FROM groups g LEFT JOIN ended e ON e.name = g.standard)"


def kg_fixpoint(spark, sf):
    return K.fixpoint(kg_merge_subset(spark, sf))


def kg_standardize(spark, sf):
    return K.standardize(triples(spark, sf)).select("subject", "predicate", "object", "ord")


def kg_apply_map(spark, sf):
    t = valid(spark, sf)
    g = K.normal_groups(K.entity_details(t))
    a = t.join(g.select(F.col("name").alias("k"), F.col("standard").alias("s")), F.lower("subject") == F.col("k")).drop("k")
    return a.join(g.select(F.col("name").alias("k"), F.col("standard").alias("o")), F.lower("object") == F.col("k")).select("ord", F.col("s").alias("subject"), F.col("o").alias("object"))


def kg_components(spark, sf):
    return K.components(K.undirected(valid(spark, sf)))


def kg_node_size(spark, sf):
    """Sizes of all nodes from their degree, betweenness and eigenvector value."""
    pairs = K.checkpoint(K.undirected(valid(spark, sf)))
    metrics = K.degree(pairs).join(K.betweenness(pairs), "node").join(K.eigenvector(pairs), "node")
    return K.node_size(metrics).select("node", F.round("size", 4).alias("size"))


def kg_graph_summary(spark, sf):
    return K.infer_counts(valid(spark, sf))


def kg_dedupe(spark, sf):
    t = valid(spark, sf).select("subject", "predicate", "object", "inferred", "ord")
    again = t.withColumns({"inferred": F.lit(True), "ord": F.col("ord") - 5_000_000_000})
    return K.dedupe(again.unionByName(t)).groupBy("predicate").agg(F.count("*").alias("n"), F.count_if("inferred").alias("inferred"), F.min("ord").alias("first"))


def entry_summary(spark, sf):
    """Raw triples to a standardised, inferred graph in numbers."""
    t = K.standardize(triples(spark, sf))
    g = K.infer(t)
    return g.groupBy("predicate", "inferred").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("subjects"))


def candidates_within(spark, sf):
    """All unlinked pairs of names (subject < object) with a shared word, or of which one contains the other, inside the two largest components of five nodes or more.

    Pairs are looked for among the names of a component, never among all names.
    """
    t = valid(spark, sf)
    c = K.components(K.undirected(t))
    top = c.groupBy("component").agg(F.count("*").alias("n")).filter("n >= 5").orderBy(F.desc("n"), "component").limit(2)
    inside = stored(c.join(F.broadcast(top), "component").select(F.lower("node").alias("n"), "component").distinct(), "inside")
    found = [K.lexical(t, inside.filter(F.col("component") == r["component"]).select("n")) for r in top.collect()]  # two at most
    if not found:
        return t.select("subject", "object").limit(0)
    pairs = reduce(DataFrame.unionByName, found).select(F.least("subject", "object").alias("subject"), F.greatest("subject", "object").alias("object"))
    twice = inside.groupBy("n").count().filter("count > 1").count()  # names that another casing has in the other component too
    return pairs.distinct() if twice > 1 else pairs


QUERIES = {
    "kg_validate": (kg_validate, SQL + " SELECT array_to_string(list_filter([CASE WHEN trim(subject) = '' THEN 'subject' END, CASE WHEN trim(predicate) = '' THEN 'predicate' END, CASE WHEN trim(object) = '' THEN 'object' END], lambda x: x IS NOT NULL), ',') AS reasons, count(*) AS n FROM t GROUP BY 1"),
    "kg_validate3": (kg_validate3, SQL + " SELECT ord, CASE WHEN ord % 2 = 0 THEN subject_type ELSE 'Unknown' END AS subject_type FROM valid"),
    "kg_entity_details": (kg_entity_details, SQL + " SELECT name, array_to_string(casings, '|') AS casings, array_to_string(types, '|') AS types, mentions FROM details"),
    "kg_group_normalized": (lambda s, d: K.normal_groups(K.entity_details(valid(s, d))), SQL + GROUPS + " SELECT name, standard FROM groups"),
    "kg_type_compat": (kg_type_compat, SQL + ", k AS (SELECT DISTINCT types, array_to_string(types, '|') AS t FROM details) SELECT a.t, b.t AS u, (len(a.types) = 0 OR len(b.types) = 0 OR EXISTS (SELECT 1 FROM unnest(a.types) p(x), unnest(b.types) r(y) WHERE x = y OR " + ALLOWED + ")) AS compatible FROM k a JOIN k b ON a.t <= b.t"),
    "kg_merge_subset": (kg_merge_subset, SQL + MERGES.format("details") + " SELECT * FROM merges"),
    "kg_fixpoint": (kg_fixpoint, SQL + MERGES.format("details") + FIX + " SELECT * FROM ended"),
    "kg_apply_map": (kg_apply_map, SQL + GROUPS + " SELECT ord, a.standard AS subject, b.standard AS object FROM valid JOIN groups a ON a.name = lower(subject) JOIN groups b ON b.name = lower(object)"),
    "kg_standardize": (kg_standardize, SQL + STD + ", z AS (SELECT a.standard AS subject, b.standard AS object, ord, predicate, string_split(predicate, ' ') AS w FROM valid JOIN named a ON a.name = lower(subject) JOIN named b ON b.name = lower(object)) SELECT subject, " + LIMIT.format("w", "predicate") + " AS predicate, object, ord FROM z WHERE subject <> object"),
    "kg_unique_entities": (lambda s, d: valid(s, d).select(F.col("subject").alias("name")).union(valid(s, d).select("object")).distinct(), SQL + " SELECT subject AS name FROM valid UNION SELECT object FROM valid"),
    "kg_predicate_top": (lambda s, d: triples(s, d).groupBy("predicate").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "predicate").limit(5), SQL + " SELECT predicate, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5"),
    "kg_transitive": (lambda s, d: K.transitive(valid(s, d)), SQL + TRANSITIVE + " SELECT *, true AS inferred, 0.7::DOUBLE AS confidence FROM trans"),
    "kg_lexical": (lambda s, d: K.lexical(valid(s, d)), (SQL + LEXICAL + " SELECT *, true AS inferred, 0.4::DOUBLE AS confidence FROM lex")),
    "kg_dedupe": (kg_dedupe, SQL + " SELECT predicate, count(*) AS n, 0::BIGINT AS inferred, min(ord) AS first FROM (SELECT subject, predicate, object, min(ord) AS ord FROM valid GROUP BY 1, 2, 3) GROUP BY 1"),
    "kg_infer": (
        lambda s, d: K.infer(valid(s, d)).select("subject", "predicate", "object", "inferred"),
        (SQL + TRANSITIVE + LEXICAL + ", x AS (SELECT subject, predicate, object, false AS inferred FROM valid UNION SELECT subject, predicate, object, true FROM trans UNION SELECT subject, predicate, object, true FROM lex) SELECT subject, predicate, object, bool_and(inferred) AS inferred FROM x GROUP BY 1, 2, 3"),
    ),
    "kg_components": (kg_components, (SQL + UNDIRECTED + ", both_ AS (SELECT a, b FROM u UNION SELECT b, a FROM u), reach AS (SELECT a AS node, a AS c FROM both_ UNION SELECT b.a, r.c FROM reach r JOIN both_ b ON b.b = r.node WHERE r.c < b.a) SELECT node, min(c) AS component FROM reach GROUP BY 1")),
    "kg_degree": (lambda s, d: K.degree(K.undirected(valid(s, d))), SQL + DEGREE + " SELECT * FROM d"),
    "kg_node_size": (kg_node_size, None),
    "kg_louvain": (lambda s, d: K.communities(K.undirected(valid(s, d))), None),
    "kg_community_fallback": (lambda s, d: K.degree(K.undirected(valid(s, d))).select("node", (F.col("degree") % 8).alias("community")), SQL + DEGREE + " SELECT node, degree % 8 AS community FROM d"),
    "kg_betweenness": (lambda s, d: K.betweenness(K.undirected(valid(s, d))).select("node", F.round("betweenness", 6).alias("betweenness")), None),
    "kg_eigenvector": (lambda s, d: K.eigenvector(K.undirected(valid(s, d))).select("node", F.round("eigenvector", 6).alias("eigenvector")), None),
    "kg_graph_summary": (kg_graph_summary, (SQL + TRANSITIVE + LEXICAL + ", x AS (SELECT subject, predicate, object, false AS inferred FROM valid UNION SELECT subject, predicate, object, true FROM trans UNION SELECT subject, predicate, object, true FROM lex), y AS (SELECT subject, predicate, object, bool_and(inferred) AS inferred FROM x GROUP BY 1, 2, 3) SELECT (SELECT count(*) FROM (SELECT subject FROM y UNION SELECT object FROM y)) AS nodes, count(*) AS edges, count(*) FILTER (NOT inferred) AS original, count(DISTINCT CASE WHEN inferred THEN subject || chr(1) || object END) AS inferred_pairs FROM y")),
    "kg_infer_within_llm": (candidates_within, None),
    "kg_pipeline": (entry_summary, None),
    "kg_efficiency": (
        lambda s, d: valid(s, d).groupBy((F.col("ord") / 1000).cast("long").alias("chunk")).agg(F.count("*").alias("n")).agg(F.round(F.avg("n"), 6).alias("triples_per_chunk")),
        SQL + " SELECT round(avg(n), 6) AS triples_per_chunk FROM (SELECT ord // 1000 AS chunk, count(*) AS n FROM valid GROUP BY 1)",
    ),
    "synonym_map": (
        lambda s, d: table(s, d, "part").join(F.broadcast(s.createDataFrame([("small ring", "ring"), ("large ring", "ring")], "variant string, canonical string")), F.trim(F.lower("p_name")) == F.col("variant"), "left").select("p_partkey", F.coalesce("canonical", "p_name").alias("name")),
        "SELECT p_partkey, CASE trim(lower(p_name)) WHEN 'small ring' THEN 'ring' WHEN 'large ring' THEN 'ring' ELSE p_name END AS name FROM part",
    ),
}
