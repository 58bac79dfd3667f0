"""Organisations, persons and places of the business tables found in texts, besides dates and amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import gazetteer as G
from graphloom.sources.tables import table

#: Dates and amounts in texts (fixed patterns).
DATE, MONEY = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}", r"\$ ?[0-9][0-9,.]*"


def business_names(spark, sf) -> DataFrame:
    """label, name: suppliers are organisations, customers are persons, nations and regions are places."""
    t = lambda n, c, label: table(spark, sf, n).select(F.lit(label).alias("label"), F.col(c).alias("name"))
    return t("supplier", "s_name", "ORG").union(t("customer", "c_name", "PERSON")).union(t("nation", "n_name", "GPE")).union(t("region", "r_name", "GPE"))


def letters(spark, sf) -> DataFrame:
    """doc_id, text: each document with a heading that names a supplier, a customer, a nation and a date of an order of its number."""
    o, c, s, n = (table(spark, sf, x) for x in ("orders", "customer", "supplier", "nation"))
    first = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("l_suppkey"))
    named = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(first, F.col("o_orderkey") == F.col("l_orderkey"))
    named = named.join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    head = F.concat("s_name", F.lit(" to "), "c_name", F.lit(" ("), "n_name", F.lit("), "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(": $"), F.format_string("%.2f", "o_totalprice"), F.lit("\n"))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs.join(named.select(F.col("o_orderkey").alias("doc_id"), head.alias("head")), "doc_id", "left").select("doc_id", F.concat(F.coalesce("head", F.lit("")), "text").alias("text"))


LETTERS_SQL = """SELECT doc_id, coalesce(s_name || ' to ' || c_name || ' (' || n_name || '), ' || strftime(o_orderdate, '%Y-%m-%d') || ': $' || printf('%.2f', o_totalprice) || chr(10), '') || text AS text
FROM documents LEFT JOIN (orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey) ON o_orderkey = doc_id"""


def doc_entities_ner(spark, sf):
    """Per document: organisations, persons and places by name, each once in order of the alphabet, the place of the first name, dates and amounts."""
    docs = letters(spark, sf)
    found = G.tag(docs, business_names(spark, sf), "doc_id", "text")
    of = lambda label: F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("found", lambda x: x["label"] == label), lambda x: x["name"]))), "|")
    count = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("long")
    own = docs.select("doc_id", count(DATE).alias("dates"), count(MONEY).alias("amounts"))
    lists = found.select("doc_id", of("ORG").alias("orgs"), of("PERSON").alias("persons"), of("GPE").alias("places"), F.get("found", F.lit(0))["start"].cast("long").alias("first"))
    return own.join(lists, "doc_id")


NER_SQL = f"""
WITH l AS ({LETTERS_SQL}), n AS (SELECT 'ORG' AS label, s_name AS name FROM supplier UNION SELECT 'PERSON', c_name FROM customer UNION SELECT 'GPE', n_name FROM nation UNION SELECT 'GPE', r_name FROM region),
h AS (SELECT doc_id, label, name, instr(text, name) - 1 AS start FROM l JOIN n ON contains(text, name) WHERE regexp_matches(text, '(^|[^A-Za-z0-9_])' || name || '([^A-Za-z0-9_]|$)')),
g AS (SELECT doc_id, {", ".join(f"coalesce(string_agg(name, '|' ORDER BY name) FILTER (label = '{x}'), '') AS {c}" for x, c in (("ORG", "orgs"), ("PERSON", "persons"), ("GPE", "places")))}, min(start) AS first FROM h GROUP BY 1)
SELECT doc_id, coalesce(orgs, '') AS orgs, coalesce(persons, '') AS persons, coalesce(places, '') AS places, first, len(regexp_extract_all(text, '{DATE}')) AS dates, len(regexp_extract_all(text, '{MONEY}')) AS amounts FROM l LEFT JOIN g USING (doc_id)"""

QUERIES = {"doc_entities_ner": (doc_entities_ner, NER_SQL)}
