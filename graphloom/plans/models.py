"""Queries that ask outside models: stand-ins that answer by rules and fail by schedule, so that every row is defined."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import attempts as A
from graphloom.operators import plugins as G
from graphloom.operators import triples as K
from graphloom.plans.stores import TRIPLE
from graphloom.plans.text import CHUNKS_SQL, doc_chunk_words
from graphloom.plans.triples import DEGREE, SQL, valid
from graphloom.sources.tables import table

#: Names that a model is asked to resolve; words of a chunk that is cleaned; nodes that stand for a component, and triples that show their context.
TOP, CLEAN_WORDS, REPRESENTATIVES, CONTEXT = 100, 200, 5, 10
CHUNK = "array<struct<subject: string, predicate: string, object: string>>"


# --- stand-ins --------------------------------------------------------------------------
class Unsteady:
    """Answers by rule; texts whose length 3 divides get nonsense at the first attempt, those whose length 11 divides nothing at all."""

    name = "unsteady"

    def __init__(self, rule):
        self.rule = rule

    def answer_at(self, texts: list[str], attempt: int) -> list[str]:
        return ["" if len(t) % 11 == 0 else "Sorry, no." if attempt == 1 and len(t) % 3 == 0 else self.rule(t) for t in texts]


def triple_reply(text: str) -> str:
    rows = [dict(zip(("subject", "predicate", "object"), m)) for m in re.findall(TRIPLE, text)]
    return "Here they are:\n```json\n" + json.dumps(rows) + "\n```"


class Rule:
    """A model whose reply follows from its text."""

    def __init__(self, name: str, rule):
        self.name, self.rule = name, rule

    def answer(self, texts: list[str]) -> list[str]:
        return [self.rule(t) for t in texts]


def resolved(names: str) -> str:
    """Of the listed names, those that differ in digits only, each with the first of them."""
    groups: dict[str, list[str]] = {}
    for n in names.split("\n"):
        groups.setdefault(re.sub("[0-9#]+", "", n).strip(), []).append(n)
    return json.dumps({n: min(g) for g in groups.values() if len(g) > 1 for n in g})


def reviewed(text: str) -> str:
    sure = not re.search("the|que", text)
    return json.dumps({"valid": sure, "confidence": 0.8 if sure else 0.3})


def rated(text: str) -> str:
    return json.dumps({"quality": 0.3 if re.search("invalid|idiot|worthless", text) else 0.9 if "the" in text else 0.8})


# --- extraction and cleaning ----------------------------------------------------------------
def extracted(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Replies of the extractor for all chunks of all documents: accepted and rejected."""
    chunks = doc_chunk_words(spark, sf).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_text")
    return A.ask_again(chunks, ["doc_id", "chunk_index"], "chunk_text", Unsteady(triple_reply), A.triples_in)


def kg_extract_llm(spark, sf):
    """Whole triples of all chunks, with the attempt that brought them."""
    good, _ = extracted(spark, sf)
    rows = good.select("doc_id", "chunk_index", F.col("attempt").cast("long").alias("attempt"), F.explode(F.from_json("value", CHUNK)).alias("t"))
    return rows.select("doc_id", "chunk_index", "attempt", "t.*").distinct()


EXTRACT_SQL = f"""
SELECT DISTINCT doc_id, chunk_index, attempt, regexp_extract(t, '{TRIPLE}', 1) AS subject, regexp_extract(t, '{TRIPLE}', 2) AS predicate, regexp_extract(t, '{TRIPLE}', 3) AS object
FROM (SELECT doc_id, chunk_index, CASE WHEN length(chunk_text) % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS attempt, unnest(regexp_extract_all(chunk_text, '{TRIPLE}')) AS t FROM ({CHUNKS_SQL}) WHERE length(chunk_text) % 11 <> 0)"""


def kg_extract_rejects(spark, sf):
    """Rejected replies by reason and attempt."""
    _, bad = extracted(spark, sf)
    return bad.groupBy("reason", F.col("attempt").cast("long").alias("attempt")).agg(F.count("*").alias("n"))


REJECTS_SQL = f"""
WITH c AS (SELECT length(chunk_text) AS n, len(regexp_extract_all(chunk_text, '{TRIPLE}')) AS found FROM ({CHUNKS_SQL})),
r AS (SELECT CASE WHEN n % 11 = 0 THEN 'empty' WHEN n % 3 = 0 AND a = 1 THEN 'no json' WHEN found = 0 THEN 'no triples' END AS reason, a AS attempt FROM c CROSS JOIN (VALUES (1), (2)) v(a) WHERE a = 1 OR n % 11 = 0 OR n % 3 = 0 OR found = 0)
SELECT reason, attempt::BIGINT AS attempt, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1, 2"""


def sanitized(docs: DataFrame) -> DataFrame:
    """doc_id, text, method: texts cleaned by rule, in chunks by a model, and put together; chunks that the model fails on stay as they are by rule."""
    clean = docs.select("doc_id", X.clean_ocr(F.col("text")).alias("clean"))
    chunks = clean.select("doc_id", F.explode(X.chunks(F.col("clean"), CLEAN_WORDS)).alias("c")).select("doc_id", F.col("c.chunk_index").cast("long").alias("k"), F.col("c.chunk_text").alias("piece"))
    good, _ = A.ask_again(chunks, ["doc_id", "k"], "piece", Unsteady(lambda t: t.capitalize()), A.text_in)
    both = chunks.join(good.select("doc_id", "k", "value"), ["doc_id", "k"], "left")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("value", "piece").alias("t")))), lambda p: p["t"])
    whole = both.groupBy("doc_id").agg(F.array_join(parts, "\n").alias("text"), F.count("value").alias("done"), F.count("*").alias("all"))
    method = F.when(F.col("done") == F.col("all"), "model").when(F.col("done") > 0, "mixed").otherwise("rules")
    return clean.select("doc_id").join(whole, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(method, F.lit("rules")).alias("method"))


# --- names and replies ----------------------------------------------------------------------
def kg_llm_resolve(spark, sf):
    """Triples whose ends are renamed as a model resolves the TOP most mentioned names; triples that become loops go."""
    t = valid(spark, sf)
    top = [r["name"] for r in K.entity_details(t).orderBy(F.desc("mentions"), "name").limit(TOP).select("name").collect()]  # bounded by TOP
    mapping = json.loads(Rule("resolver", resolved).answer(["\n".join(sorted(top))])[0])
    names = F.broadcast(spark.createDataFrame(sorted(mapping.items()), "variant string, canonical string"))  # TOP rows at most
    for end in ("subject", "object"):
        t = t.join(names, F.lower(end) == F.col("variant"), "left").withColumn(end, F.coalesce("canonical", end)).drop("variant", "canonical")
    return t.filter("subject <> object").select("ord", "subject", "predicate", "object")


RESOLVE_SQL = SQL + f""", top AS (SELECT name, trim(regexp_replace(name, '[0-9#]+', '', 'g')) AS k FROM details ORDER BY mentions DESC, name LIMIT {TOP}),
m AS (SELECT name, min(name) OVER (PARTITION BY k) AS canonical FROM top QUALIFY count(*) OVER (PARTITION BY k) > 1)
SELECT ord, subject, predicate, object FROM (SELECT ord, coalesce(a.canonical, subject) AS subject, predicate, coalesce(b.canonical, object) AS object FROM valid LEFT JOIN m a ON a.name = lower(subject) LEFT JOIN m b ON b.name = lower(object)) WHERE subject <> object"""


def kg_infer_cross_llm(spark, sf):
    """Pairs of the three largest components as a model gets them: the nodes of most edges of each, the first triples about these, and the relation that it gives their first nodes."""
    t = valid(spark, sf)
    pairs = K.undirected(t)
    member = K.components(pairs)
    top = member.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(3)
    ranked = K.degree(pairs).join(member.join(F.broadcast(top), "component"), "node")  # three rows
    rank = F.row_number().over(K.Window.partitionBy("component").orderBy(F.desc("degree"), "node"))
    reps = ranked.withColumn("k", rank).filter(F.col("k") <= REPRESENTATIVES).select("component", "node", "k")
    listed = reps.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "node"))), lambda x: x["node"]).alias("names"))
    about = t.join(reps, (F.col("subject") == F.col("node")) | (F.col("object") == F.col("node"))).select("component", "ord", F.concat_ws(" ", "subject", "predicate", "object").alias("fact")).distinct()
    order = F.row_number().over(K.Window.partitionBy("component").orderBy("ord"))
    shown = about.withColumn("k", order).filter(F.col("k") <= CONTEXT).groupBy("component").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "fact"))), lambda x: x["fact"]), "; ").alias("context"))
    each = listed.join(shown, "component", "left")
    two = each.select(F.col("component").alias("other"), F.col("names").alias("other_names"), F.col("context").alias("other_context"))
    both = each.join(two, F.col("component") < F.col("other"))  # three rows
    prompt = F.concat_ws("\n", F.get("names", F.lit(0)), F.get("other_names", F.lit(0)))
    reply = G.ask(prompt, [Rule("relater", lambda p: json.dumps([dict(zip(("subject", "object"), p.split("\n")), predicate="associated with")]))])["answer"]
    said = F.from_json(reply, CHUNK)[0]
    return both.select("component", "other", F.array_join("names", "|").alias("names"), F.array_join("other_names", "|").alias("other_names"), "context", "other_context", said["subject"].alias("subject"), said["predicate"].alias("predicate"), said["object"].alias("object"))


CROSS_SQL = SQL + DEGREE + f""", both_ AS (SELECT a, b FROM u UNION SELECT b, a FROM u), reach AS (SELECT a AS node, a AS c FROM both_ UNION SELECT b.a, r.c FROM reach r JOIN both_ b ON b.b = r.node WHERE r.c < b.a),
member AS (SELECT node, min(c) AS component FROM reach GROUP BY 1), top AS (SELECT component FROM member GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3),
reps AS (SELECT * FROM (SELECT component, node, row_number() OVER (PARTITION BY component ORDER BY degree DESC, node) AS k FROM d JOIN member USING (node) JOIN top USING (component)) WHERE k <= {REPRESENTATIVES}),
names AS (SELECT component, string_agg(node, '|' ORDER BY k) AS names, min_by(node, k) AS first FROM reps GROUP BY 1),
about AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY ord) AS k FROM (SELECT DISTINCT component, ord, concat_ws(' ', subject, predicate, object) AS fact FROM valid JOIN reps ON subject = node OR object = node)),
x AS (SELECT names.*, (SELECT string_agg(fact, '; ' ORDER BY k) FROM about WHERE about.component = names.component AND k <= {CONTEXT}) AS context FROM names)
SELECT a.component, b.component AS other, a.names, b.names AS other_names, a.context, b.context AS other_context, a.first AS subject, 'associated with' AS predicate, b.first AS object FROM x a JOIN x b ON a.component < b.component"""


def reply_number(text, model: Rule, field: str):
    """A number of the model's JSON reply."""
    return F.get_json_object(G.ask(text, [model])["answer"], f"$.{field}").cast("double")


def kg_llm_validate(spark, sf):
    """Confidence of a model in each message."""
    return table(spark, sf, "conversations").select("conv_id", "turn", reply_number(F.lower("text"), Rule("reviewer", reviewed), "confidence").alias("confidence"))


def kg_quality_reply(spark, sf):
    """Quality of each message in a model's reply."""
    return table(spark, sf, "conversations").select("conv_id", "turn", reply_number(F.lower("text"), Rule("rater", rated), "quality").alias("score"))


def kg_llm_enrich(spark, sf):
    """A model's line on each supplier that has a balance; no line, no enrichment."""
    asked = F.when(F.col("s_acctbal") > 0, F.col("s_name"))
    said = G.ask(asked, [Rule("writer", lambda t: f"About {t}" if t else "")])["answer"]
    return table(spark, sf, "supplier").select("s_suppkey", said.alias("enrichment"), said.isNotNull().alias("enriched"))


#: Characters from which a document's own text is enough.
ENOUGH = 50


def doc_extract(spark, sf):
    """Documents with enough text as they are; the others by a reader of images, which here sees the same text."""
    d = table(spark, sf, "documents").withColumn("own", F.length(F.trim("text")) >= ENOUGH)
    read = G.ask(F.when(~F.col("own"), F.col("text")), [G.Silent(), G.Echo()])["answer"]
    way = F.when(F.col("own"), "text").when(read.isNotNull(), "image").otherwise("none")
    return d.select("doc_id", way.alias("way"), F.length(F.coalesce(F.when(F.col("own"), F.col("text")), read, F.lit(""))).cast("long").alias("chars"))


def txt_sanitize_llm(spark, sf):
    return sanitized(table(spark, sf, "documents"))


QUERIES = {
    "kg_extract_llm": (kg_extract_llm, EXTRACT_SQL),
    "kg_extract_rejects": (kg_extract_rejects, REJECTS_SQL),
    "txt_sanitize_llm": (txt_sanitize_llm, None),
    "kg_llm_resolve": (kg_llm_resolve, RESOLVE_SQL),
    "kg_infer_cross_llm": (kg_infer_cross_llm, CROSS_SQL),
    "kg_llm_validate": (kg_llm_validate, "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'the|que') THEN 0.3 ELSE 0.8 END::DOUBLE AS confidence FROM conversations"),
    "kg_quality_reply": (kg_quality_reply, "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'invalid|idiot|worthless') THEN 0.3 WHEN contains(lower(text), 'the') THEN 0.9 ELSE 0.8 END::DOUBLE AS score FROM conversations"),
    "kg_llm_enrich": (kg_llm_enrich, "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN 'About ' || s_name END AS enrichment, s_acctbal > 0 AS enriched FROM supplier"),
    "doc_extract": (doc_extract, f"SELECT doc_id, CASE WHEN length(trim(text)) >= {ENOUGH} THEN 'text' WHEN trim(text) <> '' THEN 'image' ELSE 'none' END AS way, CASE WHEN trim(text) <> '' THEN length(text) ELSE 0 END::BIGINT AS chars FROM documents"),
}
