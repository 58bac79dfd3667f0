"""The smaller queries of the inventory: links, mappings, replies, hints, audit inserts and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import chunkers as C
from graphloom.functions import questions as Q
from graphloom.functions import text as X
from graphloom.operators import operations as O
from graphloom.operators import plugins as G
from graphloom.plans.operations import CLASS_SQL, FILES_SQL, JOBS_SQL, STATUS_SQL, files, jobs
from graphloom.plans.questions import GENERATED_SQL, QUESTIONS_SQL, SELECT_SQL, generated, q_select_pattern, questions
from graphloom.plans.text import q
from graphloom.sources.store import edges, nodes
from graphloom.sources.tables import GRAPH_SQL, table

# --- fixed values: words of industries, roles of labels and of edge types ---
INDUSTRIES = {
    "logistics": ["shipment", "delivery", "transport", "warehouse", "cargo", "logistics", "freight", "distribution", "supply", "route"],
    "utilities": ["power", "electricity", "grid", "utility", "energy", "transmission", "substation", "transformer", "meter", "consumption"],
    "maintenance": ["workorder", "equipment", "part", "technician", "inspection"],
}
ROLES = {"person": ["person", "technician", "manager"], "asset": ["equipment", "part"], "work": ["workorder", "task"], "place": ["location", "site"], "money": ["cost", "value", "invoice"]}
EDGE_ROLES = {"assignment": ["ASSIGNED", "MANAGED", "APPROVED"], "place": ["LOCATED", "CONTAINS", "PERFORMED_AT", "SCHEDULED_AT"], "cost": ["COST"], "time": ["COMPLETED", "SCHEDULED_FOR"], "use": ["USED", "PERFORMED_ON", "PROVIDES"]}


def docs(spark, sf):
    return table(spark, sf, "documents")


def role(c, roles):
    return F.coalesce(*[F.when(X.any_of(c, w), F.lit(r)) for r, w in roles.items()], F.lit("entity"))


def role_sql(c, roles):
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({c}, {q(x)})" for x in w) + f" THEN {q(r)}" for r, w in roles.items()) + " ELSE 'entity' END"


def q_industry(spark, sf):
    """The industry whose words occur most among labels and edge types."""
    words = nodes(spark, sf).select(F.explode("labels").alias("w")).distinct().union(edges(spark, sf).select("type").distinct()).select(F.lower("w").alias("w"))
    scores = words.agg(*[F.greatest(F.lit(0), sum_of(w)).alias(k) for k, w in INDUSTRIES.items()])
    long = scores.select(F.explode(F.create_map(*[x for k in INDUSTRIES for x in (F.lit(k), F.col(k))])).alias("industry", "score"))
    return long.orderBy(F.desc("score"), "industry").limit(1).select(F.when(F.col("score") > 0, F.col("industry")).otherwise("generic").alias("industry"))


def sum_of(terms):
    total = F.lit(0)
    for t in terms:
        total = total + F.max(F.col("w").contains(t).cast("int"))
    return total


def g_doc_summary(spark, sf):
    """Per document: chunks, words, mentions."""
    lines = docs(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.size(X.words(F.col("line")))).alias("words"), F.sum(F.size(F.regexp_extract_all("line", F.lit("[A-Z][a-z]{3,}"), 0))).alias("mentions"))


def q_parse_examples(spark, sf):
    """Question and query pairs read from a text of 'Question:' and 'Cypher:' lines."""
    block = generated(spark, sf).join(questions(spark, sf), "qid").select("qid", F.concat(F.lit("Question: "), "question", F.lit("\nCypher: "), "query", F.lit("\n")).alias("b"))
    return block.select("qid", F.regexp_extract("b", r"Question: ([^\n]*)", 1).alias("question"), F.regexp_extract("b", r"Cypher: ([^\n]*)", 1).alias("query"))


def q_context(spark, sf):
    """Facts of a work order as lines of text, at most fifteen."""
    e = edges(spark, sf).filter("src = 'wo:7'").join(nodes(spark, sf).select(F.col("id").alias("dst"), "name"), "dst")
    return e.select(F.concat_ws(" ", F.lit("WO-7"), F.lower(F.replace("type", F.lit("_"), F.lit(" "))), "name").alias("fact")).distinct().orderBy("fact").limit(15)


LABELS = "SELECT DISTINCT unnest(labels) AS label FROM nodes"
CUT = 2000


def schema_truncate(spark, sf):
    """Texts cut at CUT characters, back to the last line end if that is beyond 80 % of them."""
    head = F.left("text", F.lit(CUT))
    end = F.length(head) - F.length(F.substring_index(head, "\n", -1)) - 1
    cut = F.when(end > 0.8 * CUT, F.left(head, end)).otherwise(head)
    return docs(spark, sf).select("doc_id", F.when(F.length("text") <= CUT, F.col("text")).otherwise(cut).alias("text"))


#: Ways in which replies spoil JSON: what comes before, the key, what comes after.
SPOILT = [("", '"k"', ",}"), ("Answer: ", "'k'", "}"), ("", "k", ", }"), ("", '"k"', ', "rest": "cut of'), ("```json\n", '"k"', ', "half'), ("", "\u201ck\u201d", ", \u201cnote\u201d: [1, 2")]


def json_fix(spark, sf):
    """Properties spoilt in six ways and repaired."""
    value = F.get_json_object("props", "$.k")
    spoilt = [F.concat(F.lit(before + "{" + key + ": "), value, F.lit(after)) for before, key, after in SPOILT]
    e = table(spark, sf, "events").select("event_id", F.get(F.array(*spoilt), (F.col("event_id") % len(SPOILT)).cast("int")).alias("spoilt"))
    return e.select("event_id", F.get_json_object(C.json_extract(F.col("spoilt")), "$.k").cast("long").alias("k"))


QUERIES = {
    "src_sqlite": (lambda s, d: files(s, d).filter("status = 'Failed'").select("event_id", "file_name"), f"SELECT event_id, file_name FROM {FILES_SQL} WHERE status = 'Failed'"),
    "src_pg": (lambda s, d: table(s, d, "conversations").filter("role = 'user'").select("conv_id", "turn"), "SELECT conv_id, turn FROM conversations WHERE role = 'user'"),
    "txt_coref": (lambda s, d: docs(s, d).select("doc_id", F.sha2(F.coalesce(G.ask(F.col("text"), [G.Echo()])["answer"], F.lit("")), 256).alias("hash")), "SELECT doc_id, sha256(CASE WHEN trim(text) = '' THEN '' ELSE text END) AS hash FROM documents"),
    "json_fix": (json_fix, "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events"),
    "schema_truncate": (schema_truncate, f"SELECT doc_id, CASE WHEN length(text) <= {CUT} THEN text WHEN e > {0.8 * CUT} THEN left(text, e) ELSE left(text, {CUT}) END AS text FROM (SELECT doc_id, text, {CUT} - instr(reverse(left(text, {CUT})), chr(10)) AS x, CASE WHEN contains(left(text, {CUT}), chr(10)) THEN {CUT} - instr(reverse(left(text, {CUT})), chr(10)) ELSE -1 END AS e FROM documents)"),
    "g_doc_summary": (g_doc_summary, "SELECT doc_id, count(*) AS chunks, sum(len(list_filter(regexp_split_to_array(line, '[ \\t\\n\\r\\v\\f]+'), lambda w: w <> '')))::BIGINT AS words, sum(len(regexp_extract_all(line, '[A-Z][a-z]{3,}')))::BIGINT AS mentions FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1"),
    "q_confidence": (
        lambda s, d: generated(s, d).select("qid", F.round(0.3 * F.when(F.size(Q.query_warnings(F.col("query"))) == 0, 1.0).otherwise(0.7) + 0.25 + 0.2 * F.when(F.length("query") > 50, 1.0).otherwise(0.5) + 0.15 * 0.9 + 0.1 * (1 - Q.query_complexity(F.col("query"))), 6).alias("confidence")),
        f"SELECT qid, round((0.3 * CASE WHEN contains(u, 'LIMIT') THEN 1.0 ELSE 0.7 END + 0.25 + 0.2 * CASE WHEN length(query) > 50 THEN 1.0 ELSE 0.5 END + 0.15 * 0.9 + 0.1 * (1 - least(1.0, 0.1 * len(regexp_extract_all(u, 'MATCH')) + 0.05 * len(regexp_extract_all(u, '\\bAND\\b|\\bOR\\b')) + 0.05 * len(regexp_extract_all(u, 'COLLECT|COUNT')))))::DOUBLE, 6) AS confidence FROM (SELECT qid, query, upper(query) AS u FROM ({GENERATED_SQL}))",
    ),
    "q_industry": (q_industry, GRAPH_SQL + f", w AS (SELECT lower(label) AS w FROM ({LABELS}) UNION SELECT lower(type) FROM edges), k AS (SELECT * FROM (VALUES " + ", ".join(f"({q(k)}, {q(t)})" for k, ts in INDUSTRIES.items() for t in ts) + ") v(industry, term)), s AS (SELECT industry, sum((EXISTS (SELECT 1 FROM w WHERE contains(w.w, term)))::INT) AS score FROM k GROUP BY 1) SELECT CASE WHEN score > 0 THEN industry ELSE 'generic' END AS industry FROM s ORDER BY score DESC, industry LIMIT 1"),
    "q_label_mapping": (lambda s, d: nodes(s, d).select(F.explode("labels").alias("label")).distinct().select("label", role(F.lower("label"), ROLES).alias("role")), GRAPH_SQL + f" SELECT label, {role_sql('lower(label)', ROLES)} AS role FROM ({LABELS})"),
    "q_rel_mapping": (lambda s, d: edges(s, d).select("type").distinct().select("type", role(F.col("type"), EDGE_ROLES).alias("role")), GRAPH_SQL + f" SELECT type, {role_sql('type', EDGE_ROLES)} AS role FROM (SELECT DISTINCT type FROM edges)"),
    "q_domain_hints": (lambda s, d: questions(s, d).select("qid", F.array_join(F.array_compact(F.array(F.when(X.any_of(F.lower("question"), ["work order", "task"]), F.lit("use WorkOrder")), F.when(F.lower("question").contains("how many"), F.lit("count")), F.when(F.lower("question").contains("history"), F.lit("order by date")))), ", ").alias("hints")), f"SELECT qid, array_to_string(list_filter([CASE WHEN contains(lower(question), 'work order') OR contains(lower(question), 'task') THEN 'use WorkOrder' END, CASE WHEN contains(lower(question), 'how many') THEN 'count' END, CASE WHEN contains(lower(question), 'history') THEN 'order by date' END], lambda x: x IS NOT NULL), ', ') AS hints FROM {QUESTIONS_SQL}"),
    "q_context": (q_context, GRAPH_SQL + " SELECT DISTINCT 'WO-7 ' || lower(replace(type, '_', ' ')) || ' ' || name AS fact FROM edges JOIN nodes ON id = dst WHERE src = 'wo:7' ORDER BY 1 LIMIT 15"),
    "q_parse_examples": (q_parse_examples, f"SELECT qid, question, query FROM ({GENERATED_SQL}) JOIN {QUESTIONS_SQL} USING (qid)"),
    "q_correct": (lambda s, d: generated(s, d).select("qid", F.when(F.array_contains(Q.query_warnings(F.col("query")), "no LIMIT"), F.concat("query", F.lit(" LIMIT 25"))).otherwise(F.col("query")).alias("query")), f"SELECT qid, CASE WHEN contains(upper(query), 'LIMIT') THEN query ELSE query || ' LIMIT 25' END AS query FROM ({GENERATED_SQL})"),
    "q_cache": (lambda s, d: questions(s, d).select("qid", F.md5(F.concat(F.lower(F.trim("question")), F.lit("_5"))).alias("key")), f"SELECT qid, md5(lower(trim(question)) || '_5') AS key FROM {QUESTIONS_SQL}"),
    "q_store_result": (lambda s, d: q_select_pattern(s, d).filter("score >= 0.9").select("qid", "pattern"), f"SELECT qid, pattern FROM ({SELECT_SQL}) WHERE score >= 0.9"),
    "q_add_example": (lambda s, d: q_select_pattern(s, d).groupBy("pattern").agg(F.min("qid").alias("qid")), f"SELECT pattern, min(qid) AS qid FROM ({SELECT_SQL}) GROUP BY 1"),
    "q_fewshot_generate": (lambda s, d: generated(s, d).join(questions(s, d), "qid").select("qid", F.concat_ws("\n", F.concat(F.lit("Q: "), "question"), F.concat(F.lit("A: "), "query")).alias("example")), f"SELECT qid, 'Q: ' || question || chr(10) || 'A: ' || query AS example FROM ({GENERATED_SQL}) JOIN {QUESTIONS_SQL} USING (qid)"),
    "q_domain_context": (lambda s, d: edges(s, d).groupBy(role(F.col("type"), EDGE_ROLES).alias("role")).agg(F.count_distinct("type").alias("types"), F.count("*").alias("edges")), GRAPH_SQL + f" SELECT {role_sql('type', EDGE_ROLES)} AS role, count(DISTINCT type) AS types, count(*) AS edges FROM edges GROUP BY 1"),
    "doc_batch_ocr": (lambda s, d: docs(s, d).select("source", G.ask(F.col("text"), [G.Silent(), G.Echo()])["method"].alias("m")).groupBy("source").agg(F.count("*").alias("files"), F.count("m").alias("succeeded")), "SELECT source, count(*) AS files, count(*) FILTER (trim(text) <> '') AS succeeded FROM documents GROUP BY 1"),
    "a_file_start": (lambda s, d: files(s, d).groupBy("job_id", "file_name").agg(F.min("ts").alias("started")).withColumn("status", F.lit("Processing")), f"SELECT job_id, file_name, min(ts) AS started, 'Processing' AS status FROM {FILES_SQL} GROUP BY 1, 2"),
    "a_job_update": (lambda s, d: O.with_updates(jobs(s, d).select("job_id", F.lit("Running").alias("status"), "files"), jobs(s, d).filter("failed > 0").select("job_id", O.job_status(F.col("done"), F.col("failed")).alias("status")), "job_id"), f"SELECT job_id, CASE WHEN failed > 0 THEN {STATUS_SQL} ELSE 'Running' END AS status, files FROM {JOBS_SQL}"),
    "a_failed_files": (lambda s, d: files(s, d).filter("error is not null").select("event_id", O.failure_class(F.col("error")).alias("failure")), f"SELECT event_id, {CLASS_SQL} AS failure FROM {FILES_SQL} WHERE error IS NOT NULL"),
    "c_title": (lambda s, d: table(s, d, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t")).select("conv_id", X.title(F.col("t")).alias("title")), "SELECT conv_id, CASE WHEN length(t) > 50 THEN left(t, 47) || '...' ELSE t END AS title FROM (SELECT conv_id, coalesce(array_to_string((list_filter(regexp_split_to_array(arg_min(text, turn), '[ \\t\\n\\r\\v\\f]+'), lambda w: w <> ''))[1:6], ' '), '') AS t FROM conversations WHERE role = 'user' GROUP BY 1)"),
}
