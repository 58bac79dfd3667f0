"""Queries over documents, pages and names: metadata, quality, classes, entities, chunks and clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.sources.tables import table



def T():
    return F.col("text")


#: Stand-ins for what the tables don't hold: a file name and a provider per document.
def FILE():
    return F.concat_ws("_", F.when(F.col("doc_id") % 3 == 0, "wo").when(F.col("doc_id") % 3 == 1, "Invoice").otherwise("scan"), F.col("doc_id").cast("string"))


FILE_SQL = "(CASE WHEN doc_id % 3 = 0 THEN 'wo' WHEN doc_id % 3 = 1 THEN 'Invoice' ELSE 'scan' END || '_' || doc_id)"
def METHOD():
    return F.when(F.col("doc_id") % 4 == 0, "gemini").when(F.col("doc_id") % 4 == 1, "mistral").otherwise("other")


METHOD_SQL = "(CASE WHEN doc_id % 4 = 0 THEN 'gemini' WHEN doc_id % 4 = 1 THEN 'mistral' ELSE 'other' END)"
def CONFIDENCE():
    return F.when(F.col("doc_id") % 5 == 0, 0.65).otherwise(0.9)


CONFIDENCE_SQL = "(CASE WHEN doc_id % 5 = 0 THEN 0.65 ELSE 0.9 END)::DOUBLE"
#: Words of the corpus in the roles of type indicators, so that the classifier has hits.
CORPUS_TYPES = {"english": ["the ", "and", "that"], "german": ["und", "der", "die"], "french": ["et", "les", "une"], "spanish": ["que", "los", "ción"]}
#: The same, as they read in ASCII, for the special characters of quality().
ASCII_SPECIAL = r"[^A-Za-z0-9_ \t\n\r.,!?;:\-()\"']"

W = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\v\\f]+'), lambda w: w <> '')"
LINES = "string_split(text, chr(10))"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def docs(spark, sf):
    return table(spark, sf, "documents")


def select(column):
    return lambda spark, sf: docs(spark, sf).select("doc_id", column())


def struct(name, column, *rounded):
    def run(spark, sf):
        d = docs(spark, sf).select("doc_id", column().alias("s")).select("doc_id", "s.*")
        d = d.select(*[F.round(c, 6).alias(c) if c in rounded else F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in d.dtypes])
        return d

    return run


def class_sql(types: dict) -> str:
    score = lambda terms: "(" + " + ".join(f"contains(lower(text), {q(t)})::INT" for t in terms) + f" + CASE WHEN {' OR '.join(f'contains(lower({FILE_SQL}), {q(t)})' for t in terms[:3])} THEN 2 ELSE 0 END)"
    union = " UNION ALL ".join(f"SELECT doc_id, {i} AS o, {q(t)} AS t, {score(terms)} AS s, len({W}) AS n FROM documents" for i, (t, terms) in enumerate(types.items()))
    return (
        f"WITH c AS ({union}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, o) AS k FROM c) "
        "SELECT doc_id, CASE WHEN s = 0 THEN 'unknown' ELSE t END AS document_type, round(CASE WHEN s = 0 THEN 0.0 ELSE least(s / greatest(n / 100.0, 1.0), 1.0) END::DOUBLE, 6) AS classification_confidence FROM r WHERE k = 1"
    )


CLASS_SQL = class_sql(X.TYPE_INDICATORS)
CATEGORY_SQL = "CASE document_type " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in X.CATEGORIES.items()) + " ELSE 'general' END"
QUALITY_SQL = f"""
WITH a AS (SELECT doc_id, text, {CONFIDENCE_SQL} AS c, {W} AS w, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(regexp_replace(s, '[ \\t\\n\\r\\v\\f]+', ' ', 'g'))), lambda s: s <> '') AS z FROM documents),
b AS (SELECT *, len(w) AS n, len(z) AS ns, coalesce(list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / nullif(len(w), 0), 0.0) AS awl,
  coalesce(list_sum(list_transform(z, lambda x: len(string_split(x, ' '))))::DOUBLE / nullif(len(z), 0), 0.0) AS asl FROM a),
d AS (SELECT *, list_filter([CASE WHEN c < 0.7 THEN 'low_ocr_confidence' END, CASE WHEN awl < 3 THEN 'short_words' END, CASE WHEN n < 10 THEN 'insufficient_text' END,
  CASE WHEN regexp_matches(text, '[^A-Za-z0-9_ \\t\\n\\r.,!?;:\\-()"'']') THEN 'special_characters' END, CASE WHEN ns < 2 THEN 'few_sentences' END], lambda x: x IS NOT NULL) AS i FROM b)
SELECT doc_id, round(CASE WHEN n = 0 THEN 0.0 ELSE greatest(0.0, (c + least(n / 100.0, 1.0) + least(awl / 5.0, 1.0) + (1 - 0.15 * len(i))) / 4) END::DOUBLE, 6) AS quality_score,
 round(CASE WHEN n = 0 THEN 0.0 ELSE least(greatest(206.835 - 1.015 * asl - 84.6 * (awl / 4.7), 0.0), 100.0) END::DOUBLE, 6) AS readability_score,
 CASE WHEN n = 0 THEN 'unknown' WHEN asl > 20 AND awl > 5 THEN 'high' WHEN asl > 15 OR awl > 4 THEN 'medium' ELSE 'low' END AS complexity,
 round(awl, 6) AS avg_word_length, round(asl, 6) AS avg_sentence_length, CASE WHEN n = 0 THEN 'empty_text' ELSE array_to_string(i, ',') END AS issues, n AS word_count, ns AS sentence_count FROM d"""
QUICK_SQL = (
    "WITH a AS (SELECT doc_id, text, (" + " + ".join(f"regexp_matches(text, '(?i){p}')::INT" for p in X.QUICK_INDICATORS) + ") >= 3 AS financial, "
    "regexp_matches(text, '(?m)^\\s*\\|.*\\|.*\\|') OR length(text) - length(replace(text, chr(9), '')) > 5 AS tables, "
    + " OR ".join(f"regexp_matches(text, '{p}')" for p in X.HAND_ASCII)
    + f" AS handwriting, list_filter({LINES}, lambda x: trim(x) <> '') AS l FROM documents) "
    "SELECT doc_id, round(least(greatest(CASE WHEN length(text) > 50 THEN 0.3 ELSE 0 END + CASE WHEN financial THEN 0.3 ELSE 0 END + CASE WHEN tables THEN 0.2 ELSE 0 END - CASE WHEN handwriting THEN 0.1 ELSE 0 END "
    "+ CASE WHEN coalesce(list_sum(list_transform(l, lambda x: length(x)))::DOUBLE / nullif(len(l), 0), 0) > 20 THEN 0.2 ELSE 0 END, 0.0), 1.0)::DOUBLE, 6) AS text_quality_score, financial, tables, handwriting FROM a"
)
CHUNK_SIZE = 50
CHUNKS_SQL = f"SELECT doc_id, (s // {CHUNK_SIZE})::BIGINT AS chunk_index, array_to_string(w[s + 1 : s + {CHUNK_SIZE}], ' ') AS chunk_text, s::BIGINT AS start_word, least(s + {CHUNK_SIZE}, len(w))::BIGINT AS end_word, (least(s + {CHUNK_SIZE}, len(w)) - s)::BIGINT AS word_count FROM (SELECT doc_id, w, unnest(range(0, len(w), {CHUNK_SIZE})) AS s FROM (SELECT doc_id, {W} AS w FROM documents))"


def doc_chunk_words(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(X.chunks(T(), CHUNK_SIZE)).alias("c")).select("doc_id", "c.*")


def doc_assess(spark, sf):
    d = docs(spark, sf).select("doc_id", T(), X.quick_quality(T(), 50, X.HAND_ASCII)["text_quality_score"].alias("s"))
    c = F.round(X.assessment(F.length(T()) > 0, F.length(T()), F.col("s"), F.size(X.words(T()))), 6)
    return d.select("doc_id", c.alias("confidence")).withColumn("recommendation", X.recommendation(F.col("confidence")))


def entity_rows(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(X.entities(T())).alias("entity_type", "names")).select("doc_id", "entity_type", F.array_join("names", "|").alias("names"))


ENTITIES_SQL = " UNION ALL ".join(
    "SELECT * FROM (SELECT doc_id, {} AS entity_type, array_to_string(list_sort(list_distinct(list_transform({}, lambda x: trim(x))))[1:10], '|') AS names FROM documents) WHERE names <> ''".format(
        q(k), "list_concat(" + ", ".join(f"regexp_extract_all(text, {q('(?i)' + p)})" for p in ps) + ")" if len(ps) > 1 else ""
    )
    for k, ps in X.ENTITY_PATTERNS.items()
)
FIELDS_SQL = "SELECT doc_id, " + ", ".join(f"nullif(trim(regexp_extract(text, {q(p)}, 1)), '') AS {k}" for k, p in X.FIELD_PATTERNS.items()) + " FROM documents"
PREDICATES = "SELECT DISTINCT lower(c_mktsegment || ' of the ' || o_orderpriority || ' in a ' || o_orderstatus) AS p FROM orders JOIN customer ON o_custkey = c_custkey UNION SELECT DISTINCT p_type || ' of' FROM part UNION SELECT DISTINCT p_brand || ' made for the ' || p_type FROM part"


def predicates(spark, sf):
    o, c, p = (table(spark, sf, n) for n in ("orders", "customer", "part"))
    a = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.lower(F.concat("c_mktsegment", F.lit(" of the "), "o_orderpriority", F.lit(" in a "), "o_orderstatus")).alias("p"))
    return a.union(p.select(F.concat("p_type", F.lit(" of")))).union(p.select(F.concat("p_brand", F.lit(" made for the "), "p_type"))).distinct()


STOPS = ", ".join(map(q, X.PREDICATE_STOPS))
NSTOPS = ", ".join(map(q, X.NAME_STOPS))


def names(spark, sf):
    p, s = table(spark, sf, "part"), table(spark, sf, "supplier")
    return p.select(F.concat(F.lit("The "), F.initcap("p_name"), F.lit(" of "), "p_brand", F.lit(", Ltd.")).alias("name")).union(s.select(F.concat("s_name", F.lit(" (Corp)")))).distinct()


NAMES_SQL = "(SELECT DISTINCT 'The ' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') || ' of ' || p_brand || ', Ltd.' AS name FROM part UNION SELECT s_name || ' (Corp)' FROM supplier)"


def pages_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.strip_tags(F.col("html")).alias("text"))


def page_meta(spark, sf):
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", F.sha2(h, 256).alias("file_hash"), F.octet_length(h).cast("long").alias("file_size_bytes"), F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1)).alias("file_extension"))


def kg_from_doc(spark, sf):
    """Edges of a document's parts: entity appears in document, entity mentioned in chunk, document contains chunk."""
    d = docs(spark, sf)
    e = d.select("doc_id", F.explode(F.flatten(F.map_values(X.entities(T())))).alias("entity")).distinct()
    c = d.select("doc_id", F.explode(X.chunks(T(), CHUNK_SIZE)).alias("c")).select("doc_id", "c.chunk_index", "c.chunk_text")
    doc = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    chunk = F.concat(doc, F.lit("_chunk_"), F.col("chunk_index").cast("string"))
    inside = e.join(c, "doc_id").filter(F.lower("chunk_text").contains(F.lower("entity")))
    out = e.select(F.col("entity").alias("subject"), F.lit("appears_in").alias("predicate"), doc.alias("object"))
    out = out.union(inside.select("entity", F.lit("mentioned_in_chunk"), chunk)).union(c.select(doc, F.lit("contains_chunk"), chunk))
    return out.groupBy("predicate").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("subjects"), F.count_distinct("object").alias("objects"))


ENT = "SELECT DISTINCT doc_id, unnest(string_split(names, '|')) AS entity FROM (" + ENTITIES_SQL + ")"
KG_FROM_DOC_SQL = (
    f"WITH e AS ({ENT}), c AS ({CHUNKS_SQL}), t AS (SELECT entity AS s, 'appears_in' AS predicate, 'doc_' || doc_id AS o FROM e UNION ALL SELECT entity, 'mentioned_in_chunk', 'doc_' || e.doc_id || '_chunk_' || chunk_index FROM e JOIN c ON e.doc_id = c.doc_id AND contains(lower(chunk_text), lower(entity)) "
    "UNION ALL SELECT 'doc_' || doc_id, 'contains_chunk', 'doc_' || doc_id || '_chunk_' || chunk_index FROM c) SELECT predicate, count(*) AS n, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM t GROUP BY 1"
)
BAND = "CASE WHEN {0} >= 0.8 THEN 'Excellent' WHEN {0} >= 0.6 THEN 'Good' WHEN {0} >= 0.4 THEN 'Fair' ELSE 'Poor' END"
STRIP_SQL = "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\v\\f]+', ' ', 'g')) AS text FROM pages"
TRUNC = "CASE WHEN length({0}) > {1} THEN left({0}, {1}) || '...' ELSE {0} END"

QUERIES = {
    "doc_content_meta": (struct("c", lambda: X.content_metadata(T())), f"SELECT doc_id, len({W}) AS word_count, length(text) AS character_count, len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: trim(p) <> '')) AS paragraph_count, len({LINES}) AS line_count FROM documents"),
    "doc_quality": (struct("q", lambda: X.quality(T(), CONFIDENCE(), ASCII_SPECIAL), "quality_score", "readability_score", "avg_word_length", "avg_sentence_length"), QUALITY_SQL),
    "doc_classify": (struct("c", lambda: X.classify(T(), FILE()), "classification_confidence"), CLASS_SQL),
    "doc_classify_corpus": (struct("c", lambda: X.classify(T(), FILE(), CORPUS_TYPES), "classification_confidence"), class_sql(CORPUS_TYPES)),
    "doc_category": (select(lambda: X.category(X.classify(T(), FILE())["document_type"]).alias("category")), f"SELECT doc_id, {CATEGORY_SQL} AS category FROM ({CLASS_SQL})"),
    "doc_entities_regex": (entity_rows, ENTITIES_SQL),
    "doc_chunk_words": (doc_chunk_words, CHUNKS_SQL),
    "doc_export_chunks": (
        lambda s, d: doc_chunk_words(s, d).select("doc_id", F.concat(F.lit("chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"), F.length("chunk_text").cast("long").alias("character_count")),
        f"SELECT doc_id, 'chunk_' || chunk_index AS chunk_id, length(chunk_text) AS character_count FROM ({CHUNKS_SQL})",
    ),
    "doc_ocr_confidence": (
        select(lambda: F.round(X.ocr_confidence(T(), METHOD()), 6).alias("confidence")),
        f"SELECT doc_id, round(CASE WHEN n = 0 THEN 0.0 WHEN n > 10 AND regexp_matches(text, '\\n|\\t|  ') AND regexp_matches(text, '[0-9]') THEN least(b + 0.02, 0.99) WHEN n > 5 AND regexp_matches(text, '[.,!?:;]') THEN b ELSE greatest(b - 0.05, 0.70) END::DOUBLE, 6) AS confidence FROM (SELECT doc_id, text, len({W}) AS n, CASE {METHOD_SQL} WHEN 'gemini' THEN 0.95 WHEN 'mistral' THEN 0.88 ELSE 0.85 END AS b FROM documents)",
    ),
    "doc_fields": (struct("f", lambda: X.fields(T())), FIELDS_SQL),
    "doc_type_by_name": (
        select(lambda: X.type_by_name(FILE(), T()).alias("document_type")),
        "SELECT doc_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({FILE_SQL}), {q(t)})" for t in terms) + f" THEN {q(k)}" for k, terms in X.NAME_RULES) + " WHEN " + " OR ".join(f"contains(lower(text), {q(t)})" for t in X.CONTENT_RULES[0][1]) + " THEN 'work_order' ELSE 'unknown' END AS document_type FROM documents",
    ),
    "doc_validate": (struct("v", lambda: X.quick_quality(T(), 50, X.HAND_ASCII), "text_quality_score"), QUICK_SQL),
    "doc_assess": (
        doc_assess,
        f"WITH v AS ({QUICK_SQL}), a AS (SELECT doc_id, round(least(1.0, CASE WHEN length(text) > 0 THEN 0.4 ELSE 0 END + CASE WHEN length(text) > 200 THEN 0.2 ELSE 0 END + text_quality_score * 0.25 + CASE WHEN len({W}) > 0 THEN 0.15 ELSE 0 END)::DOUBLE, 6) AS confidence FROM documents JOIN v USING (doc_id)) SELECT *, CASE WHEN confidence >= 0.8 THEN 'Excellent - Process automatically' WHEN confidence >= 0.6 THEN 'Good - Process with monitoring' WHEN confidence >= 0.4 THEN 'Fair - Manual review recommended' WHEN confidence >= 0.2 THEN 'Poor - Manual processing needed' ELSE 'Failed - Check document quality' END AS recommendation FROM a",
    ),
    "doc_quality_band": (select(lambda: X.quality_band(F.round(X.quality(T(), CONFIDENCE(), ASCII_SPECIAL)["quality_score"], 6)).alias("band")), f"SELECT doc_id, {BAND.format('quality_score')} AS band FROM ({QUALITY_SQL})"),
    "doc_file_meta": (page_meta, "SELECT page_id, sha256(html) AS file_hash, octet_length(encode(html))::BIGINT AS file_size_bytes, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) AS file_extension FROM pages"),
    "src_pages_html": (pages_text, STRIP_SQL),
    "txt_ocr_clean": (select(lambda: X.clean_ocr(T()).alias("text")), None),
    "txt_token_count": (select(lambda: X.token_count(T()).alias("tokens")), "SELECT doc_id, length(text) // 4 AS tokens FROM documents"),
    "txt_should_chunk": (lambda s, d: docs(s, d).filter(X.token_count(T()) > 0.8 * 500).select("doc_id"), "SELECT doc_id FROM documents WHERE length(text) // 4 > 400"),
    "txt_doc_context": (select(lambda: X.document_context(T()).alias("context")), f"SELECT doc_id, coalesce(array_to_string(list_filter(list_transform(({LINES})[1:10], lambda x: trim(x)), lambda x: length(x) > 5)[1:5], ' | '), '') AS context FROM documents"),
    "txt_combine": (
        lambda s, d: doc_chunk_words(s, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))).alias("c")).select("doc_id", F.array_join("c.chunk_text", "\n---\n").alias("text")),
        f"SELECT doc_id, string_agg(chunk_text, chr(10) || '---' || chr(10) ORDER BY chunk_index) AS text FROM ({CHUNKS_SQL}) GROUP BY 1",
    ),
    "chunk_hash_id": (
        lambda s, d: doc_chunk_words(s, d).select("doc_id", "chunk_index", X.chunk_id(F.col("chunk_text")).alias("chunk_id"), X.chunk_id(F.col("chunk_text"), F.col("doc_id")).alias("vector_id")),
        f"SELECT doc_id, chunk_index, 'chunk_' || sha256(chunk_text)[1:16] AS chunk_id, doc_id || '_' || sha256(chunk_text)[1:16] AS vector_id FROM ({CHUNKS_SQL})",
    ),
    "predicate_limit": (lambda s, d: predicates(s, d).select("p", X.limit_predicate(F.col("p")).alias("short")), f"WITH x AS (SELECT p, list_filter(string_split(p, ' '), lambda w: w <> '') AS w FROM ({PREDICATES})) SELECT p, CASE WHEN len(w) <= 3 THEN p WHEN lower(w[3]) IN ({STOPS}) THEN array_to_string(w[1:2], ' ') ELSE array_to_string(w[1:3], ' ') END AS short FROM x"),
    "predicate_sanitize": (lambda s, d: predicates(s, d).select("p", X.sanitize_predicate(F.col("p")).alias("type")), f"SELECT p, CASE WHEN regexp_matches(s, '^[0-9]') THEN '_' || s ELSE s END AS type FROM (SELECT p, regexp_replace(regexp_replace(upper(p), '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM ({PREDICATES}))"),
    "label_sanitize": (lambda s, d: names(s, d).select("name", X.sanitize_label(F.col("name")).alias("label")), f"SELECT name, CASE WHEN regexp_matches(l, '^[A-Za-z]') THEN l END AS label FROM (SELECT name, regexp_replace(name, '[^A-Za-z0-9]', '', 'g') AS l FROM {NAMES_SQL})"),
    "name_normalize": (lambda s, d: names(s, d).select("name", X.normalize_name(F.col("name"), True).alias("normal")), f"SELECT name, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(name), '[^\\w\\s#-]', '', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN ({NSTOPS})), ' ') AS normal FROM {NAMES_SQL}"),
    "mask_sensitive": (lambda s, d: table(s, d, "customer").select("c_custkey", X.mask(F.col("c_name")).alias("masked"), X.mask(F.left("c_mktsegment", F.lit(3))).alias("short")), "SELECT c_custkey, left(c_name, 4) || repeat('*', length(c_name) - 4) AS masked, repeat('*', 8) AS short FROM customer"),
    "highlight_snippet": (select(lambda: X.snippet(T(), "the").alias("snippet")), f"SELECT doc_id, CASE WHEN i > 0 THEN CASE WHEN i - 1 > 50 THEN '...' ELSE '' END || substring(text, greatest(i - 51, 0) + 1, least(i + 52, length(text)) - greatest(i - 51, 0)) || CASE WHEN i + 52 < length(text) THEN '...' ELSE '' END ELSE {TRUNC.format('text', 100)} END AS snippet FROM (SELECT doc_id, text, instr(lower(text), 'the') AS i FROM documents)"),
    "title_fallback": (select(lambda: X.title(T()).alias("title")), f"SELECT doc_id, CASE WHEN length(t) > 50 THEN left(t, 47) || '...' ELSE t END AS title FROM (SELECT doc_id, coalesce(array_to_string(({W})[1:6], ' '), '') AS t FROM documents)"),
    "preview_100": (select(lambda: X.truncate(T(), 100).alias("preview")), f"SELECT doc_id, {TRUNC.format('text', 100)} AS preview FROM documents"),
    "truncate_500": (select(lambda: X.truncate(T(), 500).alias("preview")), f"SELECT doc_id, {TRUNC.format('text', 500)} AS preview FROM documents"),
    "perf_band": (lambda s, d: table(s, d, "events").select("event_id", X.speed_band(F.col("value") / 10).alias("band")), "SELECT event_id, CASE WHEN value / 10 < 2 THEN 'fast' WHEN value / 10 < 5 THEN 'medium' ELSE 'slow' END AS band FROM events"),
    "ts_duration": (
        lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.date_format(F.min("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("a"), F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("b")).select("user_id", (F.unix_timestamp(F.try_to_timestamp("b", F.lit("yyyy-MM-dd'T'HH:mm:ss"))) - F.unix_timestamp(F.try_to_timestamp("a", F.lit("yyyy-MM-dd'T'HH:mm:ss")))).alias("seconds")),
        "SELECT user_id, epoch(date_trunc('second', max(ts)))::BIGINT - epoch(date_trunc('second', min(ts)))::BIGINT AS seconds FROM events GROUP BY 1",
    ),
    "detect_indicators": (
        lambda s, d: docs(s, d).select("doc_id", T().rlike(r"\$|€|£").alias("currency"), T().rlike("[0-9]{4}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/").alias("dates")).filter("currency or dates"),
        "SELECT * FROM (SELECT doc_id, regexp_matches(text, '\\$|€|£') AS currency, regexp_matches(text, '[0-9]{4}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/') AS dates FROM documents) WHERE currency OR dates",
    ),
    "kg_from_doc": (kg_from_doc, KG_FROM_DOC_SQL),
}
