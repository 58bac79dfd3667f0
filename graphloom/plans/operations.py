"""Queries over jobs, files, progress events, archives and chats.

The events stand for the audit log: a job per user, a file per event id in tens, the
event type as the stage, the value as percent done.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import operations as O
from graphloom.plans.text import pages_text, q
from graphloom.sources.tables import table

ERRORS = ["OCR timeout", "extraction error", "Neo4j down", "vector store", "other"]
ERR_SQL = "CASE event_id % 5 " + " ".join(f"WHEN {i} THEN {q(e)}" for i, e in enumerate(ERRORS)) + " END"
FILES_SQL = f"(SELECT event_id, user_id AS job_id, 'file_' || (event_id % 10) AS file_name, event_type AS stage, value AS percent, ts, CASE WHEN event_type = 'error' THEN 'Failed' WHEN event_type = 'purchase' THEN 'Success' WHEN event_type = 'signup' THEN 'Cached' ELSE 'Processing' END AS status, CASE WHEN event_type = 'error' THEN {ERR_SQL} END AS error, event_id % 7 AS triples FROM events)"


def files(spark, sf):
    error = F.element_at(F.array(*map(F.lit, ERRORS)), (F.col("event_id") % 5 + 1).cast("int"))
    status = F.when(F.col("event_type") == "error", "Failed").when(F.col("event_type") == "purchase", "Success").when(F.col("event_type") == "signup", "Cached").otherwise("Processing")
    return table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("job_id"), F.concat(F.lit("file_"), (F.col("event_id") % 10).cast("string")).alias("file_name"), F.col("event_type").alias("stage"),
        F.col("value").alias("percent"), "ts", status.alias("status"), F.when(F.col("event_type") == "error", error).alias("error"), (F.col("event_id") % 7).alias("triples"),
    )


def jobs(spark, sf):
    return files(spark, sf).groupBy("job_id").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("files"), F.count_if(F.col("status") == "Success").alias("done"), F.count_if(F.col("status") == "Failed").alias("failed"))


JOBS_SQL = f"(SELECT job_id, min(ts) AS started, max(ts) AS ended, count(*) AS files, count(*) FILTER (status = 'Success') AS done, count(*) FILTER (status = 'Failed') AS failed FROM {FILES_SQL} GROUP BY 1)"
STATUS_SQL = "CASE WHEN failed = 0 THEN 'Completed' WHEN done > 0 THEN 'Completed with Errors' ELSE 'Failed' END"
CLASS_SQL = "CASE WHEN contains(lower(error), 'ocr') THEN 'Failed - OCR' WHEN contains(lower(error), 'extract') THEN 'Failed - Extraction' WHEN contains(lower(error), 'neo4j') THEN 'Failed - Graph Storage' WHEN contains(lower(error), 'vector') THEN 'Failed - Vector Storage' WHEN contains(lower(error), 'cache') THEN 'Failed - Cache' ELSE 'Failed' END"


def seconds(a, b):
    return (F.unix_micros(F.col(b).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))) / 1e6


SEC = "(epoch_us({1}) - epoch_us({0})) / 1e6"


def a_job_details(spark, sf):
    per = files(spark, sf).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("file_name", "event_id", "status"))).alias("f"))
    return jobs(spark, sf).join(per, "job_id").select("job_id", "files", F.array_join(F.transform("f", lambda x: F.concat_ws(":", x["file_name"], x["event_id"].cast("string"), x["status"])), ",").alias("listing"))


def p_latest_status(spark, sf):
    return O.latest(files(spark, sf).select("job_id", "file_name", "stage", "percent", "ts", "event_id"), ["job_id", "file_name"], ["ts", "event_id"])


def p_stage_rows(spark, sf):
    return O.stage_durations(files(spark, sf), ["job_id", "file_name"], "ts", ["ts", "event_id"])


LEAD = f"(SELECT *, (epoch_us(lead(ts) OVER (PARTITION BY job_id, file_name ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6 AS seconds FROM {FILES_SQL})"
LATEST_SQL = f"SELECT job_id, file_name, stage, percent, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id, file_name ORDER BY ts DESC, event_id DESC) AS k FROM {FILES_SQL}) WHERE k = 1"


def archive(spark, sf):
    """Pages as an archive of files: name, directory, extension, size and day."""
    p = table(spark, sf, "pages")
    return p.select("page_id", F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, ".txt").otherwise(".html")).alias("file_name"), F.concat(F.lit("dir_"), (F.col("page_id") % 4).cast("string")).alias("dir"), F.when(F.col("page_id") % 3 == 0, "txt").otherwise("html").alias("ext"), F.octet_length("html").cast("long").alias("size"), F.sha2("html", 256).alias("hash"), (F.col("page_id") % 30).alias("age_days"))


ARCHIVE_SQL = "(SELECT page_id, 'page_' || page_id || CASE WHEN page_id % 3 = 0 THEN '.txt' ELSE '.html' END AS file_name, 'dir_' || (page_id % 4) AS dir, CASE WHEN page_id % 3 = 0 THEN 'txt' ELSE 'html' END AS ext, octet_length(encode(html))::BIGINT AS size, sha256(html) AS hash, page_id % 30 AS age_days FROM pages)"


def chats(spark, sf):
    return table(spark, sf, "conversations")


def c_list(spark, sf):
    """Conversations with their number of messages and last message, the longest first."""
    g = chats(spark, sf).groupBy("conv_id").agg(F.count("*").alias("messages"), F.max_by("text", "turn").alias("last"), F.max_by("role", "turn").alias("last_role"))
    return g.select("conv_id", "messages", "last_role", X.truncate(F.col("last"), 100).alias("preview")).orderBy(F.desc("messages"), "conv_id").limit(50)


TR = "CASE WHEN length({0}) > 100 THEN left({0}, 100) || '...' ELSE {0} END"
HITS = "((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3)"


def c_search_conv(spark, sf):
    m = O.search(chats(spark, sf), "the").groupBy("conv_id").agg(F.sum("hits").alias("score"), F.max("turn").alias("last_hit"))
    return m.orderBy(F.desc("score"), F.desc("last_hit"), "conv_id").limit(20)


def c_upsert_msgs(spark, sf):
    """Conversations whose messages are replaced by their first two, with new counts."""
    c = chats(spark, sf)
    new = c.filter("conv_id % 2 = 0 and turn < 2")
    kept = c.join(new.select("conv_id").distinct(), "conv_id", "left_anti")
    return kept.unionByName(new).groupBy("conv_id").agg(F.count("*").alias("messages"))


def one(spark, sf, sql_rows):
    return spark.createDataFrame(*sql_rows)


QUERIES = {
    "a_recent_jobs": (lambda s, d: jobs(s, d).orderBy(F.desc("started"), "job_id").limit(10).select("job_id", "started", "files"), f"SELECT job_id, started, files FROM {JOBS_SQL} ORDER BY started DESC, job_id LIMIT 10"),
    "a_job_details": (a_job_details, f"SELECT job_id, count(*) AS files, string_agg(file_name || ':' || event_id || ':' || status, ',' ORDER BY file_name, event_id) AS listing FROM {FILES_SQL} GROUP BY 1"),
    "a_job_progress": (lambda s, d: files(s, d).groupBy("job_id").agg(F.count_if(F.col("status") == "Success").alias("completed"), F.count_if(F.col("status").contains("Failed")).alias("failed"), F.count_if(F.col("status") == "Cached").alias("cached"), F.count_if(F.col("status") == "Processing").alias("processing")), f"SELECT job_id, count(*) FILTER (status = 'Success') AS completed, count(*) FILTER (contains(status, 'Failed')) AS failed, count(*) FILTER (status = 'Cached') AS cached, count(*) FILTER (status = 'Processing') AS processing FROM {FILES_SQL} GROUP BY 1"),
    "a_job_final_status": (lambda s, d: jobs(s, d).select("job_id", O.job_status(F.col("done"), F.col("failed")).alias("status")), f"SELECT job_id, {STATUS_SQL} AS status FROM {JOBS_SQL}"),
    "a_failure_class": (lambda s, d: files(s, d).filter("error is not null").groupBy(O.failure_class(F.col("error")).alias("failure")).agg(F.count("*").alias("n")), f"SELECT {CLASS_SQL} AS failure, count(*) AS n FROM {FILES_SQL} WHERE error IS NOT NULL GROUP BY 1"),
    "a_job_history": (lambda s, d: jobs(s, d).select("job_id", "files", F.round(F.try_divide(F.col("done") * 100.0, F.col("files")), 4).alias("success_percent"), F.round(seconds("started", "ended"), 3).alias("seconds")), f"SELECT job_id, files, round(done * 100.0::DOUBLE / files, 4) AS success_percent, round({SEC.format('started', 'ended')}, 3) AS seconds FROM {JOBS_SQL}"),
    "a_job_totals": (lambda s, d: files(s, d).filter("status = 'Success'").groupBy("job_id").agg(F.sum(F.coalesce("triples", F.lit(0))).alias("triples"), F.count("*").alias("files")), f"SELECT job_id, sum(coalesce(triples, 0))::BIGINT AS triples, count(*) AS files FROM {FILES_SQL} WHERE status = 'Success' GROUP BY 1"),
    "a_error_groups": (lambda s, d: files(s, d).filter("status = 'Failed'").groupBy("error").agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("job_id")), 1, 5).cast("array<string>"), ",").alias("first_jobs")), f"SELECT error, count(*) AS n, array_to_string(list_sort(list(DISTINCT job_id))[1:5], ',') AS first_jobs FROM {FILES_SQL} WHERE status = 'Failed' GROUP BY 1"),
    "a_file_search": (
        lambda s, d: files(s, d).join(F.broadcast(jobs(s, d).orderBy(F.desc("started"), "job_id").limit(100).select("job_id")), "job_id").filter(F.col("file_name").contains("_7")).select("event_id", "job_id"),
        f"SELECT event_id, job_id FROM {FILES_SQL} WHERE contains(file_name, '_7') AND job_id IN (SELECT job_id FROM {JOBS_SQL} ORDER BY started DESC, job_id LIMIT 100)",
    ),
    "a_status_update": (
        lambda s, d: O.with_updates(files(s, d).select("event_id", "status", "triples"), files(s, d).filter("event_id % 4 = 0").select("event_id", F.lit("Archived").alias("status"), F.lit(None).cast("long").alias("triples")), "event_id"),
        f"SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'Archived' ELSE status END AS status, triples FROM {FILES_SQL}",
    ),
    "a_batch_validate": (lambda s, d: files(s, d).groupBy("stage").agg(F.count("*").alias("n"), F.round(F.avg(F.col("percent")), 4).alias("avg_percent"), F.round(F.count_if(F.col("status") == "Success") * 100.0 / F.count("*"), 4).alias("success_percent")).withColumn("advice", F.when(F.col("success_percent") >= 80, "process").when(F.col("success_percent") >= 50, "review").otherwise("stop")), f"SELECT *, CASE WHEN success_percent >= 80 THEN 'process' WHEN success_percent >= 50 THEN 'review' ELSE 'stop' END AS advice FROM (SELECT stage, count(*) AS n, round(avg(percent), 4) AS avg_percent, round(count(*) FILTER (status = 'Success') * 100.0::DOUBLE / count(*), 4) AS success_percent FROM {FILES_SQL} GROUP BY 1)"),
    "a_batch_summary": (lambda s, d: files(s, d).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "Success").alias("done"), F.round(F.coalesce(F.try_divide(F.sum(F.when(F.col("status") == "Success", F.col("percent"))), F.greatest(F.count_if(F.col("status") == "Success"), F.lit(1))), F.lit(0.0)), 4).alias("avg_percent")), f"SELECT count(*) AS n, count(*) FILTER (status = 'Success') AS done, round(coalesce(sum(percent) FILTER (status = 'Success') / greatest(count(*) FILTER (status = 'Success'), 1), 0.0), 4) AS avg_percent FROM {FILES_SQL}"),
    "a_job_create": (lambda s, d: jobs(s, d).select(F.col("job_id"), F.concat(F.lit("job-"), F.col("job_id").cast("string")).alias("name"), F.lit("Running").alias("status")), f"SELECT job_id, 'job-' || job_id AS name, 'Running' AS status FROM {JOBS_SQL}"),
    "a_job_status_full": (
        lambda s, d: jobs(s, d).join(p_latest_status(s, d).groupBy("job_id").agg(F.count("*").alias("tracked"), F.round(F.avg("percent"), 4).alias("avg_percent")), "job_id", "left").select("job_id", "files", "tracked", "avg_percent"),
        f"SELECT job_id, files, tracked, avg_percent FROM {JOBS_SQL} LEFT JOIN (SELECT job_id, count(*) AS tracked, round(avg(percent), 4) AS avg_percent FROM ({LATEST_SQL}) GROUP BY 1) USING (job_id)",
    ),
    "a_system_status": (lambda s, d: jobs(s, d).agg(F.count("*").alias("jobs"), F.sum("files").alias("files")).crossJoin(table(s, d, "embeddings").agg(F.count("*").alias("vectors"))), f"SELECT * FROM (SELECT count(*) AS jobs, sum(files)::BIGINT AS files FROM {JOBS_SQL}), (SELECT count(*) AS vectors FROM embeddings)"),
    "p_latest_status": (p_latest_status, LATEST_SQL),
    "p_updates_since": (lambda s, d: files(s, d).filter(F.col("ts") > F.lit("2024-01-20").cast("timestamp_ntz")).select("event_id", "job_id"), f"SELECT event_id, job_id FROM {FILES_SQL} WHERE ts > TIMESTAMP '2024-01-20'"),
    "p_job_summary": (lambda s, d: p_stage_rows(s, d).groupBy("job_id", "stage").agg(F.count("*").alias("n"), F.count_if(F.col("percent") >= 100).alias("complete"), F.round(F.avg("seconds"), 3).alias("avg_seconds")), f"SELECT job_id, stage, count(*) AS n, count(*) FILTER (percent >= 100) AS complete, round(avg(seconds), 3) AS avg_seconds FROM {LEAD} GROUP BY 1, 2"),
    "p_stage_share": (
        lambda s, d: p_stage_rows(s, d).groupBy("stage").agg(F.sum("seconds").alias("s")).select("stage", F.round(F.try_divide(F.col("s") * 100, F.sum("s").over(Window.partitionBy())), 4).alias("percent")),
        f"SELECT stage, round(sum(seconds) * 100 / sum(sum(seconds)) OVER (), 4) AS percent FROM {LEAD} GROUP BY 1",
    ),
    "p_live_metrics": (lambda s, d: p_latest_status(s, d).groupBy("stage").agg(F.count("*").alias("files"), F.round(F.avg("percent"), 4).alias("avg_percent")), f"SELECT stage, count(*) AS files, round(avg(percent), 4) AS avg_percent FROM ({LATEST_SQL}) GROUP BY 1"),
    "p_timeline": (lambda s, d: files(s, d).filter("job_id = 3").select("file_name", "ts", "percent", F.row_number().over(Window.partitionBy("file_name").orderBy("ts", "event_id")).cast("long").alias("step")), f"SELECT file_name, ts, percent, row_number() OVER (PARTITION BY file_name ORDER BY ts, event_id) AS step FROM {FILES_SQL} WHERE job_id = 3"),
    "p_job_metrics": (lambda s, d: jobs(s, d).select("job_id", F.round(F.try_divide(F.col("done").cast("double"), F.col("files")), 6).alias("success_rate"), F.round(F.try_divide(F.col("files").cast("double"), seconds("started", "ended")), 6).alias("files_per_second")), f"SELECT job_id, round(done::DOUBLE / files, 6) AS success_rate, round(files / nullif({SEC.format('started', 'ended')}, 0), 6) AS files_per_second FROM {JOBS_SQL}"),
    "p_monitor": (lambda s, d: p_latest_status(s, d).groupBy((F.col("percent") < 100).alias("active")).agg(F.count("*").alias("files"), F.count_distinct("job_id").alias("jobs")), f"SELECT percent < 100 AS active, count(*) AS files, count(DISTINCT job_id) AS jobs FROM ({LATEST_SQL}) GROUP BY 1"),
    "p_file_display": (lambda s, d: p_latest_status(s, d).select("job_id", "file_name", F.array_position(F.array(*map(F.lit, ["signup", "view", "click", "purchase", "error"])), F.col("stage")).alias("ordinal")), f"SELECT job_id, file_name, list_position(['signup', 'view', 'click', 'purchase', 'error'], stage)::BIGINT AS ordinal FROM ({LATEST_SQL})"),
    "p_emit": (lambda s, d: files(s, d).select(F.to_json(F.struct("job_id", "file_name", "stage")).alias("event")), f"SELECT '{{\"job_id\":' || job_id || ',\"file_name\":\"' || file_name || '\",\"stage\":\"' || stage || '\"}}' AS event FROM {FILES_SQL}"),
    "st_list": (lambda s, d: archive(s, d).orderBy("age_days", "page_id").limit(20).join(pages_text(s, d).select("page_id", F.length("text").cast("long").alias("chars")), "page_id", "left").select("page_id", "file_name", "chars"), f"SELECT page_id, file_name, (SELECT length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\v\\f]+', ' ', 'g'))) FROM pages p WHERE p.page_id = a.page_id) AS chars FROM (SELECT * FROM {ARCHIVE_SQL} ORDER BY age_days, page_id LIMIT 20) a"),
    "st_stats": (lambda s, d: archive(s, d).groupBy("dir", "ext").agg(F.count("*").alias("files"), F.round(F.sum("size") / 1048576.0, 6).alias("mb")), f"SELECT dir, ext, count(*) AS files, round(sum(size)::BIGINT / 1048576.0::DOUBLE, 6) AS mb FROM {ARCHIVE_SQL} GROUP BY 1, 2"),
    "st_cleanup": (lambda s, d: archive(s, d).filter("age_days > 20").agg(F.count("*").alias("files"), F.round(F.sum("size") / 1048576.0, 6).alias("mb")), f"SELECT count(*) AS files, round(sum(size)::BIGINT / 1048576.0::DOUBLE, 6) AS mb FROM {ARCHIVE_SQL} WHERE age_days > 20"),
    "st_by_hash": (lambda s, d: archive(s, d).filter(F.col("hash").startswith("a")).select("page_id", "hash"), f"SELECT page_id, hash FROM {ARCHIVE_SQL} WHERE starts_with(hash, 'a')"),
    "st_daily": (lambda s, d: files(s, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("files")), f"SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS files FROM {FILES_SQL} GROUP BY 1"),
    "st_types": (lambda s, d: archive(s, d).groupBy("ext").agg(F.count("*").alias("files")), f"SELECT ext, count(*) AS files FROM {ARCHIVE_SQL} GROUP BY 1"),
    "st_load_text": (lambda s, d: archive(s, d).filter(F.col("file_name").like("page_1%")).agg(F.min_by("file_name", F.struct("age_days", "page_id")).alias("file_name")), f"SELECT arg_min(file_name, age_days * 100000000 + page_id) AS file_name FROM {ARCHIVE_SQL} WHERE file_name LIKE 'page\\_1%' ESCAPE '\\'"),
    "c_list": (c_list, f"SELECT conv_id, messages, last_role, {TR.format('last')} AS preview FROM (SELECT conv_id, count(*) AS messages, arg_max(role, turn) AS last_role, arg_max(text, turn) AS last FROM conversations GROUP BY 1) ORDER BY messages DESC, conv_id LIMIT 50"),
    "c_search_conv": (c_search_conv, f"SELECT conv_id, sum({HITS})::BIGINT AS score, max(turn) AS last_hit FROM conversations WHERE text ILIKE '%the%' GROUP BY 1 ORDER BY score DESC, last_hit DESC, conv_id LIMIT 20"),
    "c_search_msg": (lambda s, d: O.search(chats(s, d), "the").select("conv_id", "turn", "hits", X.snippet(F.col("text"), "the").alias("snippet")), f"SELECT conv_id, turn, {HITS} AS hits, CASE WHEN i - 1 > 50 THEN '...' ELSE '' END || substring(text, greatest(i - 51, 0) + 1, least(i + 52, length(text)) - greatest(i - 51, 0)) || CASE WHEN i + 52 < length(text) THEN '...' ELSE '' END AS snippet FROM (SELECT *, instr(lower(text), 'the') AS i FROM conversations) WHERE i > 0"),
    "c_history": (lambda s, d: chats(s, d).filter("conv_id = 2").orderBy("turn").offset(1).limit(3).select("turn", "role"), "SELECT turn, role FROM conversations WHERE conv_id = 2 ORDER BY turn LIMIT 3 OFFSET 1"),
    "c_upsert_msgs": (c_upsert_msgs, "SELECT conv_id, count(*) AS messages FROM conversations WHERE conv_id % 2 <> 0 OR turn < 2 GROUP BY 1"),
    "c_session_stats": (lambda s, d: chats(s, d).groupBy("conv_id").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("user_messages"), F.round(F.avg(F.length("text")), 6).alias("avg_chars")), "SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS user_messages, round(avg(length(text)), 6) AS avg_chars FROM conversations GROUP BY 1"),
    "c_feedback": (lambda s, d: O.with_updates(chats(s, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit(0).alias("rating")), chats(s, d).filter("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.greatest(F.least((F.col("turn") - 2).cast("int"), F.lit(1)), F.lit(-1)).alias("rating")), "id"), "SELECT conv_id * 1000 + turn AS id, CASE WHEN role = 'assistant' THEN greatest(least(turn - 2, 1), -1)::INT ELSE 0 END AS rating FROM conversations"),
    "c_create": (lambda s, d: chats(s, d).filter("turn = 0").select("conv_id", X.title(F.col("text")).alias("title")), "SELECT conv_id, CASE WHEN length(t) > 50 THEN left(t, 47) || '...' ELSE t END AS title FROM (SELECT conv_id, coalesce(array_to_string((list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\v\\f]+'), lambda w: w <> ''))[1:6], ' '), '') AS t FROM conversations WHERE turn = 0)"),
    "c_delete": (lambda s, d: chats(s, d).join(chats(s, d).filter("turn = 5").select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", "turn"), "SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn = 5)"),
    "c_rename": (lambda s, d: chats(s, d).select("conv_id").distinct().select("conv_id", F.when(F.col("conv_id") == 3, "renamed").otherwise(F.concat(F.lit("chat "), F.col("conv_id").cast("string"))).alias("title")), "SELECT DISTINCT conv_id, CASE WHEN conv_id = 3 THEN 'renamed' ELSE 'chat ' || conv_id END AS title FROM conversations"),
    "c_append": (lambda s, d: chats(s, d).groupBy("conv_id").agg((F.max("turn") + 1).alias("turn"), (F.count("*") + 1).alias("message_count")), "SELECT conv_id, max(turn) + 1 AS turn, count(*) + 1 AS message_count FROM conversations GROUP BY 1"),
    "c_get": (lambda s, d: chats(s, d).filter("conv_id = 1").select("turn", "role", X.truncate(F.col("text"), 100).alias("preview")), f"SELECT turn, role, {TR.format('text')} AS preview FROM conversations WHERE conv_id = 1"),
    "c_default": (lambda s, d: chats(s, d).groupBy("role").agg(F.max_by("conv_id", F.struct("turn", "conv_id")).alias("conv_id")), "SELECT role, conv_id FROM (SELECT role, conv_id, row_number() OVER (PARTITION BY role ORDER BY turn DESC, conv_id DESC) AS k FROM conversations) WHERE k = 1"),
    "c_memory_search": (lambda s, d: chats(s, d).filter(F.lower("text").contains("ering")).select("conv_id", "turn"), "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'ering')"),
    "c_serialize": (lambda s, d: chats(s, d).select("conv_id", "turn", F.from_json(F.to_json(F.struct("role", "text")), "role string, text string")["role"].alias("role")), "SELECT conv_id, turn, role FROM conversations"),
}
