"""Industry switches, few-shot import and single-file input, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.more import INDUSTRIES, q_industry
from graphloom.plans.more import QUERIES as MORE
from graphloom.plans.questions import GENERATED_SQL, QUESTIONS_SQL, generated, questions
from graphloom.sources import files as S
from graphloom.sources.tables import table

#: Fields that an imported example must have.
REQUIRED = ("question", "cypher", "database", "llm")


def switched(detected: DataFrame, asked: DataFrame) -> DataFrame:
    """asked, industry: the one asked for if it is known, else the one detected (one row)."""
    known = F.lower("asked").isin(*INDUSTRIES, "generic")
    return asked.crossJoin(F.broadcast(detected)).select("asked", F.when(known, F.lower("asked")).otherwise(F.col("industry")).alias("industry"))


def q_switch_industry(spark, sf):
    """Whatever the document sources name, as overrides of the detected industry, besides all known ones."""
    named = table(spark, sf, "documents").select(F.coalesce("source", F.lit("")).alias("asked")).distinct()
    known = spark.createDataFrame([(k.upper(),) for k in (*INDUSTRIES, "generic")], "asked string")
    return switched(q_industry(spark, sf), named.union(known))


_KNOWN = ", ".join(f"'{k}'" for k in (*INDUSTRIES, "generic"))
SWITCH_SQL = f"""
SELECT asked, CASE WHEN lower(asked) IN ({_KNOWN}) THEN lower(asked) ELSE industry END AS industry
FROM (SELECT DISTINCT coalesce(source, '') AS asked FROM documents UNION ALL SELECT upper(k) FROM (VALUES {", ".join(f"('{k}')" for k in (*INDUSTRIES, "generic"))}) v(k))
CROSS JOIN ({MORE["q_industry"][1]})"""


def import_examples(stored: DataFrame, imported: DataFrame) -> DataFrame:
    """Stored examples with imported ones, one per question and database; imported ones that lack a field are skipped, others win."""
    whole = imported.select(*REQUIRED).dropna(subset=list(REQUIRED)).withColumn("success", F.lit(True))
    both = stored.select(*REQUIRED, "success").withColumn("new", F.lit(0)).unionByName(whole.withColumn("new", F.lit(1)))
    best = F.max(F.struct("new", "cypher", "llm", "success")).alias("b")
    return both.groupBy("question", "database").agg(best).select("question", "database", "b.cypher", "b.llm", "b.success")


def q_fewshot_import(spark, sf):
    """Examples written as JSON, some of them without a query, and merged into a store that has every second one."""
    every = questions(spark, sf).join(generated(spark, sf), "qid").select("qid", "question", F.col("query").alias("cypher"), F.lit("graph").alias("database"))
    path = S.shared_path(spark, "examples")
    given = every.select("question", F.when(F.col("qid") % 4 != 0, F.col("cypher")).alias("cypher"), "database", F.lit("import").alias("llm"))
    S.write_json(given, path)
    imported = spark.read.schema("question string, cypher string, database string, llm string").json(path)
    stored = every.filter("qid % 2 = 0").select("question", "cypher", "database", F.lit("store").alias("llm"), F.lit(False).alias("success"))
    return import_examples(stored, imported)


IMPORT_SQL = f"""
WITH e AS (SELECT q.qid, question, query AS cypher FROM {QUESTIONS_SQL} q JOIN ({GENERATED_SQL}) g USING (qid)),
x AS (SELECT question, cypher, 1 AS new FROM e WHERE qid % 4 <> 0 AND cypher IS NOT NULL UNION ALL SELECT question, cypher, 0 FROM e WHERE qid % 2 = 0)
SELECT question, 'graph' AS database, cypher, CASE WHEN new = 1 THEN 'import' ELSE 'store' END AS llm, new = 1 AS success
FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY new DESC, cypher DESC) AS k FROM x) WHERE k = 1"""


def src_cli_file(spark, sf):
    """Documents as lines of input files, each read whole as the command line reads its input, by the length of their lines."""
    path = S.shared_path(spark, "input")
    lines = table(spark, sf, "documents").select(F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " ").alias("value"))
    lines.write.option("maxRecordsPerFile", 100_000).text(path)
    one = S.read_text(spark, path + "/part-*").select(F.explode(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("line"))
    return one.select(F.length("line").cast("long").alias("chars")).groupBy("chars").agg(F.count("*").alias("n"))


CLI_SQL = "SELECT length(coalesce(text, '')) AS chars, count(*) AS n FROM documents GROUP BY 1"

QUERIES = {
    "q_switch_industry": (q_switch_industry, SWITCH_SQL),
    "q_fewshot_import": (q_fewshot_import, IMPORT_SQL),
    "src_cli_file": (src_cli_file, CLI_SQL),
}
