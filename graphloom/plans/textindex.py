"""Ranked searches of chats and documents over the text index, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import postings as I
from graphloom.plans.text import q
from graphloom.sources.store import once
from graphloom.sources.tables import table

#: What is asked of the chats: any of these words; both of these; these in a row (words of the corpus).
ANY, BOTH, PHRASE = ("the", "und", "la", "que"), ("die", "und"), ("the", "and")


def chat_index(spark, sf) -> I.Postings:
    return once(spark, sf, "chats", ["conversations"], lambda: I.write_index(table(spark, sf, "conversations"), ["conv_id", "turn"]))


def document_index(spark, sf) -> I.Postings:
    return once(spark, sf, "texts", ["documents"], lambda: I.write_index(table(spark, sf, "documents"), ["doc_id"]))


def c_search_msg_ranked(spark, sf):
    """The 50 messages that say most about any of four words, and their lengths."""
    best = I.search(chat_index(spark, sf), ANY).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "conv_id", "turn").limit(50)
    rows = best.join(table(spark, sf, "conversations"), ["conv_id", "turn"])
    return rows.select("conv_id", "turn", "score", "matched", F.length("text").cast("long").alias("chars"))


def c_search_conv_ranked(spark, sf):
    """The 20 conversations whose messages score highest for both words together, by their sum, then the latest turn."""
    found = I.search(chat_index(spark, sf), BOTH, every=True).groupBy("conv_id").agg(F.round(F.sum("score"), 6).alias("score"), F.count("*").alias("messages"), F.max("turn").alias("last_hit"))
    return found.orderBy(F.desc("score"), F.desc("last_hit"), "conv_id").limit(20)


def v_phrase(spark, sf):
    """All documents in which two words follow each other, with their score."""
    return I.search(document_index(spark, sf), PHRASE, phrases=[PHRASE]).select("doc_id", F.round("score", 6).alias("score"))


def bm25_sql(source: str, keys: str, asked, every=False, phrase=()) -> str:
    """WITH ... of a table found(keys, score, matched)."""
    words = ", ".join(map(q, asked))
    ok = [f"count(*) = {len(asked)}"] if every else []
    row = f"AND ({keys}) IN (SELECT {keys} FROM (SELECT {keys}, unnest(range(1, len(t))) AS i, t FROM d) WHERE t[i] = {q(phrase[0])} AND t[i + 1] = {q(phrase[1])})" if phrase else ""
    return f"""WITH d AS (SELECT *, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM {source}),
n AS (SELECT count(*) AS n, avg(len(t)) AS average FROM d WHERE len(t) > 0),
w AS (SELECT {keys}, len(t) AS length, unnest(t) AS term FROM d),
p AS (SELECT {keys}, length, term, count(*)::DOUBLE AS tf FROM w WHERE term IN ({words}) {row} GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT {keys}, term FROM w WHERE term IN ({words})) GROUP BY 1),
found AS (SELECT {keys}, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * {I.K1 + 1}::DOUBLE / (tf + {I.K1}::DOUBLE * ({1 - I.B}::DOUBLE + {I.B}::DOUBLE * length / average))) AS score, count(*) AS matched FROM p JOIN f USING (term) CROSS JOIN n GROUP BY {keys}{' HAVING ' + ok[0] if ok else ''})"""


QUERIES = {
    "c_search_msg_ranked": (c_search_msg_ranked, bm25_sql("conversations", "conv_id, turn", ANY) + " SELECT conv_id, turn, round(score, 6) AS score, matched, length(text) AS chars FROM found JOIN conversations USING (conv_id, turn) ORDER BY round(score, 6) DESC, conv_id, turn LIMIT 50"),
    "c_search_conv_ranked": (c_search_conv_ranked, bm25_sql("conversations", "conv_id, turn", BOTH, every=True) + " SELECT conv_id, round(sum(score), 6) AS score, count(*) AS messages, max(turn) AS last_hit FROM found GROUP BY 1 ORDER BY score DESC, last_hit DESC, conv_id LIMIT 20"),
    "v_phrase": (v_phrase, bm25_sql("documents", "doc_id", PHRASE, phrase=PHRASE) + " SELECT doc_id, round(score, 6) AS score FROM found"),
}
