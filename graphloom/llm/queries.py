"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import bpe, embeddings, jaccard, licenses, negatives, neighbours, packing, periodic, quality, rules, substring, tokenfile, toxicity
from graphloom.llm.common import held_out, new_path, raw, small_batches

#: The public tokenizer of the token queries, and the ids of its end markers.
TOKENIZER = "word_bpe_49k.json"
INDEX_END, PACK_END = b"\x02\x00\x00\x00", b"\x01\x00\x00\x00"
VOCABULARY_SIZE = 49_408
SHARD_BYTES = 8 << 20
CAPACITY = 2048


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), quality.score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), toxicity.score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.join(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = rules.ledger(table(spark, sf_dir, "documents"))
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~rules.passes("base")).alias("base_failed"), rules.passes("v1").alias("kept"), "failed_bits",
    )


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), size=3, per_cent=90)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    both = table(spark, sf_dir, "documents").select("doc_id", bpe.round_trip("text", path).alias("t"))
    return both.select(
        "doc_id",
        (F.octet_length("t.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("t.ids", 256).alias("ids_sha256"),
        F.sha2(F.col("t.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = new_path(spark, "token-file")
    cuts = tokenfile.bounds(docs, "doc_id", "text", SHARD_BYTES)
    ids = docs.select("doc_id", bpe.library_encode("text", tokenizer_path(), INDEX_END).alias("ids"))
    tokenfile.write(ids, path, "doc_id", "ids", cuts, VOCABULARY_SIZE)
    return tokenfile.read(spark, path).select(
        F.col("key").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, "doc_id", raw("text"), CAPACITY, bpe.library_encoder(tokenizer_path(), PACK_END)).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.duplicates(table(spark, sf_dir, "documents"), within=False)


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest other vectors of each vector whose id 100 divides."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), 10, F.col("id") % 100 == 0)


@F.arrow_udf(T.BinaryType())
def _with_planted_period(texts: pa.Array, h: pa.Array) -> pa.Array:
    """The contract's texts: with a hash that 10 divides, the words from a on repeat a period of p words."""
    out = []
    for text, x in zip(texts, h.to_pylist()):
        text = text.as_py()
        if x is not None and x % 10 == 0 and (words := text.split()):
            n, g = len(words), x // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = b" ".join([*words[:a], *(words[a + i % p] for i in range(n - a))])
        out.append(text)
    return pa.array(out, pa.binary())


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each text (periods planted as the contract says; a null doc_id plants none), the strongest, and digests of all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _with_planted_period(raw("text"), F.crc32(F.col("doc_id").cast("string").cast("binary"))).alias("text"))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return periodic.runs(docs).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hard negatives for each of five positives of each vector whose id 100 divides; labels planted as the contract says."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), label, F.col("id") % 100 == 0, positives=5, negatives=5, per_cent=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_classifier, op2_toxicity, op3_embedding_dedup, op4_quality_rules, op5_ngram_jaccard, op6_bpe, op7_token_files, op8_packing, op9_license_scan, op10_substring_dedup, op11_nearest_neighbours, op12_periodic_runs, op13_hard_negatives)
}

#: Words as the contracts have them: runs of anything but ASCII white space.
_WORD = r"'[^\x20\x09-\x0D]+'"
_RULES_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, {_WORD})) AS lines FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM rep) GROUP BY 1),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, length(t) - length(replace(t, '!', '')) AS n_exclaims FROM d LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, (n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (n_symbols > 0 AND 100 * n_symbols > 40 * n_words)::INT + 8 * (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)::INT
  + 16 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words))::INT + 32 * (n_exclaims >= 5 AND 100 * n_exclaims > 30 * n_words)::INT AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & 3 <> 0 AS base_failed, bits & 15 = 0 AS kept, bits::BIGINT AS failed_bits FROM b"""
_REACH = "reach AS (SELECT {0} AS x, {0} AS c FROM {1} UNION SELECT links.a, reach.c FROM reach JOIN links ON links.b = reach.x WHERE reach.c < links.a)"
_VECTORS_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
{_REACH.format("vec_id", "embeddings")}
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM (SELECT x AS vec_id, min(c) AS c FROM reach GROUP BY 1) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1) USING (vec_id)"""
_JACCARD_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
{_REACH.format("doc_id", "documents")}
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id FROM (SELECT x AS doc_id, min(c) AS c FROM reach GROUP BY 1) LEFT JOIN n USING (doc_id)"""


_FINITE = "embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)), false)"
_NEAREST_SQL = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT a.vec_id AS query_id, b.vec_id, sqrt(list_reduce(list_transform(list_zip(a.e, b.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])), lambda x, y: x + y)) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10"""
_NEGATIVES_SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE alike) WHERE k <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT s.alike AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""


def _licenses_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = [(name, licenses.class_length(len(s)), len(s), g) for name, t in licenses.TEMPLATES for s in [licenses.template_shingles(t)] for g in s]
    values = ", ".join(f"({quote(n)}, {length}, {m}, {quote(g)})" for n, length, m, g in rows)
    return f"""
WITH t AS (SELECT * FROM (VALUES {values}) v(license, len, m, g)),
w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
s AS (SELECT doc_id, len(w) - 4 AS n, i - 1 AS i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
h AS (SELECT doc_id, license, len, m, t.g, n, unnest([i // len, i // len - 1]) * len AS start FROM s JOIN t USING (g)),
c AS (SELECT doc_id, license, start, count(DISTINCT g) / m::DOUBLE AS containment FROM h WHERE start >= 0 AND start < greatest(n - len, 1) GROUP BY doc_id, license, start, m HAVING count(DISTINCT g) / m::DOUBLE >= 0.8)
SELECT doc_id, license, containment, start AS first_word, n AS n_windows FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, license) AS n, row_number() OVER (PARTITION BY doc_id, license ORDER BY containment DESC, start) AS k FROM c) WHERE k = 1"""


ORACLE_SQL: dict[str, str] = {
    "op3_embedding_dedup": _VECTORS_SQL,
    "op4_quality_rules": _RULES_SQL,
    "op5_ngram_jaccard": _JACCARD_SQL,
    "op9_license_scan": _licenses_sql(),
    "op11_nearest_neighbours": _NEAREST_SQL,
    "op13_hard_negatives": _NEGATIVES_SQL,
}
