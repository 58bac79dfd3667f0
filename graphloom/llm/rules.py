"""Quality rules as a bitmask ledger.

Each rule is evaluated once per document: the ledger keeps the measurements and one
integer whose bit i says that rule i failed. A policy is a versioned mask of rules; a
document passes if no bit of the mask is set. Ablations (what each rule removes, alone
and on top of the others) are counts over the distinct masks, which an aggregation by
the integer makes first, so they cost one pass whatever the number of policies.

Words are runs of characters other than ASCII white space. Defined results: a null or
blank text has zeros everywhere and fails `too_few_words`; texts of any length are
measured whole; repeated rows are judged each; columns named like the outputs are
replaced.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import TEXT_BYTES, by_bytes, raw, shingle_hashes, word_hashes

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
NOT_FIRST = bytes(range(0x80, 0xC0))  # bytes that go on a character

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_exclaims")

#: Rules in the order of their bits: name and condition of failure over the measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("too_few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "n_symbols > 0 AND 100 * n_symbols > 40 * n_words"),
    ("duplicate_lines", "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines"),
    ("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
    ("exclaims", "n_exclaims >= 5 AND 100 * n_exclaims > 30 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Versioned policies: rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_words"),
    "v1": ("too_few_words", "repeated_words", "symbols", "duplicate_lines"),
    "v2": tuple(BIT),
}


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def repeated_words(words: np.ndarray, size: int = 5) -> int:
    """Words in windows of `size` words that are found twice or more; words given as hashes."""
    if len(words) < size + 1:
        return 0
    h = shingle_hashes(words, size)
    ordered = np.sort(h)
    if (ordered[1:] != ordered[:-1]).all():
        return 0
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: bytes, words: np.ndarray) -> tuple[int, ...]:
    """The measurements of a text, in the order of MEASURES; words as hashes."""
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    return (
        len(words),
        len(text.translate(None, SPACE + NOT_FIRST)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        text.count(b"!"),
    )


@F.arrow_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def measures(texts: pa.Array) -> pa.Array:
    rows = []
    for part in by_bytes(texts, TEXT_BYTES):
        words, ends = word_hashes(part, lower=False)
        rows += [measure(t.as_py(), words[a:b]) for t, a, b in zip(part, ends, ends[1:])]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(MEASURES))], names=list(MEASURES))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements and `failed_bits`, every rule evaluated once."""
    found = docs.withColumn("__m", measures(raw(text)))
    out = found.withColumns({m: F.col(f"__m.{m}") for m in MEASURES}).drop("__m")
    bits = [F.when(F.expr(f"coalesce({c}, false)"), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, c) in enumerate(RULES)]
    return out.withColumn("failed_bits", functools.reduce(lambda a, b: a + b, bits).cast("long"))


def passes(policy: str, bits: Column | str = "failed_bits") -> Column:
    c = F.col(bits) if isinstance(bits, str) else bits
    return c.bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(table: DataFrame, policy: str, bits: str = "failed_bits") -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail nothing else of the policy, and that pass without it."""
    m = mask(policy)
    counts = table.groupBy(F.col(bits).bitwiseAND(F.lit(m).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in POLICIES[policy]]))
    rows = counts.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return rows.groupBy("rule", "bit").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.lit(m).cast("long").bitwiseXOR(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )
