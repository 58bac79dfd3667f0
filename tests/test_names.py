"""Merges and containment of names against all pairs, and their growth with a word that all names have."""

import random

from graphloom.operators import triples as K


def fits(a, b):
    words = lambda n: list(dict.fromkeys(n.split()))
    stems = lambda n: {x[:4] for x in words(n) if len(x) > 4}
    s, t = stems(a), stems(b)
    least = min(len(s), len(t))
    return bool(words(a)) and set(words(a)) <= set(words(b)) or least > 0 and len(s & t) > 0.5 * least


def sample(rng, n):
    words = ["small", "smaller", "pump", "pumps", "valve", "unit", "a", "ring", "rings", "motor", "motors", "central", "station"]
    return sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(n)})


def test_merges_equal_all_pairs(spark):
    rng = random.Random(2)
    names = sample(rng, 150)
    types = {n: sorted(rng.sample(["Activity", "Date", "Asset", "Company"], rng.randrange(3))) for n in names}
    may = lambda a, b: not a or not b or any(x == y or (x, y) in K.TYPE_PAIRS or (y, x) in K.TYPE_PAIRS for x in a for y in b)
    order = lambda n: (len(n), n)
    want = {}
    for a in names:
        good = [b for b in names if order(b) > order(a) and fits(a, b) and may(types[a], types[b])]
        if good:
            want[a] = max(good, key=order)
    got = {r["name"]: r["target"] for r in K.subset_merges(spark.createDataFrame(sorted(types.items()), "name string, types array<string>")).collect()}
    assert got == want and len(want) > 50


def test_a_word_in_every_name_costs_a_row_for_each(spark):
    counts = []
    for n in (200, 800):
        rows = [(f"common part{i}x", ["common", f"part{i}x"], ["comm", f"p{i:03}"]) for i in range(n)]
        sets = spark.createDataFrame([(a, sorted(w, key=lambda x: x == "common"), sorted(s, key=lambda x: x == "comm"), ["Asset"]) for a, w, s in rows], "name string, words array<string>, stems array<string>, types array<string>")
        counts.append((K.subset_candidates(sets).count(), K.overlap_candidates(sets).count()))
    assert counts[1][0] <= 4 * counts[0][0] <= 4 * 200 and counts[0][1] == counts[1][1] == 0


def test_short_names_are_contained_too(spark):
    rows = [("x", "T", "p", "abxc", "T", 1, False), ("ab", "T", "p", "q", "T", 2, False), ("zabz", "T", "p", "q", "T", 3, False)]
    df = spark.createDataFrame(rows, "subject string, subject_type string, predicate string, object string, object_type string, ord long, inferred boolean")
    got = {(r["subject"], r["object"]) for r in K.lexical(df).filter("predicate = 'is type of'").collect()}
    assert got == {("abxc", "ab"), ("zabz", "ab")}  # abxc and x are linked


def test_names_of_a_word_are_dealt_to_blocks_and_pairs_come_once(spark):
    rng = random.Random(8)
    names = sample(rng, 120) + [f"the unit {i}" for i in range(60)]
    want = sorted((a, b) for a in names for b in names if a < b and set(a.split()) & set(b.split()))
    df = spark.createDataFrame([(n,) for n in names], "n string")
    pairs = K.sharing(df, 7)
    assert sorted(map(tuple, pairs.collect())) == want
    assert "block" in pairs._jdf.queryExecution().executedPlan().toString()
