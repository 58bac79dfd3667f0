"""Triples: validation, standardised names, inference, duplicates, components and centrality.

Triples are rows of subject, subject_type, predicate, object, object_type, ord (their
order), inferred and confidence. Candidate pairs come from equi-joins on words and
stems; there is no cross join. Loops cut their lineage with checkpoint().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators.linking import Names, holding, write_index
from graphloom.sources.files import own_folder
from graphloom.sources.store import forget, stored

#: Pairs of types that may be related, in either order (fixed values).
TYPE_PAIRS = [
    ("Invoice", "Date"), ("Invoice", "Company"), ("Invoice", "Currency"), ("Invoice", "Value"), ("Activity", "Date"), ("Activity", "Equipment"),
    ("Activity", "Asset"), ("Activity", "Person"), ("Activity", "Material"), ("Equipment", "Activity"), ("Equipment", "Asset"),
    ("Equipment", "Location"), ("Asset", "Activity"), ("Asset", "Location"), ("Asset", "Material"), ("Company", "Location"),
    ("Company", "Invoice"), ("Company", "Contract"), ("Task", "Date"), ("Task", "Equipment"), ("Task", "Description"), ("Task", "Value"),
    ("Location", "Facility"), ("Location", "Contract"), ("Facility", "Identifier"),
]
KEYS = ("subject", "subject_type", "predicate", "object", "object_type")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder, or in one of our own where none is set."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(base or own_folder(df.sparkSession))
    return df.checkpoint()


def invalid_reasons(keys=KEYS) -> Column:
    """Names of the keys that are null or blank."""
    return F.array_compact(F.array(*[F.when(F.coalesce(F.trim(k), F.lit("")) == "", F.lit(k)) for k in keys]))


def validate(triples: DataFrame, keys=KEYS) -> DataFrame:
    return triples.filter(F.size(invalid_reasons(keys)) == 0)


def entity_details(triples: DataFrame) -> DataFrame:
    """name (lower case), casings, types and mentions of every entity."""
    both = triples.select(F.col("subject").alias("n"), F.col("subject_type").alias("t")).unionByName(triples.select(F.col("object").alias("n"), F.col("object_type").alias("t")))
    return both.groupBy(F.lower("n").alias("name")).agg(
        F.array_sort(F.collect_set("n")).alias("casings"), F.array_sort(F.collect_set("t")).alias("types"), F.count("*").alias("mentions")
    )


def longest(c: Column) -> Column:
    """Sort key: the longest first, then by code points."""
    return F.struct((-F.length(c)).alias("l"), c.alias("v"))


def normal_groups(details: DataFrame) -> DataFrame:
    """name, standard: variants of one normal form share the one with the most mentions, the longest of equals."""
    n = details.select("name", "mentions", F.coalesce(F.nullif(X.normalize_name(F.col("name"), True), F.lit("")), F.col("name")).alias("normal"))
    best = n.groupBy("normal").agg(F.min(F.struct((-F.col("mentions")).alias("m"), (-F.length("name")).alias("l"), "name")).alias("b"))
    return n.join(best, "normal").select("name", F.col("b.name").alias("standard"))


def compatible(a: Column, b: Column) -> Column:
    """Whether any type of one list may go with any of the other; empty lists go with all."""
    pairs = F.array(*[F.lit(f"{x}|{y}") for x, y in TYPE_PAIRS] + [F.lit(f"{y}|{x}") for x, y in TYPE_PAIRS])
    ok = lambda x, y: (x == y) | F.array_contains(pairs, F.concat_ws("|", x, y))
    return (F.size(a) == 0) | (F.size(b) == 0) | F.exists(a, lambda x: F.exists(b, lambda y: ok(x, y)))


def _by_frequency(sets: DataFrame, column: str) -> DataFrame:
    """name and the values of an array column, the rarest first."""
    long = sets.select("name", F.explode(column).alias("k"))
    counted = long.join(long.groupBy("k").agg(F.count("*").alias("n")), "k")
    return counted.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "k"))), lambda x: x["k"]).alias(column))


def _other(sets: DataFrame) -> DataFrame:
    return sets.select(*[F.col(c).alias("o_" + c) for c in sets.columns])


def subset_candidates(sets: DataFrame) -> DataFrame:
    """Rows of sets (name, words, ...) with those (o_...) that have the name's rarest word, as every superset has."""
    probe = sets.select("*", F.get("words", F.lit(0)).alias("k"))
    return probe.join(_other(sets).select("*", F.explode("o_words").alias("k")), "k").drop("k")


def overlap_candidates(sets: DataFrame) -> DataFrame:
    """Rows of sets with two stems or more, with those that can share more than half of the smaller set's stems.

    Of the smaller set of m stems, more than half of them shared, one of the rarest m - m // 2 is.
    """
    many = sets.filter(F.size("stems") > 1)
    probe = many.select("*", F.explode(F.slice("stems", F.lit(1), F.size("stems") - F.floor(F.size("stems") / 2).cast("int"))).alias("k"))
    pairs = probe.join(_other(many).select("*", F.explode("o_stems").alias("k")), "k").filter((F.size("stems") <= F.size("o_stems")) & (F.col("name") != F.col("o_name")))
    return pairs.drop("k").dropDuplicates(["name", "o_name"])


def subset_merges(standards: DataFrame) -> DataFrame:
    """name, target: a standard whose words are a part of a longer one's, or whose stems overlap by more than half.

    standards has name and types. When several targets fit, the last in (length, code
    point) order wins. Supersets are met at a name's rarest word and overlaps at the rarer
    half of the smaller set. A set of one stem overlaps with all that have it: of these
    only the last of each list of types is looked at, so a stem that all names have costs
    a row for each name.
    """
    w = standards.select("name", "types", F.array_distinct(X.words(F.col("name"))).alias("words"))
    w = w.withColumn("stems", F.array_distinct(F.transform(F.filter("words", lambda x: F.length(x) > 4), lambda x: F.left(x, F.lit(4)))))
    empty = F.array().cast("array<string>")
    sets = w.select("name", "types").join(_by_frequency(w, "words"), "name", "left").join(_by_frequency(w, "stems"), "name", "left")
    sets = stored(sets.select("name", "types", F.coalesce("words", empty).alias("words"), F.coalesce("stems", empty).alias("stems")), "name-sets")
    longer = lambda a, b: (F.length(a) > F.length(b)) | ((F.length(a) == F.length(b)) & (F.col(a) > F.col(b)))
    fits = compatible(F.col("types"), F.col("o_types"))

    inside = subset_candidates(sets).filter(longer("o_name", "name") & (F.size(F.array_except("words", "o_words")) == 0) & fits).select("name", F.col("o_name").alias("target"))
    shared = overlap_candidates(sets).filter((2 * F.size(F.array_intersect("stems", "o_stems")) > F.size("stems")) & fits)
    up = longer("o_name", "name")
    shared = shared.select(F.when(up, F.col("name")).otherwise(F.col("o_name")).alias("name"), F.when(up, F.col("o_name")).otherwise(F.col("name")).alias("target"))

    stems = sets.select("name", "types", F.size("stems").alias("n"), F.explode("stems").alias("k"))
    last = lambda rows: rows.groupBy("k", F.col("types").alias("o_types")).agg(F.max(F.struct(F.length("name").alias("l"), "name")).alias("m")).select("k", "o_types", F.col("m.name").alias("o_name"))
    ones = stems.filter("n = 1")
    alone = ones.join(last(stems), "k").unionByName(stems.join(last(ones), "k")).filter(longer("o_name", "name") & fits).select("name", F.col("o_name").alias("target"))
    fit = inside.unionByName(shared).unionByName(alone)
    return fit.groupBy("name").agg(F.max_by("target", F.struct(F.length("target"), "target")).alias("target"))


def fixpoint(merges: DataFrame) -> DataFrame:
    """name, target with targets followed to their ends by pointer jumping; targets grow in order, so there is no cycle."""
    cur = checkpoint(merges)
    while True:
        nxt = cur.select(F.col("name").alias("target"), F.col("target").alias("next"))
        new = checkpoint(cur.join(nxt, "target", "left").select("name", F.coalesce("next", "target").alias("target"), F.col("next").isNotNull().alias("moved")))
        cur = new.select("name", "target")
        if not new.filter("moved").limit(1).count():
            return cur


def standardize(triples: DataFrame) -> DataFrame:
    """Triples with standard names and short predicates, without loops."""
    t = validate(triples, ("subject", "predicate", "object"))
    details = checkpoint(entity_details(t))
    first = normal_groups(details)
    types = first.join(details, "name").groupBy("standard").agg(F.array_distinct(F.flatten(F.collect_list("types"))).alias("types"))
    merges = fixpoint(subset_merges(types.select(F.col("standard").alias("name"), "types")))
    final = checkpoint(first.join(merges.withColumnRenamed("name", "standard"), "standard", "left").select("name", F.coalesce("target", "standard").alias("standard")))
    out = t.join(final.select(F.col("name").alias("sk"), F.col("standard").alias("s2")), F.lower("subject") == F.col("sk"))
    out = out.join(final.select(F.col("name").alias("ok"), F.col("standard").alias("o2")), F.lower("object") == F.col("ok"))
    new = {"subject": "s2", "object": "o2"}
    out = out.filter("s2 <> o2")
    return out.select(*[X.limit_predicate(F.col(c)).alias(c) if c == "predicate" else F.col(new.get(c, c)).alias(c) for c in triples.columns])


def transitive(triples: DataFrame) -> DataFrame:
    """Two-step inferences s -> o through m between pairs without an edge; predicates cut to three words."""
    pair = triples.groupBy("subject", "object").agg(F.max_by("predicate", "ord").alias("p"))
    a = pair.select(F.col("subject").alias("s"), F.col("object").alias("m"), F.col("p").alias("p1"))
    b = pair.select(F.col("subject").alias("m"), F.col("object").alias("o"), F.col("p").alias("p2"))
    hops = a.join(b, "m").filter("s <> o")
    fresh = hops.join(pair.select(F.col("subject").alias("s"), F.col("object").alias("o")), ["s", "o"], "left_anti")
    said = X.limit_predicate(F.concat_ws(" ", "p1", F.lit("via"), "m", F.lit("leading to"), "p2"))
    return fresh.select(F.col("s").alias("subject"), said.alias("predicate"), F.col("o").alias("object")).distinct().withColumns({"inferred": F.lit(True), "confidence": F.lit(0.7)})


def _common(names: DataFrame) -> DataFrame:
    """n, k, c: the words of each name that other names have too, and how many names have them."""
    w = names.select("n", F.explode(F.array_distinct(X.words(F.col("n")))).alias("k"))
    return w.join(w.groupBy("k").agg(F.count("*").alias("c")).filter("c > 1"), "k").select("n", "k", "c")


def sharing(names: DataFrame, at_once: int = 2000) -> DataFrame:
    """a, b (a < b): every two names (n) with a common word, each pair once, at the first of its common words.

    Names of a frequent word are dealt to blocks of about `at_once`, each of which meets all
    of them. A task holds blocks and lets the others go by, so that pairs come with few
    different a in a row, which files pack well. Whether a pair has an earlier common word
    is mostly told by bits of the earlier words; only where these meet are words compared.
    """
    sets = _common(names).groupBy("n").agg(F.array_sort(F.collect_list(F.struct("k", F.ceil(F.col("c") / at_once).cast("int").alias("blocks")))).alias("s"))
    w = sets.select("n", F.posexplode("s").alias("i", "x"), F.col("s.k").alias("ks")).select("n", "x.k", "x.blocks", F.slice("ks", F.lit(1), F.col("i")).alias("before"))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))
    w = w.withColumn("bits", F.aggregate("before", F.lit(0).cast("long"), lambda sofar, x: sofar.bitwiseOR(bit(x))))
    left = w.select("k", F.pmod(F.xxhash64("n"), F.col("blocks")).cast("int").alias("block"), F.col("n").alias("a"), F.col("before").alias("wa"), F.col("bits").alias("ba"))
    right = w.select("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("n").alias("b"), F.col("before").alias("wb"), F.col("bits").alias("bb"))
    first = F.when(F.col("ba").bitwiseAND(F.col("bb")) == 0, True).otherwise(~F.arrays_overlap("wa", "wb"))
    return left.hint("shuffle_hash").join(right, ["k", "block"]).filter("a < b").filter(first).select("a", "b")


def sharing_counts(names: DataFrame) -> DataFrame:
    """n, partners: how many other names (n) have a word of each name that has such; no pair of names is listed.

    Names with the same set of common words are one class: every two of a class share a
    word, and of two classes all names do or none.
    """
    sets = stored(_common(names).groupBy("n").agg(F.array_join(F.array_sort(F.collect_list("k")), " ").alias("set")), "word-sets")
    sizes = stored(sets.groupBy("set").agg(F.count("*").alias("size")), "word-set-sizes")
    met = sharing(sizes.select(F.col("set").alias("n")))
    met = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = met.join(sizes, F.col("b") == F.col("set")).groupBy(F.col("a").alias("set")).agg(F.sum("size").alias("others"))
    partners = sizes.join(others, "set", "left").select("set", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("partners"))
    return sets.join(partners, "set").select("n", "partners")


def lexical(triples: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Inferences between unlinked names: a shared word relates them, and a contained name is the longer one's type.

    Names that contain each other but share no word are found by the stretches of all names
    that are names. No row comes twice, so nothing is made distinct. With `among` (n, in lower
    case) pairs of these names only are looked for.
    """
    names = triples.select(F.lower("subject").alias("n")).unionByName(triples.select(F.lower("object").alias("n"))).distinct() if among is None else among.distinct()
    shared, inside = _lexical_parts(triples, names)
    out = shared.select(F.col("a").alias("subject"), F.lit("related to").alias("predicate"), F.col("b").alias("object"))
    out = out.union(inside.select("long", F.lit("is type of"), "short"))
    return out.withColumns({"inferred": F.lit(True), "confidence": F.lit(0.4)})


def _overlap(a: str, b: str) -> Column:
    return F.arrays_overlap(X.words(F.col(a)), X.words(F.col(b)))


def _linked(triples: DataFrame) -> DataFrame:
    """a <= b: the names, in lower case, of each triple, each two once."""
    ends = triples.select(F.lower("subject").alias("a"), F.lower("object").alias("b"))
    return stored(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "linked")


def _inside(names: DataFrame, index: Names, linked: DataFrame) -> DataFrame:
    """long, short: unlinked names that contain each other but share no word."""
    held = holding(names.toDF("mention"), index).filter((F.col("name") != F.col("mention")) & F.col("name").contains(F.col("mention"))).toDF("short", "long")
    keyed = held.filter(~_overlap("long", "short")).select("long", "short", F.least("long", "short").alias("a"), F.greatest("long", "short").alias("b"))
    return keyed.join(linked, ["a", "b"], "left_anti").select("long", "short")


def _lexical_parts(triples: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b: the unlinked pairs of names with a shared word; long, short: those without one that contain each other."""
    index, linked = write_index(names), _linked(triples)
    shared = sharing(index.names.select(F.col("name").alias("n"))).join(stored(linked.filter(_overlap("a", "b")), "linked-alike"), ["a", "b"], "left_anti")
    return shared, _inside(names, index, linked)


def dedupe(triples: DataFrame) -> DataFrame:
    """One row per (subject, predicate, object): originals before inferences, then the first."""
    w = Window.partitionBy("subject", "predicate", "object").orderBy(F.coalesce("inferred", F.lit(False)), "ord")
    return triples.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def _few(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Originals with transitive inferences, stored without duplicates; and those of them that a lexical inference may be."""
    base = triples.select("subject", "predicate", "object", F.lit(False).alias("inferred"), F.lit(1.0).alias("confidence"), "ord")
    few = stored(dedupe(base.unionByName(transitive(triples).withColumn("ord", F.lit(1 << 60)))), "inferred-few")
    return few, stored(few.filter(F.col("predicate").isin("related to", "is type of")).select("subject", "predicate", "object"), "inferred-known")


def infer(triples: DataFrame) -> DataFrame:
    """Originals with transitive and lexical inferences, without duplicates; the lexical ones are many and come once each."""
    few, known = _few(triples)
    many = lexical(triples).withColumn("ord", F.lit(1 << 60)).join(known, ["subject", "predicate", "object"], "left_anti")
    return few.unionByName(many)


def infer_counts(triples: DataFrame) -> DataFrame:
    """nodes, edges, original, inferred_pairs of infer(), whose pairs with a shared word are counted by classes of names and not listed."""
    few, known = _few(triples)
    names = triples.select(F.lower("subject").alias("n")).unionByName(triples.select(F.lower("object").alias("n"))).distinct()
    index, linked = write_index(names), _linked(triples)
    names = index.names.select(F.col("name").alias("n"))
    alike = stored(linked.filter("a < b").filter(_overlap("a", "b")), "linked-alike")
    inside = stored(_inside(names, index, linked), "inside")
    own = alike.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count("*").alias("linked"))
    free = stored(sharing_counts(names).join(own, "n", "left").select("n", (F.col("partners") - F.coalesce("linked", F.lit(0))).alias("free")), "free-partners")

    def listed(pairs: DataFrame, predicate: str) -> DataFrame:
        """Those of some distinct pairs (subject, object) that have a lexical inference of this predicate."""
        if predicate == "is type of":
            return pairs.join(inside.select(F.col("long").alias("subject"), F.col("short").alias("object")), ["subject", "object"], "left_semi")
        for end in ("subject", "object"):
            pairs = pairs.join(names.select(F.col("n").alias(end)), end, "left_semi")
        return pairs.filter("subject < object").filter(_overlap("subject", "object")).join(alike.toDF("subject", "object"), ["subject", "object"], "left_anti")

    old = few.filter("inferred").select("subject", "object").distinct()
    new = {p: listed(old, p).join(known.filter(F.col("predicate") == p), ["subject", "object"], "left_anti") for p in ("related to", "is type of")}
    again = {p: listed(known.filter(F.col("predicate") == p).select("subject", "object"), p) for p in new}
    count = lambda df, c: df.agg(F.count("*").alias(c))
    sums = [
        few.agg(F.count("*").alias("n"), F.count_if(~F.col("inferred")).alias("original")), count(old, "pairs"), free.agg(F.coalesce(F.sum("free"), F.lit(0)).alias("free")), count(inside, "inside"),
        count(again["related to"].unionByName(again["is type of"]), "again"), count(new["related to"].unionByName(new["is type of"]), "hits"),
    ]
    ends = lambda df, *c: df.select(F.explode(F.array(*c)).alias("node"))
    nodes = ends(few, "subject", "object").unionByName(ends(inside, "long", "short")).unionByName(free.filter("free > 0").select(F.col("n").alias("node"))).distinct()
    one = reduce(DataFrame.crossJoin, sums, count(nodes, "nodes"))  # one row each
    many = F.expr("free div 2") + F.col("inside") - F.col("again")
    return one.select("nodes", (F.col("n") + many).alias("edges"), "original", (F.col("pairs") + many - F.col("hits")).alias("inferred_pairs"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node of it) of an undirected graph with columns a, b: least labels with skipping."""
    both = checkpoint(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("c"))
    label = checkpoint(label)
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("c").alias("near"))
        one = label.join(near, label["node"] == near["a"], "left").select("node", F.least("c", F.coalesce("near", "c")).alias("n"), F.col("c").alias("old"))
        top = label.select(F.col("node").alias("n"), F.col("c").alias("top"))
        new = checkpoint(one.join(top, "n", "left").select("node", F.least("n", F.coalesce("top", "n")).alias("c"), "old"))
        label = new.select("node", "c")
        if not new.filter("c <> old").limit(1).count():
            return label.select("node", F.col("c").alias("component"))


def undirected(triples: DataFrame) -> DataFrame:
    """Distinct undirected pairs a <= b."""
    return triples.select(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b")).distinct()


def degree(pairs: DataFrame) -> DataFrame:
    """node, degree; a loop counts twice."""
    return pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))


#: Power iterations of one job; rows (source, node) of a betweenness block.
STEPS, ROWS_AT_ONCE = 8, 200_000_000


def twins(links: DataFrame) -> DataFrame:
    """node, c: the least of the nodes that are linked with the very same nodes, by the count and two sums of hashes of these; links (f, t) go both ways.

    Leaves of one hub, and whatever else hangs on the same nodes, are one class: paths and
    centrality are worked out for classes, however many nodes these have.
    """
    h = lambda i: F.sum(F.xxhash64(F.lit(i), "t").cast("decimal(20,0)")).alias(f"h{i}")
    near = links.groupBy("f").agg(F.count("*").alias("n"), h(1), h(2))
    first = near.groupBy("n", "h1", "h2").agg(F.min("f").alias("c"))
    return stored(near.join(first, ["n", "h1", "h2"]).select(F.col("f").alias("node"), "c"), "twins")


def _between(links: DataFrame, classes: DataFrame) -> DataFrame:
    """f, t, k: of the first node of class f, how many neighbours class t has."""
    end = classes.select(F.col("node").alias("t"), "c")
    firsts = classes.filter("node = c").select(F.col("c").alias("f"))
    return links.join(firsts, "f", "left_semi").join(end, "t").groupBy("f", F.col("c").alias("t")).agg(F.count("*").cast("double").alias("k"))


def eigenvector(pairs: DataFrame, rounds: int = 1000, tolerance: float = 1e-6) -> DataFrame:
    """node, eigenvector: power iteration on A + I from equal weights; raises if it doesn't settle.

    Nodes with the same neighbours have the same value in every iteration, so classes of
    them are iterated. STEPS iterations are one job of joins and sums, whose result is
    scaled and stored; it has settled when these together move a node by less than
    `tolerance` in the mean.
    """
    both = pairs.select(F.col("a").alias("f"), F.col("b").alias("t")).union(pairs.select("b", "a")).distinct()
    classes = twins(both)
    sizes = stored(classes.groupBy(F.col("c").alias("node")).agg(F.count("*").cast("double").alias("size")), "eigenvector-sizes")
    own = sizes.select(F.col("node").alias("f"), F.col("node").alias("t"), F.lit(1.0).alias("k"))
    links = stored(_between(both, classes).unionByName(own).groupBy("f", "t").agg(F.sum("k").alias("k")), "eigenvector-links")
    x = stored(sizes.select("node", "size", F.lit(1.0).alias("x")), "eigenvector")
    n = classes.count()
    for _ in range(0, rounds, STEPS):
        z = x.select("node", "x")
        for _ in range(STEPS):
            z = links.join(z, F.col("t") == F.col("node")).groupBy(F.col("f").alias("node")).agg(F.sum(F.col("k") * F.col("x")).alias("x"))
        z = stored(z.join(sizes, "node"), "eigenvector-steps")
        norm = z.agg(F.sqrt(F.sum(F.col("size") * F.col("x") * F.col("x")))).first()[0] or 1.0
        new = stored(z.select("node", "size", (F.col("x") / norm).alias("x")), "eigenvector")
        moved = new.join(x.select("node", F.col("x").alias("old")), "node").agg(F.sum(F.col("size") * F.abs(F.col("x") - F.col("old")))).first()[0] or 0.0
        forget(x, z)
        x = new
        if moved <= n * tolerance:
            forget(links, sizes)
            return classes.join(x.select(F.col("node").alias("c"), "x"), "c").select("node", F.col("x").alias("eigenvector"))
    raise ValueError(f"the eigenvector has not settled after {rounds} rounds")


def _levels(links: DataFrame, sources: DataFrame) -> list[DataFrame]:
    """Of each distance, stored: s, v, paths: the shortest paths from a node of the classes s (id) to one of the classes v that far away."""
    levels = [stored(sources.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths"), F.lit(1.0).alias("start")), "betweenness-level")]
    sizes = links.select(F.col("f"), F.col("t"), "own")
    while True:
        through = F.col("paths") * F.coalesce("start", "own")  # a path begins at one node of its class and may go through any of the others
        step = levels[-1].join(sizes, F.col("v") == F.col("f")).groupBy("s", F.col("t").alias("v")).agg(F.sum(through).alias("paths"))
        for seen in levels[-2:]:  # a neighbour of a node is at its distance, or one nearer or further
            step = step.join(seen.select("s", "v"), ["s", "v"], "left_anti")
        step = stored(step.withColumn("start", F.lit(None).cast("double")), "betweenness-level")
        if step.isEmpty():
            forget(step)
            return levels
        levels.append(step)


def _gains(links: DataFrame, levels: list[DataFrame], classes: DataFrame) -> DataFrame:
    """v, gain: the shares of shortest paths from all asked nodes that go through one node of class v, collected from the furthest classes back.

    A node of the class that is left is two steps away, by one path through each neighbour.
    """
    known = lambda to: classes.select(F.col("id").alias(to), "size", "asked", "neighbours")
    found, behind = [], levels[-1].withColumn("gain", F.lit(0.0))
    for i, level in reversed(list(enumerate(levels))[1:]):
        if i < len(levels) - 1:
            share = behind.join(known("v"), "v").select("s", F.col("v").alias("f"), (F.col("size") * (1 + F.col("gain")) / F.col("paths")).alias("q"))
            share = share.join(links.select("f", "t"), "f").groupBy("s", F.col("t").alias("v")).agg(F.sum("q").alias("q"))
            behind = level.join(share, ["s", "v"], "left").select("s", "v", "paths", (F.col("paths") * F.coalesce("q", F.lit(0.0))).alias("gain"))
            behind = stored(behind, "betweenness-gain")
            found.append(behind.join(known("s"), "s").select("v", (F.col("gain") * F.col("asked")).alias("gain")))
        if i == 1:
            found.append(level.join(known("s"), "s").select("v", ((F.col("size") - 1) / F.col("neighbours") * F.col("asked")).alias("gain")))
    none = levels[0].select("v", F.lit(0.0).alias("gain")).limit(0)
    total = reduce(DataFrame.unionByName, found, none).groupBy("v").agg(F.sum("gain").alias("gain"))
    return stored(total, "betweenness-block")


def betweenness(pairs: DataFrame, sources: int | None = None) -> DataFrame:
    """node, betweenness (normalised): Brandes' sums, level by level as joins over (source, node, paths).

    Sources and nodes are classes of nodes with the same neighbours, counted as often as
    they have nodes, which gives the same sums. Sources are worked off in blocks, so that a
    block has at most ROWS_AT_ONCE rows (or one source). With `sources`, the paths from so
    many nodes only, the first by a hash, stand for all: an estimate for graphs whose every
    pair is too much.
    """
    nodes = stored(degree(pairs).select("node"), "betweenness-nodes")
    one = pairs.filter("a <> b").select(F.col("a").alias("f"), F.col("b").alias("t"))
    both = stored(one.union(one.select("t", "f")).distinct(), "betweenness-both")
    member = twins(both)
    n = member.count()
    asked = member
    if sources is not None and sources < n:
        asked = stored(member.orderBy(F.xxhash64("node"), "node").limit(sources), "betweenness-sources")
    k = asked.count()
    between = _between(both, member)
    about = between.groupBy(F.col("f").alias("c")).agg(F.sum("k").alias("neighbours"))
    sizes = member.groupBy("c").agg(F.count("*").cast("double").alias("size")).join(asked.groupBy("c").agg(F.count("*").cast("double").alias("asked")), "c", "left")
    classes = stored(sizes.join(about, "c").withColumn("id", F.monotonically_increasing_id()), "betweenness-classes")
    number = lambda c, to, *more: classes.select(F.col("c").alias(c), F.col("id").alias(to), *more)
    links = between.select(F.col("f").alias("a"), F.col("t").alias("b")).join(number("a", "f", F.col("size").alias("own")), "a").join(number("b", "t"), "b").select("f", "t", "own")
    links = stored(links, "betweenness-links")
    begun = classes.filter("asked > 0")
    blocks = max(1, -(-begun.count() * classes.count() // ROWS_AT_ONCE))
    parts = []
    for i in range(blocks):
        levels = _levels(links, begun.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i))
        parts.append(_gains(links, levels, classes))
        forget(*levels)
    sums = reduce(DataFrame.unionByName, parts).groupBy(F.col("v").alias("id")).agg(F.sum("gain").alias("gain")).join(classes.select("id", "c"), "id")
    scale = (n / k if k else 1.0) / ((n - 1) * (n - 2)) if n > 2 else 1.0
    of = member.join(sums, "c").select("node", "gain")
    out = stored(nodes.join(of, "node", "left").select("node", (F.coalesce("gain", F.lit(0.0)) * scale).alias("betweenness")), "betweenness")
    forget(nodes, both, member, classes, links, *parts)
    return out


def node_size(metrics: DataFrame) -> DataFrame:
    """node, size: 10 plus 20 times the weighted shares of the largest degree, betweenness and eigenvector value."""
    top = metrics.agg(*[F.max(c).alias("m_" + c) for c in ("degree", "betweenness", "eigenvector")])
    share = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("m_" + c)), F.lit(0.0))
    joined = metrics.crossJoin(F.broadcast(top))  # one row
    return joined.select("node", (10 + 20 * (0.5 * share("degree") + 0.3 * share("betweenness") + 0.2 * share("eigenvector"))).alias("size"))


def _modularity(links: DataFrame, own: DataFrame, total: float) -> tuple[float, int]:
    """Share of the links inside communities less the share that degrees alone would put there; and nodes that would move."""
    c = lambda end: own.select(F.col("node").alias(end), F.col("c").alias(f"c_{end}"))
    within = links.join(c("a"), "a").join(c("b"), "b").filter("c_a = c_b").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("x"))
    chance = own.groupBy("c").agg(F.sum("k").alias("k"), F.count_if("wants").alias("n")).agg(F.sum(F.col("k") * F.col("k")).alias("y"), F.sum("n").alias("n"))
    row = within.crossJoin(chance).first()  # one row each
    return row["x"] / total - row["y"] / total**2, row["n"]


def _moved(links: DataFrame, own: DataFrame, total: float, turn: int) -> DataFrame:
    """node, c, k, wants: the half of the nodes whose turn it is are in the community that they gain most by; `wants` marks all that would go."""
    away = links.filter("a <> b").join(own.select(F.col("node").alias("b"), "c"), "b").groupBy(F.col("a").alias("node"), "c").agg(F.sum("w").alias("w"))
    nodes = own.select("node", F.col("c").alias("here"), "k")
    stay = nodes.select("node", F.col("here").alias("c"), F.lit(0.0).alias("w"))
    offers = away.unionByName(stay).groupBy("node", "c").agg(F.sum("w").alias("w")).join(nodes, "node")
    sums = own.groupBy("c").agg(F.sum("k").alias("sum"))
    stays = F.col("c") == F.col("here")
    gain = F.col("w") - F.col("k") * (F.col("sum") - F.when(stays, F.col("k")).otherwise(0.0)) / total
    best = offers.join(sums, "c").groupBy("node").agg(F.min_by("c", F.struct(-F.round(gain, 9), ~stays, "c")).alias("to"))
    goes = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0
    return own.drop("wants").join(best, "node").select("node", F.when(goes, F.col("to")).otherwise(F.col("c")).alias("c"), "k", (F.col("to") != F.col("c")).alias("wants"))


def communities(pairs: DataFrame, least: float = 1e-6) -> DataFrame:
    """node, community (its smallest node): modularity raised level by level, always the same.

    On a level, rounds let half of the nodes move at a time, picked by hashes; a round
    that doesn't raise the modularity by `least` is taken back, and three of these in a
    row, or a round in which no node would move, end the level. Communities are the nodes of the next level; a level without a
    gain ends it all, so modularity never falls and there is no bound on rounds.
    """
    both = pairs.select("a", "b").union(pairs.select("b", "a")).filter("a <> b").distinct()
    links = stored(both.withColumn("w", F.lit(1.0)), "community-links")
    member = degree(pairs).select("node", F.col("node").alias("c"))
    total = links.agg(F.sum("w")).first()[0]
    if not total:
        return member.select("node", F.col("c").alias("community"))
    turn, gained = 0, True
    while gained:
        own = stored(links.groupBy("a").agg(F.sum("w").alias("k")).select(F.col("a").alias("node"), F.col("a").alias("c"), "k", F.lit(True).alias("wants")), "community-own")
        (quality, _), gained, idle = _modularity(links, own, total), False, 0
        while idle < 3:
            new = stored(_moved(links, own, total, turn), "community-own")
            turn += 1
            q, wanting = _modularity(links, new, total)
            if not wanting:
                break
            if q > quality + least:
                forget(own)
                own, quality, gained, idle = new, q, True, 0
            else:
                forget(new)
                idle += 1
        if not gained:
            break
        part = own.select(F.col("node").alias("c"), F.col("c").alias("to"))
        member = stored(member.join(part, "c", "left").select("node", F.coalesce("to", "c").alias("c")), "community-members")
        ends = lambda end: part.select(F.col("c").alias(end), F.col("to").alias(f"to_{end}"))
        merged = links.join(ends("a"), "a").join(ends("b"), "b").groupBy("to_a", "to_b").agg(F.sum("w").alias("w"))  # noqa: B023
        coarser = stored(merged.select(F.col("to_a").alias("a"), F.col("to_b").alias("b"), "w"), "community-links")
        forget(links, own)
        links = coarser
    names = member.groupBy("c").agg(F.min("node").alias("community"))
    return member.join(names, "c").select("node", "community")
