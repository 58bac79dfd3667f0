"""Near-duplicate operators against brute force on small fixtures."""

import random

import numpy as np
import pytest

from graphloom.llm import embeddings, jaccard, licenses, substring
from graphloom.llm.common import components


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute(items, linked):
    parent = {k: k for k in items}
    keys = sorted(items)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if linked(items[a], items[b]):
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    return {k: find(parent, k) for k in keys}


def test_components_of_paths_stars_and_cliques(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000 - i, 5000) for i in range(1, 100)]
    edges += [(rng.randint(9000, 9200), rng.randint(9000, 9200)) for _ in range(150)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e}
    parent = {k: k for k in nodes}
    for a, b in edges:
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    assert got == {k: find(parent, k) for k in nodes if find(parent, k) != k}


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def near_texts(rng):
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 12, 30, 150, 400]))]
        for _ in range(12):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    return texts + ["", None, "one", "ONE", "one two", "É x", "é x", "\n"]


@pytest.mark.parametrize("size,per_cent", [(3, 90), (5, 80)])
def test_jaccard_join_equals_brute_force(spark, size, per_cent):
    texts = near_texts(random.Random(size))
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, texts[0], "x", 1), (3, texts[3], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, token int")
    got = jaccard.join(docs, size=size, per_cent=per_cent).collect()
    assert len(got) == len(rows)
    sets = {i: shingles(t, size) for i, t in enumerate(texts)}
    want = brute(sets, lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= per_cent * len(a | b))
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])


def test_rows_of_one_id_are_one_document(spark):
    words = lambda k: " ".join(f"{k}{i}" for i in range(60))
    a, b = words("a"), words("b")
    near = b.replace("b30", "changed")
    rows = [(2, a), (5, a), (5, b), (6, near), (9, words("c")), (9, words("d")), (11, words("d")), (12, words("e"))]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), size=3, per_cent=80).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(2, 2), (5, 2), (6, 2), (9, 9), (11, 9), (12, 12)}


def test_the_largest_id_is_not_null(spark):
    text = " ".join(f"w{i}" for i in range(90))
    docs = spark.createDataFrame([(1, text), ((1 << 63) - 1, text), (None, text)], "doc_id long, text string")
    found = substring.find(docs)
    assert sorted((str(r["doc_id"]), r["group_doc_id"], r["removed"]) for r in found.filter("removed").select("doc_id", "group_doc_id", "removed").distinct().collect()) == [("9223372036854775807", 1, True), ("None", 1, True)]
    assert [r["doc_id"] for r in substring.remove(docs, found).collect()] == [1]


def test_what_repeats_goes_whole(spark):
    lines = [" ".join(f"w{i}" for i in range(80)), " ".join(f"t{i}" for i in range(10))]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines)), (3, lines[0] + "\nother words")], "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in substring.remove(docs, substring.find(docs)).collect()}
    assert left == {1: "\n".join(lines), 3: "other words"}


def test_jaccard_tokens_are_always_shared():
    rng = np.random.default_rng(0)
    for n in (10, 11, 25, 60, 99, 100, 400):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
            b = a.copy()
            while True:
                c = np.unique(np.concatenate([np.delete(b, rng.integers(len(b))), rng.integers(0, 1 << 60, rng.integers(0, 2)).astype(np.uint64)]))
                both = len(np.intersect1d(a, c))
                if 100 * both < 90 * (len(a) + len(c) - both):
                    break
                b = c
            if len(b) != len(a) or (a != b).any():
                common = np.intersect1d(jaccard.set_tokens(a, 90), jaccard.set_tokens(b, 90)) & np.uint64(63)
                assert any((common == k).sum() > jaccard.parts_of(int(k), 90)[2] for k in set(common))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join(docs).count() == 0
    assert substring.duplicates(docs).count() == 0
    assert licenses.scan(docs).count() == 0
    assert embeddings.join(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_of_one_id_keep_their_own_links(spark):
    x, near, y = [1.0, 0.0, 0.0], [0.99, 0.1, 0.0], [0.0, 0.0, 1.0]
    rows = [(5, x, 1), (5, y, 1), (7, near, 1), (9, [0.0, 1.0, 0.0], 1), (9, y, 1)]
    got = embeddings.join(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")).collect()
    assert sorted(map(tuple, got)) == [(5, 1, 5, True), (5, 1, 5, True), (7, 1, 5, False), (9, 0, 9, True), (9, 1, 5, False)]


def test_grouped_vectors_skip_most_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(embeddings, "BLOCK", 64)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 32))
    x = np.repeat(base, 64, 0) + rng.normal(size=(2560, 32)) * 0.05
    x /= np.sqrt((x * x).sum(1))[:, None]
    axes = embeddings.principal_axes(x)
    cells = (np.floor((x @ axes) / np.sqrt(0.2)) + 128).astype(np.uint8)
    rows = sorted((cells[i].tobytes(), i) for i in range(len(x)))
    rows = spark.createDataFrame([(i, 1, x[i].tobytes(), c) for c, i in rows], "class long, copies long, unit binary, cells binary").coalesce(1)
    blocks = rows.mapInArrow(embeddings._blocker(axes), embeddings.BLOCKS)
    n = blocks.count()
    assert 40 <= n < 80 and embeddings.block_pairs(blocks, 0.9).count() < 0.5 * n * (n + 1) / 2
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert embeddings.join(vectors).agg(F.min("n_links"), F.count_distinct("component_id")).first()[:] == (63, 40)


def test_embedding_join_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 16))
    rows = []
    for i in range(400):
        x = base[rng.integers(30)] + rng.normal(size=16) * rng.choice([0, 0.1, 0.25, 0.4])
        rows.append((i, [float(v) for v in x.astype(np.float32) * 3]))
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [None] * 16), (404, rows[0][1]), (405, rows[0][1][:5]), (None, rows[0][1])]
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    monkeypatch.setattr(embeddings, "LEAF", 16)
    got = {r["vec_id"]: r for r in embeddings.join(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert len(got) == len(rows) and got[None]["component_id"] is None

    def vector(v):
        u = embeddings.unit(v)
        return None if u is None else np.concatenate([u, np.zeros(16 - len(u))])

    vectors = {k: vector(v) for k, v in rows if k is not None}
    linked = lambda a, b: a is not None and b is not None and a @ b >= 0.9
    want = brute(vectors, linked)
    for k, v in vectors.items():
        n = sum(linked(v, w) for j, w in vectors.items() if j != k)
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (n, want[k], want[k] == k)


def words_of(rng, n):
    return [f"x{rng.randrange(5000)}" for _ in range(n)]


def test_repeated_passages_are_found_and_clean_ones_left(spark):
    rng = random.Random(7)
    line = lambda n: " ".join(words_of(rng, n))
    passage, near, inner = line(60), words_of(rng, 60), line(90)
    rows = [(i, "\n".join(line(rng.randint(21, 40)) for _ in range(4)) + "\nshort common line") for i in range(40)]
    other = list(near)
    other[30] = "changed"
    rows[3] = (3, rows[3][1] + "\n" + passage)
    rows[9] = (9, passage.upper() + "\n" + rows[9][1])
    rows[12] = (12, " ".join(near) + "\n" + rows[12][1])
    rows[13] = (13, rows[13][1] + "\n" + " ".join(other) + "\né")
    rows[20] = (20, line(80) + " " + inner + " " + line(70))
    rows[21] = (21, line(33) + " " + inner + " " + line(99))
    rows += [(50, None), (51, ""), (52, rows[0][1]), (None, passage)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, h int")
    got = substring.duplicates(docs).collect()
    by = {}
    texts = {k: t for k, t in rows if k is not None}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
        if r["doc_id"] is not None:
            shown = texts[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert len(shown.split()) == r["n_words"]
    assert set(by) == {0, 3, 9, 12, 13, 20, 21, 52, None}
    assert {r["removed"] for r in by[3]} == {False} and {r["removed"] for r in by[9]} == {True} == {r["removed"] for r in by[13]}
    assert by[9][0]["group_doc_id"] == 3 and by[None][0]["removed"]
    assert sum(r["n_words"] for r in by[21]) >= 40
    left = {r["doc_id"]: r for r in substring.remove(docs, substring.duplicates(docs)).collect()}
    assert left[3]["text"] == texts[3] and passage.upper() not in left[9]["text"]
    assert left[9]["text"] == texts[9][len(passage) + 1 :] and left[13]["text"].endswith("short common line\né")
    assert 52 not in left and left[50]["text"] is None and left[51]["text"] == ""


def removed_words(texts, got):
    """Places of the words of each document that lie in removed rows."""
    out = {}
    for r in got:
        shown = texts[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(shown.split()) == r["n_words"]
        if r["removed"]:
            at = len(texts[r["doc_id"]][: r["start"]].split())
            out.setdefault(r["doc_id"], set()).update(range(at, at + r["n_words"]))
    return out


def earlier_words(texts, n, within=True):
    """Places of the words of each document that lie in n words that occurred before, but for what an overlapping first keeps.

    Not within: before in another document.
    """
    first, out = {}, {}
    for d in sorted(texts):
        w = texts[d].lower().split()
        for i in range(len(w) - n + 1):
            e, j = first.setdefault(tuple(w[i : i + n]), (d, i))
            if (e, j) != (d, i) and (within or e != d):
                out.setdefault(d, set()).update(range(max(i, j + n) if e == d else i, i + n))
    return out


def test_runs_are_found_wherever_lines_break(spark):
    rng = random.Random(5)
    wrap = lambda words, n: "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))
    notice, edge, under = words_of(rng, 60), words_of(rng, 50), [f"u{i}" for i in range(49)]
    texts = {d: wrap(words_of(rng, 120), rng.choice([9, 30, 200])) for d in range(30)}
    texts[4] += "\n" + wrap(notice, 11)
    texts[7] = wrap(notice, 13) + "\n\n" + texts[7]
    texts[11] += " " + wrap([w.upper() for w in notice], 200) + "  é " + texts[11][:30]
    texts[14], texts[15] = texts[14] + " " + " ".join(edge), "é\n" + wrap(edge, 10)
    texts[16], texts[17] = texts[16] + "\n" + wrap(under, 12), wrap(under, 14) + "\n" + texts[17]
    texts[18] = " ".join(["la"] * 170)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sketched = substring.sketches(docs, "doc_id", "text", 50)
    for within in (True, False):
        windows = {}
        for r in substring.repeated_windows(sketched, 50, within).filter("removed").collect():
            windows.setdefault(r["d"], set()).update(range(r["start"], r["stop"]))
        assert windows == earlier_words(texts, 50, within)
    got = substring.duplicates(docs).collect()
    removed = removed_words(texts, got)
    assert all(own <= removed.get(d, set()) for d, own in earlier_words(texts, 50).items())
    assert removed[17] == set(range(49))  # the lines of a shorter passage are one paragraph
    assert {r["doc_id"] for r in got if not r["removed"]} == {4, 14, 16, 18}
    left = {r["doc_id"]: r["text"] for r in substring.remove(docs, substring.duplicates(docs)).collect()}
    assert left[4] == texts[4] and left[15] == "é" and left[7] == "\n" + texts[7].split("\n\n")[1]


def test_windows_equal_brute_force(spark):
    rng = random.Random(21)
    few = [f"v{i}" for i in range(40)]
    for trial in range(3):
        texts, pool = {}, [words_of(rng, rng.choice([30, 52, 70, 200])) for _ in range(6)]
        for d in range(60):
            own = []
            for _ in range(rng.randint(1, 5)):
                kind = rng.random()
                passage = rng.choice(pool)
                if kind < 0.5:
                    a = rng.randrange(max(1, len(passage) - 40))
                    own += passage[a : a + rng.choice([25, 49, 50, 51, 80, 300])]
                elif kind < 0.7:
                    own += [few[k % rng.choice([1, 2, 7, 33, 39])] for k in range(rng.choice([20, 60, 150]))]
                else:
                    own += words_of(rng, rng.choice([1, 5, 60]))
            texts[d] = " ".join(own)
        texts[60], texts[61] = texts[3], ""
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        sketched = substring.sketches(docs, "doc_id", "text", 50)
        for within in (True, False):
            got = {}
            for r in substring.repeated_windows(sketched, 50, within).filter("removed").collect():
                got.setdefault(r["d"], set()).update(range(r["start"], r["stop"]))
                a = texts[r["d"]].lower().split()[r["start"] : r["stop"]]
                assert len(a) == r["stop"] - r["start"]
            assert got == earlier_words(texts, 50, within), (trial, within)


def test_rows_of_one_id_and_of_none(spark):
    rng = random.Random(8)
    line = lambda n: " ".join(words_of(rng, n))
    passage = line(60)
    rows = [(1, line(80)), (1, line(30) + "\n" + passage), (1, line(90)), (5, passage + "\n" + line(40)), (None, line(25) + "\n" + passage), (None, line(70)), (5, "")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, k int, d string")
    left = substring.remove(docs, substring.duplicates(docs)).collect()
    want = [(d, t if k < 3 else t.replace(passage + "\n", "").replace("\n" + passage, "")) for k, (d, t) in enumerate(rows)]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in left))) == sorted(map(str, want))
    assert docs.columns == left[0].__fields__


@pytest.mark.parametrize("n,around", [(51, 6), (51, 30), (55, 4), (62, 1), (64, 90), (51, 300)])
def test_passages_inside_lines_are_found_whole(spark, n, around):
    rng = random.Random(n + around)
    texts = {}
    for k in range(25):
        passage = words_of(rng, n)
        texts[2 * k] = " ".join(passage)
        texts[2 * k + 1] = " ".join(words_of(rng, around) + passage + words_of(rng, around))
    got = substring.duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    removed, want = removed_words(texts, got), earlier_words(texts, 50)
    assert set(want) == {2 * k + 1 for k in range(25)} and all(want[d] <= removed.get(d, set()) for d in want)


def test_parts_of_kept_lines_count(spark):
    rng = random.Random(3)
    passage = words_of(rng, 45)
    long = " ".join(words_of(rng, 40) + passage + words_of(rng, 40))
    texts = {2: " ".join(words_of(rng, 50) + passage + words_of(rng, 50)), 5: long, 9: long}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = substring.duplicates(docs, run=45).collect()
    assert any(r["removed"] and r["group_doc_id"] == 2 for r in got if r["doc_id"] == 5)
    removed = removed_words(texts, got)
    assert removed[5] == set(range(40, 85)) and removed[9] == set(range(125)) and 2 not in removed


def test_every_pair_of_a_crowded_bucket_is_compared(spark):
    rng = random.Random(9)
    shared = words_of(rng, 50)
    own = lambda k, n: [f"y{k}_{i}_{rng.randrange(1 << 30)}" for i in range(n)]
    texts, base = {}, {}
    for k in range(2000):
        base[k] = own(k, 7)
        texts[k] = " ".join(shared + base[k])
    for k in range(200):
        texts[5000 + k] = " ".join(shared + base[k][:4] + own(k, 3))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["group_doc_id"] for r in substring.duplicates(docs).collect() if r["removed"] and r["n_words"] == 57}
    assert got == {5000 + k: k for k in range(200)}


def test_license_scan_equals_brute_force(spark):
    rng = random.Random(4)
    line = lambda n: " ".join(words_of(rng, n))
    templates = dict(licenses.TEMPLATES)
    rows = [(i, line(50)) for i in range(10)] + [(10, None), (11, ""), (12, "license"), (13, "under the software")]
    for i, (name, t) in enumerate(templates.items()):
        rows += [(100 + i, f"{line(33)}\n{t.upper()} {line(20)}"), (200 + i, t), (300 + i, " ".join(t.split()[: len(t.split()) // 2]))]
    rows.append((400, templates["MIT"].replace("modify", "change")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["license"]): r["containment"] for r in licenses.scan(docs).collect()}
    want = {}
    for d, t in rows:
        w = licenses.normal_words(t or "")
        s = [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]
        for name, text in templates.items():
            own = set(licenses.template_shingles(text))
            m = licenses.class_length(len(own))
            best = max((len(set(s[a : a + 2 * m]) & own) / len(own) for a in range(0, max(len(s) - m, 1), m)), default=0)
            if best >= 0.8:
                want[d, name] = best
    assert got == pytest.approx(want)
    assert {(100 + i, n) for i, n in enumerate(templates)} | {(200 + i, n) for i, n in enumerate(templates)} <= set(got)


def test_blocks_are_sent_to_groups_not_to_each_other_block(spark):
    from graphloom.llm import embeddings as E

    n, group = 40, 8
    blocks = spark.createDataFrame([(i << 24, 1, b"", b"", b"") for i in range(n)], "block long, n int, classes binary, counts binary, units binary")
    pairs = spark.createDataFrame([(i << 24, j << 24) for i in range(n) for j in range(i, n)], "block long, other long")
    rows = E.met(blocks, pairs, group).select("g", "h", "side", "block", "other").collect()
    sent = {(r["g"], r["h"], r["block"]) for r in rows if r["side"] == 0}
    asked = [r for r in rows if r["side"] == 1]
    assert sum(r["side"] == 0 for r in rows) == len(sent) == n * n // group  # each block once to each group, where it went to 41 blocks
    assert len(asked) == n * (n + 1) // 2 and all((r["g"], r["h"], b) in sent for r in asked for b in (r["block"], r["other"]))
    assert E.group_size(150, 24, 64) == 16 and E.group_size(3, 24, 64) == 1
