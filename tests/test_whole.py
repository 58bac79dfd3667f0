"""Queries without SQL read their whole tables."""

import pytest

from graphloom.functions import chunkers as C
from graphloom.operators import triples as K
from graphloom.plans import registry
from graphloom.plans.triples import valid
from graphloom.sources.tables import table

QUERIES = registry.queries()


@pytest.mark.parametrize("name", ["txt_chunk_recursive", "txt_chunk_tokens", "txt_chunk_structure", "txt_chunk_intelligent"])
def test_chunkers_read_all_documents(spark, sf, name):
    want = {r["doc_id"] for r in table(spark, sf, "documents").filter("trim(text) <> ''").select("doc_id").collect()}
    assert want <= {r["doc_id"] for r in QUERIES[name](spark, sf).select("doc_id").distinct().collect()}


def test_src_text_reads_all_documents(spark, sf):
    want = table(spark, sf, "documents").filter("text <> ''").selectExpr("count(*) AS files", "sum(octet_length(text)) AS bytes").first()
    got = QUERIES["src_text"](spark, sf).first()
    assert got["files"] == want["files"] and got["bytes"] - want["bytes"] in (0, want["files"])


@pytest.mark.parametrize("name", ["kg_eigenvector", "kg_betweenness"])
def test_centralities_of_all_nodes(spark, sf, name):
    want = {r["node"] for r in K.degree(K.undirected(valid(spark, sf))).select("node").collect()}
    assert {r["node"] for r in QUERIES[name](spark, sf).select("node").collect()} == want


def test_candidates_within_come_from_the_largest_components(spark, sf):
    c = K.components(K.undirected(valid(spark, sf))).groupBy("component").count().filter("count >= 5").collect()
    assert c
    top = {r["component"] for r in sorted(c, key=lambda r: (-r["count"], r["component"]))[:2]}
    own = {r["node"].lower(): r["component"] for r in K.components(K.undirected(valid(spark, sf))).collect()}
    got = QUERIES["kg_infer_within_llm"](spark, sf).collect()
    assert all(own[r["subject"]] == own[r["object"]] and own[r["subject"]] in top for r in got)


def test_node_sizes_and_their_parts_equal_brute_force(spark, sf):
    pairs = [(r["a"], r["b"]) for r in K.undirected(valid(spark, sf)).collect()]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    nodes = sorted(near)
    degree = {v: sum((a == v) + (b == v) for a, b in pairs) for v in nodes}

    def shortest(s):
        """Distances and numbers of shortest paths from s."""
        dist, paths, front = {s: 0}, {s: 1}, [s]
        while front:
            new = {}
            for v in front:
                for w in near[v] - {v}:
                    if w not in dist:
                        new[w] = new.get(w, 0) + paths[v]
            dist |= dict.fromkeys(new, dist[front[0]] + 1)
            paths |= new
            front = list(new)
        return dist, paths

    every = {s: shortest(s) for s in nodes}
    between = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        for t in every[s][0]:
            for v in every[s][0]:
                if len({s, t, v}) == 3 and every[s][0][v] + every[v][0].get(t, 1 << 30) == every[s][0][t]:
                    between[v] += every[s][1][v] * every[v][1][t] / every[s][1][t] / ((len(nodes) - 1) * (len(nodes) - 2))
    x = dict.fromkeys(nodes, 1.0)
    for _ in range(3000):
        y = {v: x[v] + sum(x[w] for w in near[v]) for v in nodes}
        norm = sum(z * z for z in y.values()) ** 0.5
        x = {v: z / norm for v, z in y.items()}
    got = {r["node"]: r["betweenness"] for r in QUERIES["kg_betweenness"](spark, sf).collect()}
    assert got.keys() == between.keys() and all(abs(got[v] - between[v]) < 2e-6 for v in nodes)
    got = {r["node"]: r["eigenvector"] for r in QUERIES["kg_eigenvector"](spark, sf).collect()}
    assert got.keys() == x.keys() and all(abs(got[v] - x[v]) < 2e-3 for v in nodes)
    top = [max(m.values()) for m in (degree, between, x)]
    size = {v: 10 + 20 * (0.5 * degree[v] / top[0] + 0.3 * between[v] / top[1] + 0.2 * x[v] / top[2]) for v in nodes}
    got = {r["node"]: r["size"] for r in QUERIES["kg_node_size"](spark, sf).collect()}
    assert got.keys() == size.keys() and all(abs(got[v] - size[v]) < 0.05 for v in nodes)


@pytest.mark.parametrize("name,plain", [("txt_chunk_recursive", C.recursive), ("txt_chunk_tokens", C.by_tokens), ("txt_chunk_structure", C.by_structure), ("txt_chunk_intelligent", C.intelligent)])
def test_chunks_hold_the_text_in_order(spark, sf, name, plain):
    """The chunks of each document are those of its text alone, none is blank or too long, and no word is lost."""
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    got = {}
    for r in QUERIES[name](spark, sf).collect():
        got.setdefault(r["doc_id"], {})[r["chunk"]] = r["text"]
    for k, text in texts.items():
        chunks = [c for _, c in sorted(got.get(k, {}).items())]
        assert chunks == plain(text) and all(c.strip() for c in chunks)
        if name == "txt_chunk_recursive":
            assert all(len(c) <= 500 for c in chunks)
        if name != "txt_chunk_structure":
            at, words = 0, text.split()
            for c in chunks if name == "txt_chunk_tokens" else []:
                own = c.split()
                begin = next(i for i in range(max(0, at - len(own)), at + 1) if words[i : i + len(own)] == own)  # with an overlap at most
                at = begin + len(own)
            assert name != "txt_chunk_tokens" or at == len(words)


def test_chunks_have_their_documents_context(spark, sf):
    want = {r["doc_id"]: r["context"] for r in QUERIES["txt_doc_context"](spark, sf).collect()}
    got = {(r["doc_id"], r["context"]) for r in QUERIES["txt_chunk_intelligent"](spark, sf).collect()}
    assert len(got) > 100 and all(want[k] == c for k, c in got)


@pytest.mark.parametrize("text,want", [
    ('{"a": 1,}', '{"a": 1}'), ("so: {'a': 'x', b: [1, 2,]}", '{"a": "x", "b": [1, 2]}'), ('[{"a": 1}, {"b": "cut', '[{"a": 1}]'), ('{"a": 1, "half', '{"a": 1}'),
    ('{"a": {"b": [1, {"c":', '{"a": {"b": [1, {"c": null}]}}'), ("\u201ca\u201d {\u201ca\u201d: 2}", '{"a": 2}'), ("no", None), ("[", "[]"), ('{"q": "it\'s"}', '{"q": "it\'s"}'),
])
def test_spoilt_json_is_repaired(text, want):
    assert C.salvage_json(text) == want
