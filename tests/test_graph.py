import random
from collections import defaultdict, deque
from itertools import permutations

import pytest

from larkspan.operators import graph as G


def random_graph(seed, n=30, m=34):
    rng = random.Random(seed)
    ids = [f"n{i:02d}" for i in range(n)]
    return ids, [(rng.choice(ids), rng.choice(ids[: n // 2 + seed])) for _ in range(m)]


def neighbours(edges):
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return near


def tables(spark, ids, edges):
    return spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(edges, "source string, target string")


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    ids, edges = random_graph(seed)
    # a long path is the slow case for plain label spreading
    path = [f"z{i:03d}" for i in range(40)]
    ids, edges = ids + path, edges + list(zip(path, path[1:]))
    nodes, e = tables(spark, ids, edges)
    got = {r.id: r.component for r in G.components(nodes, e).collect()}
    near = neighbours(edges)
    for start in ids:
        seen, todo = {start}, [start]
        while todo:
            todo += [m for m in near[todo.pop()] if m not in seen and not seen.add(m)]
        assert got[start] == min(seen)


def walked(ids, edges):
    """Betweenness over ordered pairs by breadth-first search from every node."""
    near, want = neighbours(edges), defaultdict(float)
    for s in ids:
        dist, paths, queue = {s: 0}, defaultdict(float, {s: 1.0}), deque([s])
        order = []
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        delta = defaultdict(float)
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    delta[v] += paths[v] / paths[w] * (1 + delta[w])
            if w != s:
                want[w] += delta[w]
    return {i: want[i] for i in ids}


@pytest.mark.parametrize("seed, most", [(3, 20_000_000), (4, 100)])
def test_bridge_scores(spark, seed, most):
    """Random graphs with blocks, trees, leaves and nodes with the same neighbours, in one round of starts and in several."""
    ids, edges = random_graph(seed, 26, 34)
    hub = edges[0][0]
    edges += [(f"t{k}", e[1]) for k in (1, 2, 3) for e in edges if e[0] == hub] + [(f"l{k}", hub) for k in range(3)]
    # two blocks that share one node, a chain between blocks, a star, a pair, repeated edges and loops
    edges += [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "c"), ("f", "g"), ("g", "h"), ("h", "i"), ("i", "j"), ("j", "h")]
    edges += [("a0", "zz"), ("a1", "zz"), ("a2", "zz"), ("y0", "y1"), ("a", "b"), ("b", "a"), ("a", "a"), ("k1", "a"), ("k1", "c"), ("k2", "a"), ("k2", "c")]
    every = sorted({*ids, *(x for e in edges for x in e)}) + ["alone"]
    nodes, e = tables(spark, every, [*edges, (None, "a"), ("a", None)])
    got = {r.id: r.score for r in G.bridge_scores(e, nodes, most).collect()}
    assert got == pytest.approx(walked(every, edges))


def test_bridge_scores_of_no_edges(spark):
    nodes, e = tables(spark, ["a", "b"], [])
    assert {r.id: r.score for r in G.bridge_scores(e, nodes).collect()} == {"a": 0.0, "b": 0.0}
    assert G.bridge_scores(e, nodes.limit(0)).count() == 0


def test_bridge_query_takes_every_source(spark, tmp_path):
    """A chain of 16 pages, each linked to its own and the next place: no choice of ten sources gives these scores."""
    from larkspan.queries.graph import bridge_scores
    from larkspan.registry import Tables

    html = "".join
    rows = [(k, html(f'<a href="{h}">x</a>' for h in (f"u{k}", f"u{k + 1}"))) for k in range(16)]
    spark.createDataFrame([*rows, (99, "no link")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.id: r.score for r in bridge_scores(Tables(spark, str(tmp_path))).collect()}
    chain = [f"hu{k // 2}" if k % 2 == 0 else f"p{k // 2}" for k in range(33)]
    want = {node: 2.0 * k * (32 - k) for k, node in enumerate(chain)}
    assert got == {**want, "p99": 0.0}


def test_cycles(spark):
    ids, edges = random_graph(1, 7, 16)
    _, e = tables(spark, ids, edges)
    have, want = set(edges), set()
    for n in range(1, 5):
        for p in permutations(ids, n):
            if p[0] == min(p) and all((p[i], p[(i + 1) % n]) in have for i in range(n)):
                want.add(p)
    assert {tuple(r.path) for r in G.cycles(e, 4).collect()} == want


def test_degree_isolated_audit_and_calls(spark):
    nodes, e = tables(spark, ["a", "b", "c", "d"], [("a", "b"), ("a", "c"), ("a", "a")])
    assert {r.id: r.degree for r in G.degree(e).collect()} == {"a": 4, "b": 1, "c": 1}
    assert {r.id for r in G.isolated(nodes, e).collect()} == {"b", "c", "d"}
    got = {r.id: (r.n, r.examples) for r in G.audit_list(e, e["source"] == "a", 2).collect()}
    assert got["a"][0] == 4 and got["a"][1] == ["a", "b"]
    named = spark.createDataFrame([("1", "f"), ("2", "g"), ("3", "g")], "id string, label string")
    calls = spark.createDataFrame([("x", "f"), ("x", "g"), ("x", "h")], "caller string, callee string")
    kinds = {r.callee: (r.target, r.confidence) for r in G.resolve_calls(calls, named).collect()}
    assert kinds == {"f": ("1", "INFERRED"), "g": ("2", "AMBIGUOUS"), "h": (None, "UNRESOLVED")}


def test_cohesion_of_small_communities(spark):
    members = spark.createDataFrame([(i, c) for c, g in (("A", "abc"), ("B", "def"), ("C", "g")) for i in g], "id string, community string")
    _, e = tables(spark, [], [("a", "b"), ("b", "c"), ("b", "a"), ("d", "e"), ("e", "f"), ("f", "d"), ("c", "d")])
    got = {r.community: round(r.cohesion, 2) for r in G.cohesion(members, e).collect()}
    assert got == {"A": 0.67, "B": 1.0}


def test_read_graph(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"nodes":[{"id":"a","label":"A"},{"id":"b"}],\n "edges":[{"source":"a","target":"b","weight":1.0}],"raw_calls":[{"caller_nid":"a","callee":"f"}]}')
    (tmp_path / "two.json").write_text('{"nodes":[{"id":"a","label":"A"}],"edges":[]}')
    nodes, edges, calls = G.read_graph(spark, str(tmp_path))
    assert {r.id for r in nodes.collect()} == {"a", "b"} and nodes.count() == 2
    assert [(r.source, r.target, r.weight) for r in edges.collect()] == [("a", "b", 1.0)]
    assert [(r.caller_nid, r.callee) for r in calls.collect()] == [("a", "f")]
