"""Graph operators on hand-built edges, and against plain Python on random graphs."""

import random
from collections import deque

import numpy as np
import pytest

from codeloom import model as M
from codeloom.operators import edges as ed
from codeloom.operators import graph as gr

COLUMNS = [c.split()[0] for c in M.EDGES.split(", ")]


def edge(source, target, kind="Import", confidence=900, layer="Structural", line=1, strength="Hard"):
    relation = {"Type": "TypeUse", "TypeImport": "TypeUse"}.get(kind, kind)
    return (0, source, None, target, f"s:{target}", target, kind, relation, layer, strength, "Resolver", "ImportScoped", confidence, "import:named", line, 0)


def edges(spark, *rows):
    return spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], M.EDGES)


def test_one_cycle_in_both_views(spark):
    e = edges(spark, edge("src/a.rs", "src/b.rs"), edge("src/b.rs", "src/a.rs"), edge("src/b.rs", "src/c.rs", "Call"))
    for view in (ed.dependency_edges(e), ed.strong_edges(e)):
        nodes, links = gr.file_graph(view)
        found = gr.strong_components(links)
        assert sorted(r.path for r in found.collect()) == ["src/a.rs", "src/b.rs"]
        assert gr.cycle_classes(view, found).first().cycle_class == "Structural"
        assert nodes.count() == 3 and links.count() == 3
        assert gr.cycle_witness(links, found).first().witness == ["src/a.rs", "src/b.rs", "src/a.rs"]
    assert [tuple(r) for r in gr.coupling(nodes, links).collect()] == [("src", 0, 0, 0)]


def test_coupling(spark):
    nodes, links = gr.file_graph(edges(spark, edge("src/a.rs", "domain/b.rs"), edge("src/a.rs", "infra/c.rs", "Call"), edge("infra/c.rs", "domain/b.rs")))
    assert {r.module: (r.afferent, r.efferent) for r in gr.coupling(nodes, links).collect()} == {"src": (0, 2), "domain": (2, 0), "infra": (1, 1)}


def test_hub(spark):
    rows = [e for m in ("domain", "infra", "ui") for e in (edge(f"{m}/x.rs", "core/hub.rs"), edge("core/hub.rs", f"{m}/x.rs"))]
    nodes, links = gr.file_graph(edges(spark, *rows))
    assert [r.subject for r in gr.hub_smells(gr.coupling(nodes, links)).collect()] == ["core"]


def test_unstable(spark):
    nodes, links = gr.file_graph(edges(spark, *[edge(f"{a}/f.rs", f"{b}/f.rs") for a, b in (("app", "domain"), ("infra", "domain"), ("domain", "ui"), ("ui", "infra"), ("ui", "app"))]))
    (r,) = gr.unstable_smells(gr.coupling(nodes, links), gr.module_counts(links)).collect()
    assert (r.subject, r.related, r.preview) == ("domain", "ui", "domain -> ui (1 cross-module links)")


def test_probable_artifacts(spark):
    ring = [edge(f"m/f{i}.rs", f"m/f{(i + 1) % 10}.rs", "Call") for i in range(10)]
    loose = edge("m/f0.rs", "m/f5.rs", "Call", 500, "Framework")
    for rows, artifact in (([*ring, loose], False), ([edge(f"m/f{i}.rs", f"m/f{(i + 1) % 10}.rs", "Call", 500) for i in range(10)], True)):
        e = edges(spark, *rows)
        found = gr.strong_components(gr.file_graph(e)[1])
        assert (gr.cycle_classes(e, found).first().cycle_class == "ProbableArtifact") == artifact
    e = edges(spark, edge("a", "b", "TypeImport"), edge("b", "a", "TypeImport"))
    assert gr.strong_components(gr.file_graph(ed.strong_edges(e))[1]).count() == 0


def test_zero_inbound(spark):
    nodes, links = gr.file_graph(edges(spark, edge("src/main.rs", "src/a.rs"), edge("src/lost.rs", "src/a.rs")))
    assert {tuple(r) for r in gr.zero_inbound(nodes, links).collect()} == {("src/main.rs", "runtime_entry"), ("src/lost.rs", "orphan")}
    assert {r.status for r in gr.zero_inbound(nodes, links, truncated=True).collect()} == {"runtime_entry", "boundary_truncated"}
    assert gr.zero_inbound(nodes, links, complete=False).count() == 1


def test_rollup_reasons_and_ranks(spark):
    rows = [edge("a", "b", "Call", 500, strength="Inferred"), edge("a", "b", "Call", 900), edge("a", "b", "Call", 700)]
    rows = [(*r[:9], *x, *r[12:13], why, *r[14:]) for r, x, why in zip(rows, (("Inferred", "Resolver", "Global"), ("Hard", "Plugin", "ImportScoped"), ("Dynamic", "Resolver", "SameFile")), ("one", "two", "on"))]
    rows = [(*r[:9], r[9], r[10], r[11], r[12], r[13], r[14], r[15]) for r in rows]
    (r,) = ed.dependency_rollup(edges(spark, *rows), spark.createDataFrame([], M.SYMBOLS)).collect()
    assert (r.type, r.occurrence_count, r.strength, r.origin, r.resolution_tier, r.confidence_millis, r.reason) == ("TOP_LEVEL_CALL", 3, "hard", "mixed", "same_file", 900, "one | two")


def random_graph(seed, n=14, p=0.14):
    r = random.Random(seed)
    return [(f"n{i:02}", f"n{j:02}") for i in range(n) for j in range(n) if i != j and r.random() < p]


def distances(pairs, root):
    seen, queue = {root: 0}, deque([root])
    while queue:
        x = queue.popleft()
        for a, b in pairs:
            if a == x and b not in seen:
                seen[b] = seen[x] + 1
                queue.append(b)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    pairs = random_graph(seed)
    links = spark.createDataFrame(pairs, "src string, dst string")
    names = sorted({x for p in pairs for x in p})
    nodes = spark.createDataFrame([(x,) for x in names], "path string")
    reach = {x: distances(pairs, x) for x in names}
    want = {x: min(y for y in names if y in reach[x] and x in reach[y]) for x in names if any(y != x and y in reach[x] and x in reach[y] for y in names)}
    for limit in (10**6, -1):
        assert {r.path: r.component for r in gr.strong_components(links, limit).collect()} == want
    root = names[0]
    assert {r.path: r.depth for r in gr.levels(links, nodes.filter(f"path = '{root}'"), 20).collect()} == reach[root]
    # Betweenness by counting shortest ways.
    ways = {}
    for s in names:
        count = {s: 1}
        for x in sorted(reach[s], key=reach[s].get):
            for a, b in pairs:
                if a == x and reach[s].get(b) == reach[s][x] + 1:
                    count[b] = count.get(b, 0) + count[x]
        ways[s] = count
    score = {v: sum(ways[s][v] * ways[v][t] / ways[s][t] for s in names for t in reach[s] if s != v != t and s != t and v in reach[s] and t in reach[v] and reach[s][v] + reach[v][t] == reach[s][t]) for v in names}
    for limit in (10**6, -1):
        got = {r.path: r.centrality_millis for r in gr.betweenness(nodes, links, limit).collect()}
        assert all(abs(got[v] - 1000 * score[v]) <= 1 for v in names)


@pytest.mark.parametrize("local", [-1, 60])
def test_components_behind_each_other(spark, monkeypatch, local):
    """Rounds grow with the logarithm of how many components lie behind each other: one component a round took over 150 cuts here."""
    files = [[f"{k:02}/{x}" for x in "abc"] for k in range(20)]
    pairs = [(f[i], f[(i + 1) % 3]) for f in files for i in range(3)] + [(f[0], g[1]) for i, f in enumerate(files) for g in files[i + 1 :]]
    links, cuts, real = spark.createDataFrame(pairs, "src string, dst string"), [], gr.cut
    monkeypatch.setattr(gr, "cut", lambda x: cuts.append(1) or real(x))
    got = {r.path: (r.component, r.size) for r in gr.strong_components(links, local).collect()}
    assert got == {x: (f[0], 3) for f in files for x in f}
    assert len(cuts) < 80


def test_cycle_classes_read_edges_once(spark, tmp_path):
    """What lies within components goes three ways; each read all edges anew before."""
    edges(spark, *[edge(f"m/{a}", f"m/{b}") for a, b in random_graph(5)]).write.parquet(f"{tmp_path}/e")
    e = spark.read.parquet(f"{tmp_path}/e")
    found = gr.strong_components(gr.file_graph(e)[1])
    out = gr.cycle_classes(e, gr.cut(found))
    assert "FileScan" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.component, r["size"]) for r in out.collect()} == {(r.component, r["size"]) for r in found.collect()}


def test_links_keep_apart_paths_of_one_hash(spark, monkeypatch):
    links = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    for same in (False, True):
        if same:
            monkeypatch.setattr(gr.F, "xxhash64", lambda *_: gr.F.lit(1).cast("long"))
        names, ids = gr._hashed(nodes, links)
        path = {r.id: r.path for r in names.collect()}
        assert len(path) == 3 and {(path[r.s], path[r.d]) for r in ids.collect()} == {("a", "b"), ("b", "c")}


def test_witness_is_that_of_a_queue(spark):
    pairs = random_graph(3)
    links = spark.createDataFrame(pairs, "src string, dst string")
    found = gr.strong_components(links)
    for row in gr.cycle_witness(links, found).collect():
        inside = {r.path for r in found.filter(f"component = '{row.component}'").collect()}
        came, queue, want = {row.component: None}, deque([row.component]), None
        while want is None:
            x = queue.popleft()
            for a, y in sorted(pairs):
                if a == x and y == row.component and want is None:
                    want = [y]
                    while x is not None:
                        want.append(x)
                        x = came[x]
                    break
                if a == x and y in inside and y not in came:
                    came[y] = x
                    queue.append(y)
        assert row.witness == want[::-1]


def test_betweenness_by_blocks(spark, monkeypatch):
    """Blocks of sources one after another give what all at once do, and leave nothing of their checkpoints behind."""
    import os

    pairs = random_graph(4)
    links = spark.createDataFrame(pairs, "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p})], "path string")
    want = {r.path: r.centrality_millis for r in gr.betweenness(nodes, links).collect()}
    monkeypatch.setattr(gr, "BLOCK_ROWS", 40)
    got = {r.path: r.centrality_millis for r in gr.betweenness(nodes, links, -1).collect()}
    assert all(abs(got[v] - want[v]) <= 1 for v in want) and got.keys() == want.keys()
    assert not [x for x in os.listdir(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")) if x.startswith("block-")]


def test_betweenness_goes_by_what_sources_reach(monkeypatch):
    """Sources go together in blocks, none over a graph that it isn't connected with: each took time by all files before."""
    pairs = [(f"{k}/{a}", f"{k}/{b}") for k in range(30) for a, b in random_graph(k % 3)]
    names = sorted({x for p in pairs for x in p})
    place = {x: i for i, x in enumerate(names)}
    src, dst = (np.array([place[p[k]] for p in pairs], np.int32) for k in (0, 1))
    sizes, real = [], gr._block_shares
    monkeypatch.setattr(gr, "_block_shares", lambda roots, a, b, n: sizes.append((len(roots), n)) or real(roots, a, b, n))
    once = gr._shares(src, dst, len(names), 0, 1)
    assert max(n for _, n in sizes) <= max(len({x for p in random_graph(k) for x in p}) for k in range(3))
    assert max(b for b, _ in sizes) > 1
    monkeypatch.setattr(gr, "TOGETHER", 3), monkeypatch.setattr(gr, "PIECE", 2)
    assert np.allclose(once, sum(gr._shares(src, dst, len(names), k, 4) for k in range(4)))
    for k in range(3):  # each copy as by itself
        alone = [i for i, x in enumerate(names) if x.startswith(f"{k}/")]
        again = [i for i, x in enumerate(names) if x.startswith(f"{k + 3}/")]
        assert np.allclose(once[alone], once[again]) and once[alone].any()


def test_traces(spark):
    e = edges(spark, edge("a", "b", "Call"), edge("b", "d", "Call"), edge("a", "c"), edge("c", "d"), edge("a", "x"))
    assert [r.path for r in gr.traces(e, "a", "d", k=2).collect()] == [["a", "b", "d"], ["a", "c", "d"]]
    assert gr.traces(e, "d", "a").count() == 0
