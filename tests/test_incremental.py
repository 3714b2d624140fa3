import random
import uuid

from codeloom.operators import graph, incremental, resolution

REFS = "ref_index long, file_path string, target_name string, arity int"
SYMBOLS = "symbol_index long, id string, file_path string, name string, parameter_count int, required_parameter_count int"


def tables(spark, refs, symbols):
    return spark.createDataFrame(refs, REFS), spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame([("b.py", "x", "s1")], "file_path string, binding string, qualified string"), spark.createDataFrame([("c.py", "a.py")], "file_path string, imported_path string")


def test_only_changed_files_are_resolved(spark):
    r = random.Random(1)
    symbols = [(i, f"s{i}", r.choice("abc") + ".py", r.choice("xyzuvw"), r.choice([None, 1, 2]), 1) for i in range(12)]
    refs = [(i, r.choice("abcd") + ".py", r.choice("xyzuvwq"), r.choice([None, 0, 1, 2])) for i in range(60)]
    graph.cut(spark.range(1))
    root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/state-{uuid.uuid4().hex}"

    def run(refs, symbols):
        t = tables(spark, refs, symbols)
        found, work = incremental.resolve_incrementally(*t, root)
        cold = {tuple(x) for x in resolution.resolve(*t).select("ref_index", *incremental.KEPT).collect()}
        rows = found.collect()
        assert {tuple(x)[:4] for x in rows} == cold
        return {x.ref_index for x in rows if x.reused}, work

    files = {f for _, f, *_ in refs}
    assert run(refs, symbols)[1] == {"context_changed": True, "files_reused": 0, "references_reused": 0, "files_processed": len(files), "references_processed": 60}
    assert run(refs, symbols)[1] == {"context_changed": False, "files_reused": len(files), "references_reused": 60, "files_processed": 0, "references_processed": 0}
    # Other numbers of the same references change nothing; one changed file is resolved, a removed one forgotten.
    renumbered = [(i + 1000, f, n, a) for i, f, n, a in refs]
    assert run(renumbered, symbols)[1]["references_reused"] == 60
    changed = [(i, f, "w" if f == "b.py" and n == "x" else n, a) for i, f, n, a in refs if f != "d.py"]
    reused, work = run(changed, symbols)
    assert work["files_processed"] == 1 and work["files_reused"] == len(files) - 2 and all(f != "b.py" for i, f, *_ in changed if i in reused)
    assert run(refs, symbols)[1]["files_processed"] == 2
    # Another context drops the whole state.
    more = [*symbols, (99, "s99", "d.py", "q", None, None)]
    assert run(refs, more)[1]["files_reused"] == 0 and run(refs, more)[1]["files_processed"] == 0
    assert run([], more)[1] == {"context_changed": False, "files_reused": 0, "references_reused": 0, "files_processed": 0, "references_processed": 0}


def test_support_paths_against_brute_force(spark):
    r = random.Random(2)
    names = [f"{z}/{i}" for z in "abc" for i in range(4)]
    rows = [(a, b, r.choice(["Call", "Import", "TypeUse"]), r.choice([900, 500, 950]), "Structural") for a in names for b in r.sample(names, 3) if a != b]
    edges = spark.createDataFrame(rows, "source_file_path string, target_file_path string, relation_kind string, confidence_millis int, layer string")
    rank = {"Call": 5, "Import": 1}
    best = {}
    for a, b, kind, c, _ in rows:
        best[a, b] = min(best.get((a, b), (9, 9)), (-rank.get(kind, 0), -c, 0, kind))
    wanted = [("a/0", "c/3"), ("b/1", "a/2"), ("c/0", "b/0"), ("a/1", "a/1")]
    want = []
    for n, (source, target) in enumerate(wanted):
        front, found = [((source,), (), 1000)], []
        for _ in range(4):
            got = {}
            for path, rels, c in front if source != target else []:
                for (a, b), e in best.items():
                    if a == path[-1] and b not in path:
                        got.setdefault(b, []).append(((*path, b), (*rels, e[3]), min(c, -e[1])))
            kept = [x for xs in got.values() for x in sorted(xs, key=lambda x: (-x[2], x[0]))[:2]]
            found += [x for x in kept if x[0][-1] == target]
            front = [x for x in kept if x[0][-1] != target] if len(found) < 2 else []
        want += [(n, k + 1, *x) for k, x in enumerate(sorted(found, key=lambda x: (len(x[1]), -x[2], x[0]))[:2])]
    pairs = spark.createDataFrame([(n, *p) for n, p in enumerate(wanted)], "pair int, source string, target string")
    got = [(x.pair, x["rank"], tuple(x.path), tuple(x.relations), x.confidence_millis) for x in graph.support_paths(edges, pairs).collect()]
    assert sorted(got) == sorted(want)
    assert graph.support_paths(edges.limit(0), pairs).count() == 0


def test_zone_support_paths_turn_round(spark):
    rows = [("a/x", "b/y", "Call", 900, "Structural"), ("b/y", "b/z", "Import", 900, "Structural"), ("b/z", "b/w", "Import", 900, "Structural"), ("b/z", "b/v", "Import", 900, "Structural")]
    edges = spark.createDataFrame(rows, "source_file_path string, target_file_path string, relation_kind string, confidence_millis int, layer string")
    assert [(x.source_zone, x.target_zone, x.reversed, x.path, x.relations) for x in graph.zone_support_paths(edges).collect()] == [("a", "b", False, ["a/x", "b/y", "b/z"], ["Call", "Import"])]


def test_state_has_a_row_for_each_name_of_a_file(spark):
    """However often a file refers to a name; a number that a kept and a changed file share is told of both."""
    from codeloom.sources import sinks

    graph.cut(spark.range(1))
    root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/state-{uuid.uuid4().hex}"
    symbols = [(1, "s1", "a.py", "x", None, None)]
    refs = [(k, f, "x", None) for f, low in (("a.py", 0), ("c.py", 49)) for k in range(low, low + 50)]
    incremental.resolve_incrementally(*tables(spark, refs, symbols), root)
    assert sinks.current(spark, root)["best"].count() == 2
    found, _ = incremental.resolve_incrementally(*tables(spark, [*refs, (99, "c.py", "y", None)], symbols), root)
    rows = sorted((x.ref_index, x.target_symbol_id, x.resolution_tier, x.reused) for x in found.collect())
    assert rows == sorted([*((k, "s1", "SameFile", True) for k in range(50)), (49, "s1", "SameFile", False), *((k, "s1", "ImportScoped", False) for k in range(50, 99))])
