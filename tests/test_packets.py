"""Work packets against a plain version, within any budget; their radius, findings and obligations; empty tables."""

import random

from codeloom.operators import packets as pk

FOUND = "fingerprint string, path string, family string, severity_millis int, status string, contexts array<string>, precision string"
ASSESSED = "focus string, path string, severity_millis int, related array<string>"


def made(spark, seed):
    r = random.Random(seed)
    files = [f"f{i}" for i in range(9)]
    found = [
        (f"p{i}", r.choice(files), r.choice(["security", "hardwiring", "dead_code", "external"]), r.choice([100, 500, 900, 950]), r.choice(["Visible", "Visible", "AcceptedByPolicy"]), r.sample(["ExternallyReachable", "Sandboxed", "EntryReachableViaGraph"], r.randrange(2)), r.choice(["modeled", "heuristic"]))
        for i in range(40)
    ]
    central = [(f, r.choice([0, 300, 800])) for f in files[:6]]
    cyclic, hot = r.sample(files, 3), r.sample(files, 5)
    assessed = [(r.choice([*pk.HIGH_FROM, "abstraction_sprawl", "reviewed_architecture", "no_such_focus"]), r.choice(files), r.randrange(1000), r.choice([None, [], r.sample(files, 3)])) for _ in range(12)]
    return found, central, cyclic, hot, assessed


def plain(found, central, cyclic, hot, assessed, budget):
    out, seen = [], [x for x in found if x[4] == "Visible"]
    for path in {x[1] for x in seen}:
        mine = [x for x in seen if x[1] == path]
        c = dict(central).get(path, 0)
        labels = ([f"bottleneck:{c}"] if c else []) + (["strong_cycle"] if path in cyclic else [])
        sec = [x for x in mine if x[2] == "security"]
        if sec:
            contexts = {k for x in sec for k in x[5]} & set(pk.EXPOSED)
            high = bool(contexts) or any(x[3] >= 900 for x in sec)
            out.append((f"security_hotspot:{path}", "high" if high else "medium", "security_hotspot", path, [path], 870 if high else 760, len(sec), sorted(contexts) + labels))
        guarded, literals = sum(x[2] in ("security", "external") for x in mine), sum(x[2] == "hardwiring" for x in mine)
        if path in hot and literals < len(mine) - 1 and not (literals > 2 * (len(mine) - literals) and not guarded):
            out.append((f"warning_heavy_hotspot:{path}", "high" if guarded or path in cyclic or c >= 700 else "medium", "warning_heavy_hotspot", path, [path], 760 if guarded else 640, len(mine), labels))
    out += [(f"dead_code_proof:{x[0]}", "medium" if x[6] == "heuristic" else "high", "dead_code_proof", x[1], [x[1]], 800, 1, []) for x in seen if x[2] == "dead_code"]
    for focus, path in {x[:2] for x in assessed if x[0] in pk.FOCUS_RANK}:
        mine = [(x[2], sorted({path, *(x[3] or [])})) for x in assessed if x[:2] == (focus, path)]
        worst, files = max(mine, key=lambda m: (m[0], "\n".join(m[1])))
        high = worst >= pk.HIGH_FROM.get(focus, 9999) or (focus in pk.MANY_FILES and len(files) >= 3) or (focus.startswith("alg") and len(mine) >= 2) or focus == "reviewed_architecture"
        out.append((f"{focus}:{path}", "low" if focus == "abstraction_sprawl" else "high" if high else "medium", focus, path, files, worst, len(mine), []))
    out.sort(key=lambda p: (-pk.PRIORITY[p[1]], -pk.FOCUS_RANK[p[2]], p[4], p[2], p[0]))
    first = [p for i, p in enumerate(out) if p[2] not in {q[2] for q in out[:i]}]
    return (first + [p for p in out if p not in first])[:budget]


def packets_of(spark, found, central, cyclic, hot, assessed):
    reviewed = spark.createDataFrame(found, FOUND)
    return reviewed, pk.of_findings(reviewed, spark.createDataFrame(central, "path string, centrality_millis int"), spark.createDataFrame([(x,) for x in cyclic], "path string"), spark.createDataFrame([(x,) for x in hot], "path string")).unionByName(pk.of_assessments(spark.createDataFrame(assessed, ASSESSED)))


def test_against_a_plain_version(spark):
    for seed, budget in ((1, 3), (2, 8), (3, 200)):
        data = made(spark, seed)
        reviewed, packets = packets_of(spark, *data)
        rows = pk.chosen(packets, budget).orderBy("rank").collect()
        assert [tuple(r[c] for c in pk.COLUMNS) for r in rows] == plain(*data, budget) and [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        assert all(r.obligations and "§" not in str(r.obligations) and r.primary_file in r.obligations[0].action for r in rows)


def test_radius_and_members(spark):
    data = made(spark, 4)
    data[0].append(("p40", "f0", "security", 900, "Visible", [], "modeled"))
    reviewed, packets = packets_of(spark, *data)
    got = pk.chosen(packets, 50)
    links = spark.createDataFrame([("f0", "f1"), ("f1", "f0"), ("f2", "f0"), ("f0", "x"), ("f0", "x"), ("y", "z")], "src string, dst string")
    near = {}
    for r in pk.radius(got, links).collect():
        near.setdefault(r.id, set()).add((r.path, r.incoming, r.outgoing))
    for r in got.collect():
        if r.target_files == ["f0"]:
            assert near[r.id] == {("f1", True, True), ("f2", True, False), ("x", False, True)}
    assert any(r.target_files == ["f0"] for r in got.collect())
    count = {}
    for r in pk.members(got, reviewed).collect():
        count[r.id] = count.get(r.id, 0) + 1
    assert count == {r.id: r.findings for r in got.collect() if r.id.split(":")[0] in ("security_hotspot", "warning_heavy_hotspot", "dead_code_proof")}


def test_empty_tables(spark):
    reviewed, packets = packets_of(spark, [], [], [], [], [])
    assert pk.chosen(packets).count() == 0 and pk.radius(pk.chosen(packets), spark.createDataFrame([], "src string, dst string")).count() == 0 and pk.members(pk.chosen(packets), reviewed).count() == 0


def test_registered_query_reads_assessments(spark):
    """A binding further down the module took the name of the query's own, and the query failed on a column it doesn't have."""
    from codeloom.plans import registry

    got = registry.QUERIES["guardian_packets"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 13))
    assert {r["focus"] for r in got} > {"hand_rolled_parsing", "split_identity_model"}
