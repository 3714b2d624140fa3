import random

from codeloom.operators import scanners, text

EDGE = "source_file_path string, source_symbol_id string, target_file_path string, target_symbol_id string, relation_kind string, reference_target_name string, occurrence_index int"
RANK = {"Call": 5, "Dispatch": 4, "ContainerResolution": 3, "EventPublish": 2, "Import": 1}


def ways(spark, rows, roots, most=8):
    found = scanners.causal_ways(spark.createDataFrame(rows, EDGE), spark.createDataFrame([(r,) for r in roots], "path string"), most).collect()
    return {r.path: (tuple(r.score), r.way) for r in found}


def brute(rows, roots, most):
    step = {}
    for a, sa, b, sb, kind, name, n in rows:
        if kind in RANK and a != b and b not in roots:
            point = (RANK[kind], int(sa is not None and sb is not None), int(n > 0 or name is not None))
            step[a, b] = max(step.get((a, b), point), point)
    best = front = {r: ((0, 0, 0, 0), [r]) for r in roots}
    for _ in range(most):
        got = {}
        for p, (score, way) in front.items():
            for (a, b), e in step.items():
                if a == p and b not in way:
                    new = (tuple(x + y for x, y in zip(score, (*e, -1))), [*way, b])
                    if b not in got or (new[0], [-ord(c) for x in new[1] for c in x]) > (got[b][0], [-ord(c) for x in got[b][1] for c in x]):
                        got[b] = new
        front = {b: x for b, x in got.items() if b not in best or x[0] > best[b][0]}
        best = best | front
    return {p: x for p, x in best.items() if p not in roots}


def test_calls_before_imports_and_causes_before_shortness(spark):
    link = lambda a, b, kind, **k: (a, k.get("s"), b, "t", kind, None, 0)
    got = ways(spark, [link("in", "sink", "Import"), link("in", "sink", "Call", s="x"), link("in", "mid", "Call"), link("mid", "end", "Call"), link("in", "end", "Import"), link("in", "off", "TypeUse")], ["in"])
    assert got == {"sink": ((5, 1, 0, -1), ["in", "sink"]), "mid": ((5, 0, 0, -1), ["in", "mid"]), "end": ((10, 0, 0, -2), ["in", "mid", "end"])}


def test_corrected_labels_against_brute_force(spark):
    r = random.Random(4)
    names = "abcdefghij"
    rows = [(a, r.choice([None, "s"]), b, r.choice([None, "t"]), r.choice([*RANK, "TypeUse"]), r.choice([None, "n"]), r.choice([0, 0, 1])) for a in names for b in r.sample(names, 2)]
    for most in (1, 3, 8):
        assert ways(spark, rows, ["a", "d"], most) == brute(rows, ["a", "d"], most)
    assert ways(spark, rows, []) == {} and ways(spark, [], ["a"]) == {}


def test_inputs_of_other_files_raise_a_severity(spark):
    lines = spark.createDataFrame([("in.py", 2, "x = request.GET"), ("sink.py", 5, "os.system(x)"), ("own.py", 1, "x = request.GET"), ("own.py", 3, "os.system(x)"), ("below.py", 3, "os.system(x)"), ("below.py", 9, "x = request.GET"), ("none.py", 1, "os.system(x)")], "file_path string, line int, content string")
    reach = spark.createDataFrame([("in.py", ["in.py"]), ("sink.py", ["in.py", "mid.py", "sink.py"])], "path string, way array<string>")
    got = {r.file_path: r for r in text.cross_file_flows(text.dangerous_calls(lines), lines.limit(0).selectExpr("file_path AS path"), text.boundary_inputs(lines), reach).collect()}
    assert got["sink.py"].severity == "High" and got["sink.py"].contexts == ["BoundaryInputReachableViaGraph"] and got["sink.py"].flow == ["in.py:2:RequestQuery", "in.py", "mid.py", "sink.py", "sink.py:5"]
    assert got["own.py"].severity == "High" and got["own.py"].flow == ["own.py:1:RequestQuery", "own.py:3"] and got["own.py"].input_path == []
    assert {got[f].severity for f in ("below.py", "none.py")} == {"Medium"} and got["none.py"].flow == []
