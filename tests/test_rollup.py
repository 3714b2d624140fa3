from codeloom.operators import edges

EDGES = "edge_index long, source_file_path string, source_symbol_id string, target_file_path string, target_symbol_id string, kind string, relation_kind string, layer string, strength string, origin string, resolution_tier string, confidence_millis int, reason string, line int"


def test_pairs_are_dealt_out_once(spark):
    """Of a pair with very many edges each task hands on few rows; reasons and mixed origins come out in the order of edges."""
    rows = [(k, "a.py", None, "b.py", None, "Call", "Call", "Runtime", "Hard" if k == 7 else "Dynamic", "Resolver" if k else "Policy", "Global", 500 + k % 3, ["late", "import", "late", "sport"][k % 4], 90 - k % 9) for k in range(400)]
    rows.append((400, "a.py", None, "c.py", None, "Call", "Call", "Runtime", "Hard", "Resolver", "Global", 1, None, None))
    symbols = spark.createDataFrame([], "id string, kind string, symbol_index long")
    got = edges.dependency_rollup(spark.createDataFrame(rows, EDGES).repartition(3), symbols)
    made = sorted(tuple(r) for r in got.collect())
    assert [(r.to, r.reason, r.line, r.confidence_millis, r.strength, r.origin, r.occurrence_count) for r in sorted(got.collect(), key=lambda r: r.to)] == [("file:b.py", "late | import | sport", 82, 502, "hard", "mixed", 400), ("file:c.py", None, None, 1, "hard", "resolver", 1)]
    assert len(made) == 2
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(from#") == 1


def test_a_task_merges_its_edges(spark, monkeypatch):
    monkeypatch.setattr(edges, "MERGED_AT_ONCE", 50)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"k": [1, None] * 20, "n": [1] * 40, "at": list(range(40)), "line": [3] * 40, "c": [1] * 40, "s": [1] * 40, "t": [1] * 40, "o1": ["x", "y"] * 20, "o2": ["x", "y"] * 20})
    got = pa.Table.from_batches(list(edges._merged(iter([batch] * 4), ["k"]))).to_pylist()
    assert [(r["k"], r["n"], r["at"]) for r in got] == [(1, 40, 0), (None, 40, 1)] * 2
