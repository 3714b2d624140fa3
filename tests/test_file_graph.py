from codeloom.operators import graph


def test_edges_are_read_once_for_nodes_and_links(spark):
    rows = [("a/x.py", "b/y.py", "Call"), ("a/x.py", "b/y.py", "Import"), ("b/y.py", "b/y.py", "Call"), ("c/z.py", "a/x.py", "Overrides")]
    nodes, links = graph.file_graph(spark.createDataFrame(rows, "source_file_path string, target_file_path string, kind string"))
    assert sorted(tuple(r) for r in links.collect()) == [("a/x.py", "b/y.py")]
    assert sorted(r.path for r in nodes.collect()) == ["a/x.py", "b/y.py"]
    assert "Aggregate" not in links._jdf.queryExecution().optimizedPlan().toString()
