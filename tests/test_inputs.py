from codeloom.operators import text


def test_inputs_of_repeated_calls(spark):
    lines = spark.createDataFrame([("a.py", 2, "x = request.GET"), ("a.py", 3, "os.system(x)"), ("a.py", 3, "os.system(x)")], "file_path string, line int, content string")
    nobody = spark.createDataFrame([], "path string")
    got = text.severities(text.dangerous_calls(lines), nobody, text.boundary_inputs(lines)).collect()
    assert [(r.line, r.severity, r.inputs) for r in got] == [(3, "High", ["2:RequestQuery"])] * 2
