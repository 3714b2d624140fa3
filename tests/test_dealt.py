from pyspark.sql import functions as F

from codeloom.operators import rules


def test_sources_of_one_partition_are_parsed_by_several_tasks(spark):
    rows = [(f"src/f{i}.py", "import os\nos.system(x)\n") for i in range(40)]
    got = rules.spans(spark.createDataFrame(rows, "file_path string, text string").coalesce(1)).withColumn("task", F.spark_partition_id()).collect()
    assert {r.file_path for r in got} == {p for p, _ in rows}
    assert len({r.task for r in got}) > 1
