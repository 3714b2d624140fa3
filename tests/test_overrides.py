"""Overrides and tiers where very many methods share a name."""

import random

from pyspark.sql import functions as F

from codeloom.operators import resolution as rs

METHOD = "id string, name string, symbol_index long, parent_symbol_id string, file_path string, start_line int, kind string"


def test_overrides_against_all_pairs(spark):
    """Repeated ids, a class that is its own ancestor, ties."""
    r = random.Random(5)
    rows = [(f"i{r.randrange(25)}", r.choice("ab"), r.randrange(9), f"c{r.randrange(5)}", f"f{r.randrange(2)}", r.randrange(2), "Method") for _ in range(60)]
    lineage = [(f"c{a}", f"c{b}", 1 + r.randrange(2)) for a in range(5) for b in range(5) if r.random() < 0.5]
    want = {}
    for i, n, _, c, f, line, _ in rows:
        for a, b, d in lineage:
            for j, n2, x, c2, f2, _, _ in rows:
                if a == c and b == c2 and n == n2 and i != j:
                    want[i, f, line] = min(want.get((i, f, line), (9,)), (d, x, j, f2))
    got = rs.override_edges(spark.createDataFrame(rows, METHOD), spark.createDataFrame(lineage, "child string, ancestor string, depth int")).collect()
    assert {(x.source_symbol_id, x.source_file_path, x.line): (x.target_symbol_id, x.target_file_path) for x in got} == {k: v[2:] for k, v in want.items()}
    assert len(got) == len(want)


def test_one_name_of_very_many_methods(spark):
    """Methods meet their class's choice: met with each other these make 10,000,000,000 pairs."""
    n = 100_000
    m = spark.range(2 * n).select(F.concat(F.lit("m"), "id").alias("id"), F.lit("run").alias("name"), F.col("id").alias("symbol_index"), F.when(F.col("id") < n, "up").otherwise("down").alias("parent_symbol_id"), F.lit("f").alias("file_path"), F.col("id").cast("int").alias("start_line"), F.lit("Method").alias("kind"))
    got = rs.override_edges(m, spark.createDataFrame([("down", "up", 1)], "child string, ancestor string, depth int"))
    assert [tuple(x) for x in got.groupBy("target_symbol_id").count().collect()] == [("m0", n)]
