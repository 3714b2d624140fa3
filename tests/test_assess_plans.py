from codeloom.operators import assess


def test_pairs_that_share_several_keys_count_once_without_being_gathered(spark):
    rows = [(f"b{i}", ["crowd", "one", "two"] if i < 3 else ["crowd"], ["s"]) for i in range(8)]
    got = assess.behavior_pairs(spark.createDataFrame(rows, "id string, keys array<string>, selectors array<string>"), most_bucket=4)
    assert sorted((r.a, r.b, r.relation) for r in got.collect()) == [("b0", "b1", "Identical"), ("b0", "b2", "Identical"), ("b1", "b2", "Identical")]
    # No aggregation over pairs comes after the join that makes them.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]


def test_forwarders_are_not_sent_to_the_driver(spark):
    got = assess.forwarder_chains(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("x", "z")], "source string, target string"))
    assert [(r.start, r.length, r.chain) for r in got.collect()] == [("a", 4, "a -> b -> c -> d")]
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
