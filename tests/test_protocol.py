import pytest
from pyspark.sql import types as T

from kelpwright.operators import protocol as P


def test_config_rules_and_hash():
    rules = {"k": P.Rule(int, positive=True), "rate": P.Rule((int, float), positive=True), "name": P.Rule(str, choices=("a", "b"))}
    assert P.validate_config({"k": 3, "rate": 0.5, "name": "a"}, rules) == []
    bad = P.validate_config({"k": True, "rate": float("nan"), "name": "c", "seed": 1}, rules, forbidden=["seed"])
    assert bad == ["seed: unknown", "seed: not allowed here", "k: wrong type", "rate: not finite", "name: not one of ['a', 'b']"]
    assert P.config_hash({"a": 1, "b": 2}) == P.config_hash({"b": 2, "a": 1})


def test_gate_opens_once_frozen():
    gate = P.FrozenGate()
    with pytest.raises(RuntimeError):
        gate.open_test({"k": 1}, lambda: None)
    gate.freeze({"k": 1})
    assert gate.open_test({"k": 1}, lambda: 5) == 5
    for f in (lambda: gate.freeze({"k": 2}), lambda: gate.open_test({"k": 2}, lambda: None)):
        with pytest.raises(RuntimeError):
            f()


def test_grid_is_memoized_and_refined():
    calls = []

    def evaluate(c):
        calls.append(c)
        return {"ndcg": -abs(c["k"] - 2) + c.get("m", 0)}

    search = P.GridSearch(evaluate, ["ndcg"])
    configs = P.grid({"k": [1, 2, 3], "s": [0]})
    assert search.run(configs)[0][0] == {"k": 2, "s": 0}
    search.run(configs)
    assert len(calls) == 3
    assert search.refine("m", [1, 2], top=1)[0][0] == {"k": 2, "s": 0, "m": 2} and len(calls) == 5


def test_ablations_differ_in_allowed_fields_only():
    base = {"tower": {"pool": "mean", "deep": False}, "seed": 42}
    runs = P.ablations(base, {"A": {"tower": {"pool": "lstm"}}, "B": {"tower": {"deep": True}}})
    assert runs["A"] == {"tower": {"pool": "lstm", "deep": False}, "seed": 42}
    assert P.matrix_differences(runs, ["tower.pool", "tower.deep"]) == []
    assert P.matrix_differences(runs | {"C": {"tower": base["tower"], "seed": 1}}, ["tower.pool", "tower.deep"]) == ["seed"]


def test_registry():
    r = P.Registry()
    r.add("x", lambda k: k * 2)
    assert r.make("x", k=2) == 4
    with pytest.raises(ValueError):
        r.add("x", None)
    with pytest.raises(ValueError):
        r.make("y")


def test_stage_completeness_and_results(spark):
    df = spark.createDataFrame([("a", "p1", "e"), ("b", "p2", "e")], "model string, protocol string, evaluator string")
    assert {r.blocker for r in P.stage_completeness(df, ["a", "b", "c"]).collect()} == {"missing model: c", "several protocols"}
    schema = T.StructType([T.StructField("model", T.StringType()), T.StructField("ndcg", T.DoubleType())])
    assert P.assemble_results(spark, [{"model": "a"}], schema, optional=["ndcg"]).first().ndcg is None
    for row in ({"model": "a"}, {"model": "a", "ndcg": 1.0, "x": 1}):
        with pytest.raises(ValueError):
            P.assemble_results(spark, [row], schema)


def test_checkpoints(spark, tmp_path):
    root, t = f"file://{tmp_path}", spark.createDataFrame([(1, [0.5])], "idx int, f array<double>")
    assert P.latest_checkpoint(spark, root + "/none", {}) is None
    P.publish_checkpoint(spark, root, 1, {"users": t}, {"k": 1})
    P.publish_checkpoint(spark, root, 2, {"users": t.union(t)}, {"k": 1})
    broken = P.publish_checkpoint(spark, root, 3, {"users": t}, {"k": 1})
    (tmp_path / "step-000000003/COMPLETE.json/_SUCCESS").unlink()
    assert broken.endswith("3")
    step, tables = P.latest_checkpoint(spark, root, {"k": 1})
    assert step == 2 and P.equal_tables(tables["users"], t.union(t)) and not P.equal_tables(tables["users"], t)
    assert P.latest_checkpoint(spark, root, {"k": 2}) is None
