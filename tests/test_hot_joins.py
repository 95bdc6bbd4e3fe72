"""Keys that very many rows share: none of them goes to one task, and results are those of a plain join."""

from pyspark.sql import functions as F

from quadweave.model import graph
from quadweave.operators import hot
from quadweave.plans.shapes import Rule, _Run, validate


def _bag(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_hot_keys_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(hot, "HOT", 50)
    rows = spark.range(300).select("id", F.when(F.col("id") < 200, "a").when(F.col("id") < 260, "b").when(F.col("id") < 270, None).otherwise(F.col("id").cast("string")).alias("k"))
    table = spark.createDataFrame([("a", 1), ("a", 2), ("275", 3), ("none", 4)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert _bag(hot.joined(rows, table, ["k"], how)) == _bag(rows.join(table, ["k"], how))
    plan = hot.joined(rows, table, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    monkeypatch.setattr(hot, "MOST_MATCHES", 1)
    assert _bag(hot.joined(rows, table, ["k"])) == _bag(rows.join(table, ["k"]))


def test_kinds_of_classes_are_not_looked_up(spark, monkeypatch):
    """Values that are classes are references by their path: nothing is joined for them; other values are, by hot keys too."""
    g = graph(spark, [x for i in range(60) for x in [(f"o{i}", "Type", "O", "e"), (f"o{i}", "O.c", "c" if i % 2 else "loose", "e")]] + [("c", "Type", "C", "e")])
    via = Rule("a", "nodeKind", "O", "O.c/Type", "Literal", way=("sequence", "O.c", "Type"))
    joins = []
    monkeypatch.setattr("quadweave.plans.shapes.joined", lambda *a, **k: joins.append(1) or hot.joined(*a, **k))
    assert validate(g, [via]).count() == 30 and not joins
    monkeypatch.setattr(hot, "HOT", 20)
    found = validate(g, [via, Rule("b", "nodeKind", "O", "O.c", "IRI")])
    assert {(r["ID"], r["SOURCE_SHAPE"]) for r in found.collect()} == {(f"o{i}", "a" if i % 2 else "b") for i in range(60)} and joins


def test_facts_meet_objects_before_rules(spark):
    """A fact is shuffled once and not for each of its rules: rules come in behind the last exchange of facts."""
    g = graph(spark, [x for i in range(40) for x in [(f"o{i}", "Type", "O", "e"), (f"o{i}", "O.n", str(i), "e")]])
    run = _Run(g, [Rule(f"r{k}", "minInclusive", "O", "O.n", k) for k in range(30)], True)
    rows = run.values(run.of("minInclusive"))
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    assert rows.count() == 40 * 30
    top = next(line for line in plan.splitlines() if "Join" in line)
    assert "BroadcastHashJoin" in top and "path" in top  # the last join is that with the rules


def test_closure_with_hot_parts(spark, monkeypatch):
    """Very many models depend on one part: the closure and its profiles are the same, by broadcasts of that part."""
    from quadweave.functions import grid
    from quadweave.operators import reach

    monkeypatch.setattr(reach, "BROADCAST_LINKS", 0)
    monkeypatch.setattr(hot, "HOT", 20)
    met = []
    plain = hot.joined
    spy = lambda rows, table, on, how="inner": met.append(on) or plain(rows, table, on, how)
    monkeypatch.setattr(reach, "joined", spy)
    monkeypatch.setattr(grid, "joined", spy)
    facts = [x for i in range(50) for x in [(f"o{i}", "Model.profile", "top", f"i{i}"), (f"o{i}", "Model.DependentOn", "c", f"i{i}")]]
    facts += [("c", "Model.profile", "mid", "ic"), ("c", "Model.profile", "mid", "ic"), ("c", "Model.DependentOn", "r", "ic"), ("r", "Model.profile", "low", "ir")]
    found = _bag(grid.loaded_models(graph(spark, facts), "top"))
    assert found == sorted([x for i in range(50) for x in [(f"o{i}", f"o{i}", "top", f"i{i}"), (f"o{i}", "c", "mid", "ic"), (f"o{i}", "r", "low", "ir")]], key=str)
    assert ["m"] in met and ["ID"] in met
