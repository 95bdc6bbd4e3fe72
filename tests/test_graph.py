"""Hand-built graphs with known answers."""

import pytest
from pyspark.sql import functions as F

from quadweave import model
from quadweave.functions import counts, grid
from quadweave.operators import diff, filters, mutate, references, tableview
from quadweave.plans import patterns
from quadweave.plans.shapes import Rule, report_lines, sarif, validate, violations_of_report

MULTI = [("m1", "Type", "MultiThing", "mi"), ("m1", "name", "first", "mi"), ("m1", "name", "second", "mi"), ("m2", "Type", "MultiThing", "mi"), ("m2", "name", "solo", "mi")]
CHAIN = [(n, "Type", "Thing", "i") for n in "abcd"] + [("a", "Thing.To", "b", "i"), ("b", "Thing.To", "c", "i"), ("c", "Thing.To", "a", "i"), ("d", "Thing.To", "zzz", "i")]
LOADS = [("c1", "Type", "ConformLoad", "s"), ("c1", "EnergyConsumer.p", "10", "s"), ("c1", "EnergyConsumer.q", "5", "s"), ("c2", "Type", "ConformLoad", "s"), ("c2", "EnergyConsumer.p", "20", "s"), ("c2", "EnergyConsumer.q", "8", "s"), ("n1", "Type", "NonConformLoad", "s"), ("n1", "EnergyConsumer.p", "3", "s"), ("n1", "EnergyConsumer.q", "1", "s")]
HEADER = [("h", "Type", "FullModel", "s"), ("h", "Model.version", "7", "s"), ("d", "Type", "Distribution", "s"), ("d", "label", "20230101T0000Z_1D_ENTSOE_EQ_001.xml", "s")]


def _set(df, *columns):
    return {tuple(r) for r in (df.select(*columns) if columns else df).collect()}


def test_multivalue_views(spark):
    g = model.graph(spark, MULTI)
    assert _set(tableview.type_tableview(g, "MultiThing"), "ID", "name") == {("m1", "first"), ("m2", "solo")}
    shown = tableview.rendered(tableview.type_tableview(g, "MultiThing", multivalue=True))
    assert _set(shown, "ID", "name") == {("m1", "['first', 'second']"), ("m2", "solo")}
    back = tableview.facts_of_view(tableview.type_tableview(g, "MultiThing", multivalue=True), "mi")
    assert _set(back, "ID", "KEY", "VALUE", "INSTANCE_ID") == set(MULTI)


def test_views_of_nothing(spark):
    g = model.graph(spark, MULTI)
    empty = tableview.type_tableview(g, "Nothing")
    assert empty.columns == ["ID"] and empty.count() == 0


def test_numbers_only_where_all_are(spark):
    g = model.graph(spark, [("a", "x", "1", "i"), ("b", "x", "2.5e1", "i"), ("a", "y", "1", "i"), ("b", "y", "1d", "i")])
    view = tableview.numbers(tableview.wide(g))
    assert dict(view.dtypes) == {"ID": "string", "x": "double", "y": "string"}


def test_empty_list_selects_nothing(spark):
    g = model.graph(spark, MULTI)
    assert filters.filter_facts(g, ID=[]).count() == 0
    assert filters.filter_facts(g, VALUE="sec", regex=True).count() == 1


def test_walks_end_and_keep_the_first_link(spark):
    g = model.graph(spark, CHAIN)
    assert _set(references.references_to(g, "a", 3).where("KEY = 'Type'"), "ID", "level") == {("a", 0), ("c", 1), ("b", 2), ("a", 3)}
    assert _set(references.references_from(g, "a", 2).where("KEY = 'Type'"), "ID", "level") == {("a", 0), ("b", 1), ("c", 2)}
    assert _set(references.dangling_references(g)) == {("Thing.To", 1)}


def test_closure_of_a_cycle(spark):
    g = model.graph(spark, CHAIN)
    links = g.where("KEY = 'Thing.To'").select("ID", "VALUE")
    assert _set(references.dependency_closure(links, spark.createDataFrame([("a",)], "ID string"))) == {("a", "a"), ("a", "b"), ("a", "c")}
    assert ("a", "a") in _set(patterns.one_or_more(patterns.path(g, ["Thing.To"])))


def test_upserts(spark):
    g = model.graph(spark, MULTI)
    change = spark.createDataFrame([("m2", "name", None), ("new", "Type", "X")], "ID string, KEY string, VALUE string")
    got = _set(mutate.update_from_facts(g, change), "ID", "KEY", "VALUE", "INSTANCE_ID")
    assert got == (set(MULTI) - {MULTI[-1]}) | {("m2", "name", None, "mi"), ("new", "Type", "X", None)}
    again = mutate.update_from_facts(mutate.update_from_facts(g, change), change)
    assert _set(again, "ID", "KEY", "VALUE", "INSTANCE_ID") == got


def test_diff_and_digest(spark):
    g = model.graph(spark, [("a", "k", None, "i"), ("b", "k", "", "i")])
    assert diff.diff(g, g).count() == 0
    empty, null = model.graph(spark, [("a", "k", "", "i")]), model.graph(spark, [("a", "k", None, "i")])
    assert diff.content_hash(empty) != diff.content_hash(null)
    assert diff.content_hash(g) == diff.content_hash(g.orderBy(F.desc("ID")))
    assert diff.content_hash(g, order_sensitive=True) != diff.content_hash(g.withColumn("_ord", 1 - F.col("_ord")), order_sensitive=True)
    assert "+ k: x" in diff.diff_text(null, model.graph(spark, [("a", "k", "x", "i")]))


def test_scaled_loads(spark):
    g = grid.scale_load(model.graph(spark, LOADS), 100)
    view = {r["ID"]: r for r in tableview.wide(g, ["EnergyConsumer.p", "EnergyConsumer.q"]).collect()}
    assert float(view["c1"]["EnergyConsumer.p"]) == pytest.approx(32.3333333)
    assert float(view["c2"]["EnergyConsumer.p"]) == pytest.approx(64.6666667)
    assert float(view["c1"]["EnergyConsumer.q"]) == pytest.approx(32.3333333 * 13 / 30)
    assert view["n1"]["EnergyConsumer.p"] == "3"


def test_header_from_file_name_and_back(spark):
    g = grid.header_from_filenames(model.graph(spark, HEADER))
    header = grid.header_of(g)
    assert header["Model.scenarioTime"] == "20230101T0000Z" and header["Model.messageType"] == "EQ" and header["Model.version"] == "7"
    renamed = grid.filenames_from_header(g)
    assert _set(renamed.where("KEY = 'label'"), "VALUE") == {("20230101T0000Z_1D_ENTSOE_EQ_007.xml",)}


def test_terminals_are_switched_in_their_instance(spark):
    g = model.graph(spark, [("t", "Terminal.ConductingEquipment", "e", "EQ"), ("t", "ACDCTerminal.connected", "true", "SSH"), ("u", "ACDCTerminal.connected", "true", "SSH")])
    got = _set(grid.switch_terminals(g, "e").where("KEY = 'ACDCTerminal.connected'"), "ID", "VALUE", "INSTANCE_ID")
    assert got == {("t", "false", "SSH"), ("u", "true", "SSH")}
    with pytest.raises(ValueError):
        grid.switch_terminals(g, "e", "maybe")


def test_limits(spark):
    rows = [("s", "Type", "OperationalLimitSet", "i"), ("s", "OperationalLimitSet.Terminal", "t", "i"), ("l", "Type", "CurrentLimit", "i"), ("l", "OperationalLimit.OperationalLimitSet", "s", "i"), ("l", "OperationalLimit.OperationalLimitType", "y", "i"), ("l", "CurrentLimit.value", "5", "i"), ("y", "Type", "OperationalLimitType", "i"), ("y", "IdentifiedObject.name", "PATL", "i"), ("t", "Type", "Terminal", "i"), ("t", "Terminal.ConductingEquipment", "e", "i"), ("e", "Type", "ACLineSegment", "i")]
    assert _set(grid.limits(model.graph(spark, rows)), "limit_id", "ID_Equipment", "Equipment_Type", "value") == {("l", "e", "ACLineSegment", "5")}


def test_models_with_cyclic_dependencies(spark):
    sv = grid.STATE_VARIABLES
    g = model.graph(spark, [("sv", "Model.profile", sv, "1"), ("sv", "Model.DependentOn", "tp", "1"), ("tp", "Model.profile", "TP", "2"), ("tp", "Model.DependentOn", "sv", "2")])
    assert _set(grid.loaded_models(g)) == {("sv", "sv", sv, "1"), ("sv", "tp", "TP", "2")}


def test_counts(spark):
    g = model.graph(spark, [*MULTI, ("m1", "Type", "MultiThing", "again")])
    assert _set(counts.types_count(g)) == {("MultiThing", 2)}
    assert _set(counts.types_count(g, contains="multi")) == {("MultiThing", 2)}
    assert counts.types_count(g, contains="multi", ignore_case=False).count() == 0


UNBOUND = [("a", None), ("b", "x"), ("c", None), ("d", "w")], [("a", "y"), ("b", "z"), ("b", "x"), ("c", None), ("e", "w")]


def _compatible(a, b):
    return all(x is None or y is None or x == y for x, y in zip(a, b, strict=True))


def _merged(a, b):
    return tuple(y if x is None else x for x, y in zip(a, b, strict=True))


def test_unbound_variables_fit_any_value(spark):
    left, right = (spark.createDataFrame(rows, "n string, v string") for rows in UNBOUND)
    pairs = {(a, b) for a in UNBOUND[0] for b in UNBOUND[1] if _compatible(a, b) and any(x is not None and y is not None for x, y in zip(a, b, strict=True))}
    have = {a for a, _ in pairs}
    # Without rows that are unbound in all, no pair is without a common variable.
    assert _set(patterns.exists(left, right)) == {a for a in UNBOUND[0] if a in have} == {("a", None), ("b", "x"), ("c", None)}
    assert _set(patterns.not_exists(left, right)) == _set(patterns.minus(left, right)) == {("d", "w")}
    on_n = right.where("n is not null")
    assert _set(patterns.optional(left, on_n)) == {_merged(a, b) for a, b in pairs} | {("d", "w")} == {("a", "y"), ("b", "x"), ("c", None), ("d", "w")}
    assert _set(patterns.join(left, on_n)) == {_merged(a, b) for a, b in pairs}
    # The case of one row each side: unbound takes the value.
    assert _set(patterns.optional(spark.createDataFrame([("a", None), ("b", "x")], "n string, v string"), spark.createDataFrame([("a", "y"), ("b", "z")], "n string, v string"))) == {("a", "y"), ("b", "x")}


def test_rows_with_nothing_bound_in_common(spark):
    left = spark.createDataFrame([(None, "p"), ("1", "q")], "v string, l string")
    right = spark.createDataFrame([(None, "r"), ("2", "s")], "v string, r string")
    assert _set(patterns.minus(left, right)) == {(None, "p"), ("1", "q")}
    assert _set(patterns.exists(left, right)) == {(None, "p"), ("1", "q")}
    with pytest.raises(Exception, match="no variable bound in common"):
        patterns.join(left, right).collect()
    many = spark.createDataFrame([("a", None, "1", None), ("b", "2", None, "x")], "n string, p string, q string, r string")
    more = spark.createDataFrame([("a", "5", None, "y"), ("b", "3", "4", "x")], "n string, p string, q string, r string")
    assert _set(patterns.optional(many, more)) == {("a", "5", "1", "y"), ("b", "2", None, "x")}


def test_closures_grow_from_their_starts(spark, monkeypatch):
    from quadweave.operators import reach as r

    n = 10_000
    chain = spark.range(n).selectExpr("concat('n', id) AS s", "concat('n', id + 1) AS o")
    start = spark.createDataFrame([("n0",), ("nowhere",), (None,)], "s string")
    assert r.reach(chain, start).count() == n and r.reach(chain, start, zero=True).count() == n + 2
    assert patterns.one_or_more(chain, spark.createDataFrame([("n9990",)], "s string")).count() == 10
    links = [(f"a{i}", f"a{(i * 7 + 1) % 23}") for i in range(23)] + [("a3", "b"), ("b", "b"), ("a3", "b"), (None, "a1"), ("a1", None)]
    starts = spark.createDataFrame([("a0",), ("b",), ("z",)], "s string")
    found = [_set(r.reach(spark.createDataFrame(links, "s string, o string"), starts, zero=zero)) for zero in (False, True)]
    monkeypatch.setattr(r, "BROADCAST_LINKS", 0)
    monkeypatch.setattr(r, "COMPACT", 3)
    assert found == [_set(r.reach(spark.createDataFrame(links, "s string, o string"), starts, zero=zero)) for zero in (False, True)]
    with pytest.raises(ValueError, match="longer than 5"):
        r.reach(chain, start, most=5)


def test_zero_or_one_and_negated(spark):
    g = model.graph(spark, CHAIN)
    links = patterns.path(g, ["Thing.To"])
    assert _set(patterns.zero_or_one(g, links, spark.createDataFrame([("a",), ("x",)], "s string"))) == {("a", "a"), ("a", "b"), ("x", "x")}
    assert _set(patterns.negated(g, ["Type"])) == {("a", "b"), ("b", "c"), ("c", "a"), ("d", "zzz")}
    assert _set(patterns.negated(g, ["Type"], ["Type"])) == {(a, b) for x in ("ab", "bc", "ca") for a, b in (x, x[::-1])} | {("d", "zzz"), ("zzz", "d")}
    assert _set(patterns.negated(g, [], ["Type"])) == {("b", "a"), ("c", "b"), ("a", "c"), ("zzz", "d")}


def test_parts_of_many_rules_share_one_plan(spark):
    from time import perf_counter

    g = _breakers(spark, b1=["5"], b2=["50"], b3=["500"])

    def rules(n):
        return [r for i in range(n) for r in (Rule(f"s{i}", "or", "Breaker", name=f"o{i}"), Rule(f"s{i}", "minInclusive", "Breaker", "name", 10 * i, parent=f"o{i}"), Rule(f"s{i}", "in", "Breaker", "name", values=("5",), parent=f"o{i}", alternative=1))]

    plan = lambda n: validate(g, rules(n))._jdf.queryExecution().executedPlan().toString().count("Scan")
    began = perf_counter()
    assert plan(3) == plan(200) and perf_counter() - began < 60
    assert validate(g, rules(200)).count() == sum(v != 5 and v < 10 * i for v in (5, 50, 500) for i in range(200))


def test_parts_inside_parts(spark):
    """b is fine if not (name below 10 or above 100) and its bay, if any, is exactly one of open and new."""
    rows = [(i, "Type", "Breaker", "eq") for i in ("b1", "b2", "b3", "b4")] + [("b1", "name", "5", "eq"), ("b2", "name", "50", "eq"), ("b3", "name", "500", "eq"), ("b4", "name", "60", "eq"), ("b4", "bay", "y1", "eq"), ("b2", "bay", "y2", "eq"), ("y1", "state", "open", "eq"), ("y2", "state", "open", "eq"), ("y2", "age", "new", "eq")]
    rules = [
        Rule("s", "and", "Breaker", name="all"),
        Rule("s", "not", "Breaker", parent="all", name="not"),
        Rule("s", "or", "Breaker", parent="not", name="far"),
        Rule("s", "maxExclusive", "Breaker", "name", 10, parent="far", alternative=0),
        Rule("s", "minExclusive", "Breaker", "name", 100, parent="far", alternative=1),
        Rule("s", "node", "Breaker", "bay", parent="all", alternative=1, name="bay"),
        Rule("s", "xone", "nodes of bay", parent="bay", name="one"),
        Rule("s", "hasValue", "nodes of bay", "state", "open", parent="one", alternative=0),
        Rule("s", "hasValue", "nodes of bay", "age", "new", parent="one", alternative=1),
    ]
    assert _set(validate(model.graph(spark, rows), rules), "ID", "VIOLATION_TYPE") == {("b1", "and"), ("b3", "and"), ("b2", "and")}
    with pytest.raises(ValueError, match="part of itself"):
        validate(model.graph(spark, rows), [Rule("s", "not", "Breaker", name="x", parent="x")])


def test_a_warning_of_form_is_no_failure_of_a_part(spark):
    rules = [Rule("s", "not", "Breaker", name="n"), Rule("s", "datatype", "Breaker", "name", "float", parent="n")]
    assert _set(validate(_breakers(spark, b1=["5"], b2=["x"]), rules), "ID") == {("b1",)}


def test_profiles_of_headers(spark):
    from quadweave.plans import profiles as pr

    name = {"name": {"min": 1, "max": 1}}
    known = [pr.Profile("EQ", {"Breaker": name}, "EQ", "http://v/EQ", "urn:all"), pr.Profile("SSH", {"Breaker": {"state": {"min": 1}}}, "SSH", "http://v/SSH", "urn:all"), pr.Profile("TP", {}, "TP")]
    assert pr.names_of(known) == {"EQ": "EQ", "http://v/EQ": "EQ", "SSH": "SSH", "http://v/SSH": "SSH", "TP": "TP"}
    header = [("h", "conformsTo", "http://v/EQ", "1"), ("h", "Model.messageType", "SSH", "1"), ("h", "label", "one.xml", "1"), ("h", "label", "other.xml", "1"), ("h", "Model.profile", "http://x/Topology/EquipmentCore", "2"), ("h", "keyword", None, "3"), ("h", "conformsTo", "urn:all", "3"), ("h", "Model.profile", "http://x/Dynamics/1", "4")]
    objects = [("b", "Type", "Breaker", i) for i in "12345"] + [("b", "name", "x", "2"), ("b", "name", "y", "2")]
    g = model.graph(spark, header + objects)
    assert _set(pr.declared(g, known), "INSTANCE_ID", "PROFILE") == {("1", "EQ"), ("1", "SSH"), ("2", "EQ"), ("2", "TP")}
    assert _set(pr.resolved(g, known)) == {("1", "one.xml", "SSH"), ("2", None, "EQ"), ("3", None, None), ("4", None, None), ("5", None, None)}
    assert {(r["INSTANCE_ID"], tuple(r["HINTS"])) for r in pr.undeclared(g, known).collect()} == {("3", ("urn:all",)), ("4", ("http://x/Dynamics/1",)), ("5", ())}
    found = pr.validate_profiles(g, known)
    assert _set(found, "INSTANCE_ID", "PROFILE", "ID", "KEY", "VIOLATION_TYPE") == {("1", "EQ", "b", "name", "minCount"), ("1", "SSH", "b", "state", "minCount"), ("2", "EQ", "b", "name", "maxCount")}
    assert _set(pr.validate_profiles(g, known, chosen=["SSH"]), "INSTANCE_ID", "PROFILE") == {(i, "SSH") for i in "12345"}
    with pytest.raises(ValueError, match="no profile is called"):
        pr.validate_profiles(g, known, chosen=["urn:all"])
    # References are looked up in the instance alone.
    linked = [pr.Profile("EQ", {"Line": {"to": {"range": ["Bay"]}}}, "EQ")]
    rows = [("h", "keyword", "EQ", "1"), ("l", "Type", "Line", "1"), ("l", "to", "s", "1"), ("s", "Type", "Station", "2")]
    assert pr.validate_profiles(model.graph(spark, rows), linked).count() == 0
    assert pr.validate_profiles(model.graph(spark, [*rows, ("s", "Type", "Station", "1")]), linked).count() == 1


def test_what_was_found_and_expected(spark):
    from quadweave.plans.presented import presented

    rows = [("a", "Type", "Line", "i"), *[("a", "k", f"v{j}", "i") for j in range(7)], ("a", "to", "b", "i"), ("a", "to", "gone", "i"), ("b", "Type", "Bay", "i"), ("b", "IdentifiedObject.name", "B 1", "i"), ("c", "Type", "Line", "i"), ("c", "k", "x", "i"), ("c", "k", "y", "i")]
    rules = [Rule("s", "maxCount", "Line", "k", 1, message="too many"), Rule("s", "class", "Line", "to", "Line"), Rule("t", "in", "Line", "to/Type", values=("Line", "Pole"), way=("sequence", "to", "Type")), Rule("s", "minCount", "Line", "z", 2)]
    g = model.graph(spark, rows)
    got = _set(presented(validate(g, rules), g, rules), "ID", "VIOLATION_TYPE", "TARGET", "EXPECTED", "MESSAGE_SOURCE")
    assert got == {
        ("a", "maxCount", "found 7 values: 'v0', 'v1', 'v2', 'v3', 'v4', … (7 total)", "at most 1 value(s)", "shacl"),
        ("c", "maxCount", "found 2 values: 'x', 'y'", "at most 1 value(s)", "shacl"),
        ("a", "class", 'referenced object b found — Bay "B 1"', "a reference to a Line", "engine"),
        ("a", "class", "referenced object gone not found in the data", "a reference to a Line", "engine"),
        ("a", "in", "association target found, of type Bay", "one of: Line, Pole", "engine"),
        ("a", "minCount", None, "at least 2 value(s)", "engine"), ("c", "minCount", None, "at least 2 value(s)", "engine"),
    }


def _breakers(spark, **named):
    rows = []
    for i, values in named.items():
        rows += [(i, "Type", "Breaker", "eq")] + [(i, "name", v, "eq") for v in values]
    return model.graph(spark, rows)


@pytest.mark.parametrize(
    "rule, data, want",
    [
        (Rule("s", "minCount", "Breaker", "name", 1), {"b1": ["x"], "b2": []}, {("b2", None)}),
        (Rule("s", "maxCount", "Breaker", "name", 1), {"b1": ["x", "y"], "b2": ["z"]}, {("b1", None)}),
        (Rule("s", "pattern", "Breaker", "name", r"\d"), {"b1": ["OK name"], "b2": ["N1"]}, {("b1", "OK name")}),
        (Rule("s", "minLength", "Breaker", "name", 2), {"b1": ["x"], "b2": ["xy"]}, {("b1", "x")}),
        (Rule("s", "minInclusive", "Breaker", "name", 0), {"b1": ["-1"], "b2": ["0"], "b3": ["junk"]}, {("b1", "-1")}),
        (Rule("s", "in", "Breaker", "name", values=("open", "closed")), {"b1": ["http://x#open"], "b2": ["broken"]}, {("b2", "broken")}),
        (Rule("s", "datatype", "Breaker", "name", "boolean"), {"b1": ["true"], "b2": ["maybe"]}, {("b2", "maybe")}),
        (Rule("s", "nodeKind", "Breaker", "name", "IRI"), {"b1": ["urn:x"], "b2": ["just text"]}, {("b2", "just text")}),
        (Rule("s", "minCount", "name", "other", 1, subjects_of=True), {"b1": ["x"], "b2": []}, {("b1", None)}),
    ],
)
def test_conditions(spark, rule, data, want):
    assert _set(validate(_breakers(spark, **data), [rule]), "ID", "VALUE") == want


def test_a_value_can_be_fine_but_narrow(spark):
    found = validate(_breakers(spark, b1=["5"], b2=["abc"], b3=["2.5"]), [Rule("s", "datatype", "Breaker", "name", "float")])
    assert _set(found, "ID", "VIOLATION_TYPE", "SEVERITY") == {("b1", "lexicalForm", "Warning"), ("b2", "datatype", "Violation")}


def test_sarif(spark):
    found = validate(_breakers(spark, **{f"b{i}": [] for i in range(8)}), [Rule("s", "minCount", "Breaker", "name", 1)])
    result = sarif(found)["runs"][0]["results"]
    assert len(result) == 1 and result[0]["properties"] == {"kind": "minCount", "count": 8}


def test_report_and_back(spark):
    found = validate(_breakers(spark, b1=['x "1"'], b2=[]), [Rule("s", "minCount", "Breaker", "name", 1), Rule("s", "maxLength", "Breaker", "name", 2, message="short")])
    back = violations_of_report(report_lines(found))
    columns = ("ID", "KEY", "VALUE", "MESSAGE", "SEVERITY")
    assert _set(back, *columns) == _set(found, *columns)
    assert _set(back, "VIOLATION_TYPE") == {("minCount",), ("maxLength",)}
