"""What a step holds or writes grows with the objects, not with rules times objects, and no table of the data's size is broadcast."""

from pyspark.sql import functions as F

from quadweave import steps
from quadweave.model import graph
from quadweave.operators import hot, mutate, references
from quadweave.plans import shapes
from quadweave.plans.shapes import Rule, validate
from quadweave.steps import written


def _wrong(kind: str, failed: int, parts: int) -> bool:
    return {"and": failed > 0, "or": failed == parts, "not": failed == 0, "xone": failed != parts - 1}[kind]


def test_parts_are_bits_of_words(spark, monkeypatch):
    """Also of rules with more parts than a word has bits, and of rules inside rules; nothing is written for each part of an object."""
    sizes = []
    plain = shapes.written

    def spy(df, name):
        out = plain(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(shapes, "written", spy)
    g = graph(spark, [x for i in range(20) for x in [(f"o{i}", "Type", "O", "e"), (f"o{i}", "O.n", str(i), "e")]])
    rules, expected = [], set()
    for k, (kind, parts) in enumerate([(kind, parts) for kind in ("and", "or", "not", "xone") for parts in (1, 3, 63, 70, 130)]):
        rules.append(Rule(f"r{k}", kind, "O", name=f"r{k}"))
        bounds = [(a * 7 + k) % 23 for a in range(parts)]
        rules += [Rule(f"r{k}", "minInclusive", "O", "O.n", b, parent=f"r{k}", alternative=a) for a, b in enumerate(bounds)]
        expected |= {(f"o{i}", f"r{k}") for i in range(20) if _wrong(kind, sum(i < b for b in bounds), parts)}
    # One inside another: not (and (n >= 5, n >= 10)), beside n >= 3.
    rules += [Rule("deep", "or", "O", name="deep"), Rule("deep", "not", "O", name="inner", parent="deep", alternative=0), Rule("deep", "minInclusive", "O", "O.n", 15, parent="deep", alternative=1)]
    rules += [Rule("deep", "and", "O", name="least", parent="inner"), *(Rule("deep", "minInclusive", "O", "O.n", b, parent="least", alternative=a) for a, b in enumerate((5, 10)))]
    expected |= {(f"o{i}", "deep") for i in range(10, 15)}
    rules += [Rule("empty", kind, "O", name=f"empty {kind}") for kind in ("and", "or")]
    expected |= {(f"o{i}", "empty") for i in range(20)}
    rules.append(Rule("plain", "maxInclusive", "O", "O.n", 17))
    expected |= {(f"o{i}", "plain") for i in (18, 19)}
    found = [(r["ID"], r["SOURCE_SHAPE"]) for r in validate(g, rules).select("ID", "SOURCE_SHAPE").collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    assert max(sizes) <= 20 * 30  # a row for each part would be thousands


def test_two_rules_of_one_name_share_their_parts(spark):
    g = graph(spark, [x for i in range(6) for x in [(f"o{i}", "Type", "O", "e"), (f"o{i}", "O.n", str(i), "e"), (f"o{i}", "O.to", f"o{(i + 1) % 6}", "e")]])
    rules = [Rule("a", "and", "O", name="both"), Rule("b", "not", "O", name="both"), Rule("p", "minInclusive", "O", "O.n", 3, parent="both")]
    found = validate(g, rules)
    assert {(r["ID"], r["SOURCE_SHAPE"]) for r in found.collect()} == {(f"o{i}", "a" if i < 3 else "b") for i in range(6)}
    assert found.where(F.col("VIOLATION_TYPE").isin("and", "not")).count() == 6


def test_upserts_send_neither_table_whole(spark):
    g = graph(spark, [(f"o{i}", "O.n", str(i), "e") for i in range(9)])
    changes = graph(spark, [("o1", "O.n", "x", "e"), ("o1", "O.n", "later", "e"), ("new", "O.n", None, "e")]).drop("INSTANCE_ID")
    found = mutate.update_from_facts(written(g, "facts"), written(changes, "changes"))  # of files Spark guesses a size
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(f"o{i}", "x" if i == 1 else str(i)) for i in range(9)} | {("new", None)}
    assert {(r["ID"], r["VALUE"]) for r in found.collect()} == want and found.count() == 10


def test_walks_send_what_is_small_and_merge_the_rest(spark, monkeypatch):
    """Objects known at a level are counted before they are sent; facts themselves never are, nor are all IDs looked up."""
    facts = [x for i in range(30) for x in [(f"a{i}", "Type", "A", "e"), (f"a{i}", "A.to", "b", "e"), (f"a{i}", "A.note", "no object", "e")]]
    g = graph(spark, facts + [("b", "Type", "B", "e"), ("b", "B.to", "c", "e"), ("c", "Type", "C", "e")])
    sent = []
    plain = hot.sized
    monkeypatch.setattr(references, "sized", lambda table, *a: sent.append(table.count()) or plain(table, *a))
    levels = lambda found: sorted((r["ID"], r["level"]) for r in found.select("ID", "level").distinct().collect())
    for most in (hot.MOST_MATCHES, 2):
        monkeypatch.setattr(hot, "MOST_MATCHES", most)
        assert levels(references.references_to(g, "c", 2)) == sorted([("c", 0), ("b", 1), *((f"a{i}", 2) for i in range(30))])
        assert levels(references.references_from(g, "a7", 9)) == [("a7", 0), ("b", 1), ("c", 2)]
        plan = references.references_to(g, "c", 2)._jdf.queryExecution().executedPlan().toString()
        assert ("SortMergeJoin" in plan) == (most == 2)
    assert max(sent) == 30
    assert references.references_to(g, "nothing", 2).count() == 0 and references.references_from(g, "B", 1).count() == 0


def test_counts_of_values_are_dealt_by_rows(spark, monkeypatch):
    """Tasks follow the number of rows; values of nested shapes are looked up once; claims between depths are told as before."""
    facts = [x for i in range(120) for x in [(f"o{i}", "Type", "O", "e"), *((f"o{i}", "O.p", f"p{(i + k) % 40}", "e") for k in range(i % 6)), (f"o{i}", "O.p", f"p{i % 40}", "e")]]
    g = graph(spark, facts + [x for i in range(40) for x in [(f"p{i}", "Type", "P", "e"), (f"p{i}", "P.n", str(i), "e")]])
    rules = [Rule("some", "qualifiedMinCount", "O", "O.p", 2, ("large",), name="some"), Rule("some", "minInclusive", "nodes of some", "P.n", 10, parent="some")]
    rules += [Rule("large", "qualifiedMaxCount", "O", "O.p", 3, name="large"), Rule("large", "minInclusive", "nodes of large", "P.n", 30, parent="large")]
    rules += [Rule("all", "node", "O", "O.p", name="all"), Rule("all", "maxInclusive", "nodes of all", "P.n", 37, parent="all"), Rule("few", "maxCount", "O", "O.p", 5), Rule("any", "minCount", "O", "O.p", 2)]
    own = {i: {(i + k) % 40 for k in range(max(i % 6, 1))} for i in range(120)}
    want = {(f"o{i}", "some") for i, p in own.items() if len([x for x in p if 10 <= x < 30]) < 2} | {(f"o{i}", "large") for i, p in own.items() if len([x for x in p if x >= 30]) > 3}
    want |= {(f"o{i}", "all") for i, p in own.items() if any(x > 37 for x in p)} | {(f"o{i}", "few") for i in own if i % 6 + 1 > 5} | {(f"o{i}", "any") for i in own if i % 6 + 1 < 2}
    asked = []
    plain = shapes._Run.values
    monkeypatch.setattr(shapes._Run, "values", lambda self, *a: asked.append(1) or plain(self, *a))
    parts = {}
    for rows in (500_000, 50):
        monkeypatch.setattr(steps, "ROWS", rows)
        asked.clear()
        found = validate(g, rules).select("ID", "SOURCE_SHAPE")
        assert {(r["ID"], r["SOURCE_SHAPE"]) for r in found.collect()} == want
        assert len(asked) == 4  # two kinds of nested values, conditions on values, bounds on counts
        parts[rows] = shapes._Run(g, rules, True).members.rdd.getNumPartitions()
    assert parts[50] == -(-g.count() // 50) > parts[500_000]


def test_classes_are_looked_up_where_values_are_dealt(spark, monkeypatch):
    """Conditions on classes of values, dealt by rows, find the same, also inside instances; nothing is merged by a sort."""
    facts = [x for i in range(60) for x in [(f"o{i}", "Type", "O", f"e{i % 2}"), (f"o{i}", "O.to", f"c{i % 9}", f"e{i % 2}")]]
    g = graph(spark, facts + [(f"c{i}", "Type", "C" if i % 2 else "D", "e0") for i in range(7)])
    rules = [Rule("a", "class", "O", "O.to", "C"), Rule("b", "range", "O", "O.to", values=("C", "E"))]
    monkeypatch.setattr(steps, "ROWS", 10)
    found = validate(g, rules).select("ID", "SOURCE_SHAPE")
    want = {(f"o{i}", "a") for i in range(60) if i % 9 in (0, 2, 4, 6, 7, 8)} | {(f"o{i}", "b") for i in range(60) if i % 9 in (0, 2, 4, 6)}
    assert {(r["ID"], r["SOURCE_SHAPE"]) for r in found.collect()} == want
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    rules = [Rule(r.shape, r.component, r.target, r.path, r.value, r.values, profile="p") for r in rules]
    pairs = spark.createDataFrame([("e0", "p"), ("e1", "p")], "INSTANCE_ID string, PROFILE string")
    inside = {(r["ID"], r["SOURCE_SHAPE"]) for r in validate(g, rules, pairs=pairs).collect()}
    assert inside == {x for x in want if int(x[0][1:]) % 2 == 0} | {(f"o{i}", "a") for i in range(1, 60, 2)}


def test_violations_are_found_once_and_presented(spark):
    """Their plan is not part of the plan that presents them."""
    from quadweave.plans.presented import presented

    g = graph(spark, [x for i in range(9) for x in [(f"o{i}", "Type", "O", "e"), (f"o{i}", "O.n", "1", "e"), (f"o{i}", "O.n", str(i), "e")]])
    rules = [Rule("a", "maxCount", "O", "O.n", 1)]
    found = presented(validate(g, rules), g, rules)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("component") == 0
    assert {r["TARGET"] for r in found.collect()} == {f"found 2 values: '1', '{i}'" for i in range(9)}


def test_names_without_instances_are_plain(spark):
    """Walks inside one graph carry IDs as they are, and no texts of JSON."""
    from quadweave.plans import paths

    g = graph(spark, [("a", "k", "b", "e"), ("b", "k", "c\"{}", "e")])
    found = paths.pairs(g, ("zero_or_one", "k"), starts=g.select("ID").distinct())
    assert "json" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {("a", "a"), ("b", "b"), ("a", "b"), ("b", 'c"{}')}
