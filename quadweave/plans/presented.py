"""What a violation found and what it expected: TARGET, EXPECTED and MESSAGE_SOURCE."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadweave.model import ORDER, TYPE
from quadweave.plans import paths
from quadweave.plans.shapes import BROADCAST_RULES, Rule
from quadweave.steps import written

#: Values of a group that are shown.
SHOWN = 5
# How the requirement of each condition is worded.
EXPECTED = {
    "minCount": "at least {} value(s)",
    "maxCount": "at most {} value(s)",
    "minLength": "length >= {}",
    "maxLength": "length <= {}",
    "minInclusive": "value >= {}",
    "maxInclusive": "value <= {}",
    "minExclusive": "value > {}",
    "maxExclusive": "value < {}",
    "pattern": "value matching {}",
    "datatype": "a {} value",
    "class": "a reference to a {}",
    "nodeKind": "an {} value",
    "hasValue": "value {}",
    "in": "one of: {}",
    "range": "a reference to one of: {}",
    "equals": "equal to {}",
    "disjoint": "different from {}",
    "lessThan": "less than {}",
    "lessThanOrEquals": "at most {}",
}
# Kinds of violations of schemas in the words of schema languages.
SCHEMA_KINDS = {"minCount": "xsd:minOccurs", "maxCount": "xsd:maxOccurs", "datatype": "xsd:type", "in": "rdfs:range", "range": "rdfs:range", "closed": "schema:domainIncludes"}


def first_values(data: DataFrame, wanted: DataFrame, most: int = SHOWN) -> DataFrame:
    """(ID, KEY, n, firsts): how many values the pairs in wanted have, and the first `most` by load order.

    Ranks are cut before and after the shuffle, so no group is gathered whole."""
    rows = data.where(F.col("VALUE").isNotNull()).join(wanted.select("ID", "KEY").distinct(), ["ID", "KEY"], "left_semi").select("ID", "KEY", "VALUE", ORDER)
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("ID", "KEY").orderBy(ORDER, "VALUE"))).where(F.col("place") <= most)
    firsts = ranked.groupBy("ID", "KEY").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "VALUE"))), lambda v: v["VALUE"]).alias("firsts"))
    return rows.groupBy("ID", "KEY").agg(F.count("*").alias("n")).join(firsts, ["ID", "KEY"])


def _targets(violations: DataFrame, data: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds TARGET: the object that a reference leads to, or the values that are too many."""
    first = lambda key, name: F.min_by(F.when(F.col("KEY") == key, F.col("VALUE")), F.when(F.col("KEY") == key, F.col(ORDER))).alias(name)
    via = sorted({r.path for r in rules if r.way and paths.ends_in_type(r.way)})
    kind = F.col("VIOLATION_TYPE")
    refers = kind.isin("class", "range") & F.col("VALUE").isNotNull() & ~F.col("KEY").isin(via)
    objects = data.where(F.col("KEY").isin(TYPE, "IdentifiedObject.name")).join(violations.where(refers).select(F.col("VALUE").alias("ID")).distinct(), "ID", "left_semi")
    objects = objects.groupBy(F.col("ID").alias("__id")).agg(first(TYPE, "__type"), first("IdentifiedObject.name", "__name"))
    many = first_values(data, violations.where((kind == "maxCount") & F.col("KEY").isNotNull())).select(F.col("ID").alias("__of"), F.col("KEY").alias("__key"), "n", "firsts")
    rows = violations.join(objects, refers & (F.col("VALUE") == F.col("__id")), "left").join(many, (kind == "maxCount") & (F.col("ID") == F.col("__of")) & (F.col("KEY") == F.col("__key")), "left")
    name = F.coalesce(F.concat(F.lit(' "'), F.nullif("__name", F.lit("")), F.lit('"')), F.lit(""))
    there = F.when(F.col("__type").isNull(), F.concat(F.lit("referenced object "), "VALUE", F.lit(" not found in the data"))).otherwise(F.concat(F.lit("referenced object "), "VALUE", F.lit(" found — "), "__type", name))
    more = F.when(F.col("n") > SHOWN, F.concat(F.lit(", … ("), F.col("n").cast("string"), F.lit(" total)"))).otherwise("")
    values = F.concat(F.lit("found "), F.col("n").cast("string"), F.lit(" values: "), F.array_join(F.transform("firsts", lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", "), more)
    target = F.when(F.col("VALUE").isNotNull() & F.col("KEY").isin(via), F.concat(F.lit("association target found, of type "), "VALUE")).when(refers, there).when(F.col("n").isNotNull(), values)
    return rows.select(*violations.columns, target.alias("TARGET"))


def _requirement(rule: Rule) -> str:
    shown = ", ".join(rule.values) if rule.component in ("in", "range") else str(rule.value)
    return EXPECTED[rule.component].format(shown)


def presented(violations: DataFrame, data: DataFrame, rules: list[Rule], of_schema: bool = False) -> DataFrame:
    """Adds TARGET, EXPECTED and MESSAGE_SOURCE ("shacl": words of a shape, "engine": ours); texts come from the data and the rules.

    of_schema: VIOLATION_TYPE is put in the words of schema languages.  Types and names of objects are the first by load order."""
    violations = written(violations, "violations")  # asked three times; found once
    rows = _targets(violations, data, rules)
    keys = ["SOURCE_SHAPE", "KEY", "VIOLATION_TYPE", *(["PROFILE"] if "PROFILE" in violations.columns else [])]
    told = {}
    for r in rules:
        if r.component in EXPECTED and r.path is not None:
            for kind in (r.component, *(["lexicalForm"] if r.component == "datatype" else [])):
                told[(r.shape, r.path, kind, *([r.profile] if len(keys) > 3 else []))] = _requirement(r)
    table = violations.sparkSession.createDataFrame([(*k, v) for k, v in told.items()], ", ".join(f"{k} string" for k in [*keys, "EXPECTED"]))
    rows = rows.join(F.broadcast(table) if len(told) <= BROADCAST_RULES else table, keys, "left")
    own = violations.sparkSession.createDataFrame([(m,) for m in sorted({r.message for r in rules if r.message})], "MESSAGE string").withColumn("__own", F.lit(True))
    rows = rows.join(F.broadcast(own) if len(rules) <= BROADCAST_RULES else own, "MESSAGE", "left")
    kind = F.col("VIOLATION_TYPE")
    if of_schema:
        kind = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in SCHEMA_KINDS.items() for x in pair)), kind), kind)
    columns = [kind.alias(c) if c == "VIOLATION_TYPE" else F.col(c) for c in violations.columns]
    return rows.select(*columns, "TARGET", "EXPECTED", F.when(F.col("__own"), F.lit("shacl")).otherwise("engine").alias("MESSAGE_SOURCE"))
