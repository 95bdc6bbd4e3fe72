"""RDFS profiles, read as a graph with full names, as a declared schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadweave.operators.references import dependency_closure


def local(c: Column) -> Column:
    return F.substring_index(F.substring_index(c, "#", -1), "/", -1)


def _of(data: DataFrame, key: str, name: str) -> DataFrame:
    return data.where(F.col("KEY") == key).select("ID", F.col("VALUE").alias(name)).distinct()


def multiplicity(c: Column) -> Column:
    """Least and most of a name that ends in M:0..n; no upper bound is null."""
    text = F.substring_index(c, "M:", -1)
    low, high = F.substring_index(text, "..", 1), F.substring_index(text, "..", -1)
    return F.struct(F.coalesce(low.try_cast("int"), F.lit(0)).alias("min"), high.try_cast("int").alias("max"))


def classes(data: DataFrame) -> DataFrame:
    """(ID, concrete) of every class; concrete ones carry the stereotype of that name."""
    kinds = data.where((F.lower("KEY") == "type") & (local(F.col("VALUE")) == "Class")).select("ID").distinct()
    stereotypes = data.where(F.col("KEY") == "stereotype").groupBy("ID").agg(F.max(local(F.col("VALUE")) == "concrete").alias("concrete"))
    return kinds.join(stereotypes, "ID", "left").select("ID", F.coalesce("concrete", F.lit(False)).alias("concrete"))


def ancestors(data: DataFrame) -> DataFrame:
    """(class, ancestor), each class being its own first."""
    parents = data.where(F.col("KEY") == "subClassOf").select("ID", "VALUE")
    return dependency_closure(parents, classes(data).select("ID")).select(F.col("root").alias("class"), F.col("ID").alias("ancestor"))


def properties(data: DataFrame) -> DataFrame:
    """(class, property, min, max, datatype, range, used) for all classes, inherited properties included."""
    domains = data.where(F.col("KEY").isin("domain", "domainIncludes")).select("ID", F.col("VALUE").alias("ancestor")).distinct()
    limits = _of(data, "multiplicity", "m").select("ID", multiplicity(F.col("m")).alias("m"))
    used = _of(data, "AssociationUsed", "used")
    rows = domains.join(ancestors(data), "ancestor").join(limits, "ID", "left").join(_of(data, "dataType", "datatype"), "ID", "left").join(_of(data, "range", "range"), "ID", "left").join(used, "ID", "left")
    return rows.select(local(F.col("class")).alias("class"), local(F.col("ID")).alias("property"), "m.min", "m.max", local(F.col("datatype")).alias("datatype"), local(F.col("range")).alias("range"), F.coalesce(F.col("used") != "No", F.lit(True)).alias("used"))


def descriptions(data: DataFrame) -> DataFrame:
    """(name, description, multiplicity) of classes and properties by local name; the first by load order counts."""
    first = lambda key, value: F.min_by(value, F.when(F.col("KEY") == key, F.col("_ord")))
    rows = data.where(F.col("KEY").isin("comment", "multiplicity"))
    text = F.substring_index("VALUE", "M:", -1)
    return rows.groupBy(local(F.col("ID")).alias("name")).agg(first("comment", F.col("VALUE")).alias("description"), first("multiplicity", text).alias("multiplicity"))


def schema(data: DataFrame) -> dict[str, dict[str, dict]]:
    """The declared schema of concrete classes: what rules_of_schema takes.  A profile fits the driver."""
    concrete = {r[0] for r in classes(data).where("concrete").select(local(F.col("ID"))).collect()}
    below: dict[str, set[str]] = {}
    for r in ancestors(data).select(local(F.col("class")), local(F.col("ancestor"))).collect():
        if r[0] in concrete:
            below.setdefault(r[1], set()).add(r[0])
    kinds = data.where((F.lower("KEY") == "type") & ~local(F.col("VALUE")).isin("Class", "Property")).select(local(F.col("VALUE")).alias("kind"), local(F.col("ID")).alias("name"))
    members = {r["kind"]: sorted(r["names"]) for r in kinds.groupBy("kind").agg(F.collect_set("name").alias("names")).collect()}
    found: dict[str, dict[str, dict]] = {c: {} for c in concrete}
    for r in properties(data).where("used").collect():
        if r["class"] in found:
            entry = {"min": r["min"], "max": r["max"]}
            if r["range"] in below:  # an abstract range stands for its concrete subclasses
                entry["range"] = sorted(below[r["range"]])
            elif r["datatype"]:
                entry["datatype"] = r["datatype"].lower()
            elif r["range"] in members:  # an enumeration is a closed set of values
                entry["in"] = members[r["range"]]
            found[r["class"]][r["property"]] = entry
    return found
