"""RDFS profiles of many documents, merged to bundles: one declared schema for each keyword, with the documents that it comes from.

Everything is keyed by INSTANCE_ID, the document, so that all documents are converted in the same few joins.  Where documents of a keyword
say different things of a property, the first document by load order counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.functions.rdfs import local, multiplicity
from quadweave.model import ORDER
from quadweave.operators.reach import reach
from quadweave.plans.profiles import Profile

_DOC = "INSTANCE_ID"
# What the header of an older profile calls the things that newer ones say of themselves.
OLDER_METADATA = {"title": "shortName", "keyword": "shortName", "modified": "date"}


def metadata(data: DataFrame) -> DataFrame:
    """(INSTANCE_ID, KEY, VALUE): what documents say of themselves as ontologies; older ones by short names and dates, in the newer words.

    In older documents these are `isFixed` values of properties of a class that is called like the profile's version."""
    types = data.where(F.lower("KEY") == "type")
    own = types.where(local(F.col("VALUE")) == "Ontology").select(_DOC, "ID").distinct()
    newer = data.where(F.lower("KEY") != "type").join(own, [_DOC, "ID"], "left_semi").select(_DOC, "KEY", "VALUE", ORDER)
    fixed = data.where(F.col("KEY") == "isFixed").join(own.select(_DOC).distinct(), _DOC, "left_anti")
    older = fixed.select(_DOC, F.element_at(F.split(local(F.col("ID")), r"\."), -1).alias("name"), "VALUE", ORDER)
    words = F.array(*(F.struct(F.lit(new).alias("KEY"), F.lit(old).alias("old")) for new, old in OLDER_METADATA.items()))
    told = older.select(_DOC, "name", "VALUE", ORDER, F.explode(words).alias("w")).where("name = w.old").select(_DOC, F.col("w.KEY").alias("KEY"), "VALUE", ORDER)
    version = older.where("name = 'entsoeUML'").select(_DOC, F.lit("versionInfo").alias("KEY"), F.substring_index("VALUE", "v", -1).alias("VALUE"), ORDER)
    rows = newer.unionByName(told).unionByName(version).unionByName(older.select(_DOC, F.col("name").alias("KEY"), "VALUE", ORDER))
    return rows.groupBy(_DOC, "KEY").agg(F.min_by("VALUE", ORDER).alias("VALUE"))


def _first(data: DataFrame, key: str, name: str) -> DataFrame:
    return data.where(F.col("KEY") == key).groupBy(_DOC, "ID").agg(F.min_by("VALUE", ORDER).alias(name))


def classes(data: DataFrame) -> DataFrame:
    """(INSTANCE_ID, ID, external) of the classes whose objects may be written: concrete ones, and those that another profile defines."""
    kinds = data.where((F.lower("KEY") == "type") & (local(F.col("VALUE")) == "Class")).select(_DOC, "ID").distinct()
    said = data.where(F.col("KEY") == "stereotype").groupBy(_DOC, "ID").agg(F.max(local(F.col("VALUE")) == "concrete").alias("concrete"), F.max(local(F.col("VALUE")) == "Description").alias("external"))
    return kinds.join(said, [_DOC, "ID"]).where("concrete or external").select(_DOC, "ID", "external")


def _lineage(data: DataFrame) -> DataFrame:
    """(INSTANCE_ID, class, ancestor), each class its own first; walks stay in their document."""
    name = lambda c: F.to_json(F.struct(F.col(_DOC).alias("d"), F.col(c).alias("i")))
    parents = data.where((F.col("KEY") == "subClassOf") & F.col("VALUE").isNotNull())
    found = reach(parents.select(name("ID").alias("s"), name("VALUE").alias("o")), classes(data).select(name("ID").alias("s")), zero=True)
    part = lambda c, f: F.get_json_object(c, f"$.{f}")
    return found.select(part("s", "d").alias(_DOC), part("s", "i").alias("class"), part("o", "i").alias("ancestor"))


def definitions(data: DataFrame) -> DataFrame:
    """(INSTANCE_ID, ID, kind, min, max, datatype, range, values) of every property that is used, bound to a class or not.

    kind is Association, Attribute or Enumeration; values of an enumeration are the objects of its range, by name."""
    bound = data.where(F.col("KEY").isin("domain", "domainIncludes")).select(_DOC, "ID")
    named = data.where((F.lower("KEY") == "type") & (local(F.col("VALUE")) == "Property")).select(_DOC, "ID")
    rows = bound.union(named).distinct()
    for key, name in (("AssociationUsed", "used"), ("dataType", "datatype"), ("range", "range"), ("multiplicity", "m")):
        rows = rows.join(_first(data, key, name), [_DOC, "ID"], "left")
    kind = F.when(F.col("used").isNotNull(), "Association").when(F.col("datatype").isNotNull(), "Attribute").otherwise("Enumeration")
    rows = rows.where("coalesce(used, '') <> 'No'").withColumn("kind", kind)
    members = data.where(F.lower("KEY") == "type").select(_DOC, F.col("VALUE").alias("range"), local(F.col("ID")).alias("value")).distinct()
    wanted = rows.where("kind = 'Enumeration' and range is not null").select(_DOC, "range").distinct()
    values = members.join(wanted, [_DOC, "range"], "left_semi").groupBy(_DOC, "range").agg(F.array_sort(F.collect_list("value")).alias("values"))
    found = rows.join(values, [_DOC, "range"], "left")
    values = F.when(F.col("kind") == "Enumeration", F.coalesce("values", F.array().cast("array<string>")))
    return found.select(_DOC, "ID", "kind", multiplicity(F.col("m"))["min"].alias("min"), multiplicity(F.col("m"))["max"].alias("max"), local(F.col("datatype")).alias("datatype"), "range", values.alias("values"))


def enumerations(data: DataFrame) -> DataFrame:
    """(INSTANCE_ID, property, range, values) of the properties whose values are a closed set."""
    found = definitions(data).where("kind = 'Enumeration'")
    return found.select(_DOC, local(F.col("ID")).alias("property"), local(F.col("range")).alias("range"), "values")


def orphans(data: DataFrame) -> DataFrame:
    """(INSTANCE_ID, property) of properties that no class has."""
    bound = data.where(F.col("KEY").isin("domain", "domainIncludes")).select(_DOC, "ID").distinct()
    return definitions(data).join(bound, [_DOC, "ID"], "left_anti").select(_DOC, local(F.col("ID")).alias("property"))


def sections(data: DataFrame) -> DataFrame:
    """(INSTANCE_ID, class, external, property, kind, min, max, datatype, range, values) of all classes, inherited properties included.

    `range` lists the concrete classes that an association may lead to."""
    lineage = _lineage(data)
    domains = data.where(F.col("KEY").isin("domain", "domainIncludes")).select(_DOC, "ID", F.col("VALUE").alias("ancestor")).distinct()
    rows = lineage.join(domains, [_DOC, "ancestor"]).join(definitions(data), [_DOC, "ID"]).join(classes(data).select(_DOC, F.col("ID").alias("class"), "external"), [_DOC, "class"])
    below = lineage.groupBy(_DOC, F.col("ancestor").alias("range")).agg(F.array_sort(F.collect_set(local(F.col("class")))).alias("below"))
    rows = rows.join(below, [_DOC, "range"], "left")
    range_ = F.when(F.col("kind") == "Association", F.coalesce("below", F.array().cast("array<string>")))
    return rows.select(_DOC, local(F.col("class")).alias("class"), "external", local(F.col("ID")).alias("property"), "kind", "min", "max", "datatype", range_.alias("range"), "values").distinct()


def bundle(data: DataFrame, header: DataFrame | None = None) -> DataFrame:
    """(keyword, class, property, kind, min, max, datatype, range, values, sources): the sections of all documents of a keyword as one.

    Of a property that several documents define, the first by load order counts, and sources lists them all, in that order.  What the header
    profile defines belongs to every keyword that does not define it itself.  Documents without a keyword are left out."""
    keywords = metadata(data).where("KEY = 'keyword'").select(_DOC, F.col("VALUE").alias("keyword"))
    places = data.groupBy(_DOC).agg(F.min(ORDER).alias("place"))
    rows = sections(data).join(keywords, _DOC).join(places, _DOC).withColumn("rank", F.lit(0))
    if header is not None:
        extra = sections(header).withColumn("place", F.lit(0).cast("bigint")).withColumn("rank", F.lit(1))
        own = keywords.select("keyword").distinct()
        # Every keyword gets every definition of the header: a handful of keywords, gathered beside each.
        listed = own.agg(F.array_sort(F.collect_set("keyword")).alias("all"))
        rows = rows.unionByName(extra.join(F.broadcast(listed), F.lit(True)).select("*", F.explode("all").alias("keyword")).drop("all"))
    parts = ("kind", "min", "max", "datatype", "range", "values")
    merged = rows.groupBy("keyword", "class", "property").agg(F.min_by(F.struct(*parts), F.struct("rank", "place", _DOC)).alias("first"), F.array_sort(F.collect_set(F.struct("rank", "place", _DOC))).alias("sources"))
    least = F.col("sources")[0]["rank"]
    return merged.select("keyword", "class", "property", *(F.col(f"first.{p}").alias(p) for p in parts), F.transform(F.filter("sources", lambda s: s["rank"] == least), lambda s: s[_DOC]).alias("sources"))


def profiles(merged: DataFrame, data: DataFrame) -> list[Profile]:
    """Profiles to validate by, of a bundle and the documents that it comes from; a bundle fits the driver.

    Enumerations are closed sets of values, associations lead to the listed classes."""
    said: dict[str, dict[str, str]] = {}
    of = metadata(data).join(data.groupBy(_DOC).agg(F.min(ORDER).alias("place")), _DOC)
    rows = of.where(F.col("KEY").isin("keyword", "versionIRI", "conformsTo")).orderBy("place", _DOC).collect()  # three rows a document
    keywords = {r[_DOC]: r["VALUE"] for r in rows if r["KEY"] == "keyword"}
    for r in rows:
        if r[_DOC] in keywords:
            said.setdefault(keywords[r[_DOC]], {}).setdefault(r["KEY"], r["VALUE"])
    found: dict[str, dict[str, dict]] = {}
    for r in merged.collect():
        entry: dict = {"min": r["min"], "max": r["max"]}
        if r["kind"] == "Association":
            entry |= {"range": r["range"]} if r["range"] else {}
        elif r["kind"] == "Enumeration":
            entry |= {"in": r["values"]} if r["values"] else {}
        elif r["datatype"]:
            entry["datatype"] = r["datatype"].lower()
        found.setdefault(r["keyword"], {}).setdefault(r["class"], {})[r["property"]] = entry
    return [Profile(k, c, k, said.get(k, {}).get("versionIRI"), said.get(k, {}).get("conformsTo")) for k, c in sorted(found.items())]


# XSD types of the primitive types of profiles; texts need no mark.
XSD = "http://www.w3.org/2001/XMLSchema#"
XSD_TYPES = {"Integer": "integer", "Float": "float", "Boolean": "boolean", "String": "string", "Date": "date", "DateTime": "dateTime", "Decimal": "decimal", "MonthDay": "gMonthDay"}


def flattened(data: DataFrame) -> DataFrame:
    """(name, kind, description, multiplicity) of classes and properties over all documents, for people; the first by load order counts."""
    typed = data.where(F.lower("KEY") == "type")
    classes_ = typed.where(local(F.col("VALUE")) == "Class").select("ID", F.lit("class").alias("kind"))
    bound = data.where(F.col("KEY").isin("domain", "domainIncludes")).select("ID").union(typed.where(local(F.col("VALUE")) == "Property").select("ID"))
    names = classes_.unionByName(bound.select("ID", F.lit("property").alias("kind"))).select(local(F.col("ID")).alias("name"), "kind").distinct()
    first = lambda key: F.min_by("VALUE", F.when(F.col("KEY") == key, F.col(ORDER)))
    said = data.where(F.col("KEY").isin("comment", "multiplicity")).groupBy(local(F.col("ID")).alias("name")).agg(first("comment").alias("description"), F.substring_index(first("multiplicity"), "M:", -1).alias("multiplicity"))
    return names.join(said, "name", "left").select("name", "kind", "description", F.when(F.col("kind") == "property", F.col("multiplicity")).alias("multiplicity"))


def key_metadata(data: DataFrame) -> DataFrame:
    """(property, kind, namespace, datatype) of the properties of all documents, the first by load order; texts have the datatype "", links none."""
    places = data.groupBy(_DOC).agg(F.min(ORDER).alias("place"))
    rows = definitions(data).join(places, _DOC)
    types = F.create_map(*(F.lit(x) for name, xsd in XSD_TYPES.items() for x in (name, "" if xsd == "string" else f"{XSD}{xsd}")))
    datatype = F.when(F.col("kind") == "Attribute", F.try_element_at(types, F.col("datatype")))
    space = F.regexp_extract("ID", r"^(.*[#/])[^#/]*\z", 1)
    facts = F.struct("kind", F.nullif(space, F.lit("")).alias("namespace"), datatype.alias("datatype"))
    return rows.groupBy(local(F.col("ID")).alias("property")).agg(F.min_by(facts, F.struct("place", _DOC)).alias("f")).select("property", "f.*")


def writer_arguments(data: DataFrame) -> dict:
    """What `terms.quads` takes of profiles: namespaces, enumerations and datatypes by property; profiles fit the driver."""
    rows = key_metadata(data).collect()
    return {
        "namespaces": {r["property"]: r["namespace"] for r in rows if r["namespace"]},
        "enumerations": tuple(sorted(r["property"] for r in rows if r["kind"] == "Enumeration")),
        "datatypes": {r["property"]: r["datatype"] or None for r in rows if r["datatype"] is not None},
    }
