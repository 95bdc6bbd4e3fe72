"""Queries over the given tables laid out as instances with headers, and over what violations say."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadweave.functions import bundles
from quadweave.model import TYPE
from quadweave.plans import profiles as pr
from quadweave.plans.catalogue import _query, _with_gaps
from quadweave.plans.models import _id, _laid_out, _table
from quadweave.plans.presented import presented
from quadweave.plans.shapes import Rule, validate
from quadweave.sources import star


def _profiles() -> list[pr.Profile]:
    segment = lambda *values: {"Customer.c_mktsegment": {"in": list(values)}}
    equipment = pr.Profile("EQ", {"Customer": segment("BUILDING", "MACHINERY") | {"Customer.c_name": {"min": 1, "max": 1}}}, "EQ", "http://profiles/EQ/1", "urn:shared")
    return [equipment, pr.Profile("SSH", {"Customer": segment("BUILDING")}, "SSH", "http://profiles/SSH/1", "urn:shared")]


def _instances(spark, sf):
    """Five instances of customers by key, with a header for each region: EQ, EQ and SSH, EQ by an older name, none, SSH; of every third customer the name is in the next instance."""
    n = F.col("r_regionkey")
    cells = {
        TYPE: F.lit("FullModel"),
        "label": F.concat("r_name", F.lit(".xml")),
        "Model.messageType": F.when(n == 0, F.lit("EQ")),
        "keyword": F.when(n == 1, F.lit("EQ")).when(n == 4, F.lit("SSH")),
        "Model.profile": F.when(n == 1, F.lit("http://profiles/SSH/1")).when(n == 2, F.lit("http://older/EquipmentCore/3/1")),
        "conformsTo": F.when(n == 3, F.lit("urn:shared")),
    }
    headers = _laid_out(_table(spark, sf, "region"), _id("Header-", "r_regionkey"), cells, _id("I-", "r_regionkey"))
    key = F.substring_index("ID", "-", -1).cast("bigint")
    moved = F.when((F.col("KEY") == "Customer.c_name") & (key % 3 == 0), key + 1).otherwise(key)
    return headers.unionByName(star.graph(spark, sf, "Customer").withColumn("INSTANCE_ID", F.concat(F.lit("I-"), (moved % 5).cast("string"))))


@_query("SELECT 'I-' || r_regionkey AS INSTANCE_ID, r_name || '.xml' AS FILE_NAME, CASE WHEN r_regionkey IN (0, 1, 2) THEN 'EQ' WHEN r_regionkey = 4 THEN 'SSH' END AS PROFILE FROM region")
def profiles_of_instances(spark, sf):
    return pr.resolved(_instances(spark, sf), _profiles())


@_query("SELECT 'I-' || r_regionkey AS INSTANCE_ID, 'urn:shared' AS HINTS FROM region WHERE r_regionkey = 3")
def instances_without_profile(spark, sf):
    return pr.undeclared(_instances(spark, sf), _profiles()).select("INSTANCE_ID", F.array_join("HINTS", ",").alias("HINTS"))


_OF = "FROM customer JOIN (VALUES (0, 'EQ'), (1, 'EQ'), (1, 'SSH'), (2, 'EQ'), (4, 'SSH')) p(i, PROFILE) ON i = c_custkey % 5"


@_query(f"SELECT 'I-' || i AS INSTANCE_ID, PROFILE, 'Customer-' || c_custkey AS ID, c_mktsegment AS VALUE, 'in' AS VIOLATION_TYPE {_OF} WHERE c_mktsegment <> 'BUILDING' AND (PROFILE = 'SSH' OR c_mktsegment <> 'MACHINERY') UNION ALL SELECT 'I-' || i, PROFILE, 'Customer-' || c_custkey, NULL, 'minCount' {_OF} WHERE PROFILE = 'EQ' AND c_custkey % 3 = 0")
def schema_validation_by_profile(spark, sf):
    return pr.validate_profiles(_instances(spark, sf), _profiles()).select("INSTANCE_ID", "PROFILE", "ID", "VALUE", "VIOLATION_TYPE")


@_query("SELECT 'I-' || c_custkey % 5 AS INSTANCE_ID, 'Customer-' || c_custkey AS ID FROM customer WHERE c_mktsegment <> 'BUILDING'")
def schema_validation_chosen(spark, sf):
    return pr.validate_profiles(_instances(spark, sf), _profiles(), chosen=["http://profiles/SSH/1"]).select("INSTANCE_ID", "ID")


@_query("SELECT 'k' || p_brand AS keyword, arg_min(p_name, (-p_size, p_name)) AS profile, max(p_size) AS size FROM part GROUP BY p_brand")
def profile_largest(spark, sf):
    sizes = _table(spark, sf, "part").select(F.concat(F.lit("k_"), "p_brand").alias("keyword"), F.col("p_name").alias("profile"), F.col("p_size").alias("size"))
    return pr.largest_per_keyword(sizes)


_PRESENTED = """
WITH parts AS (SELECT l_orderkey AS o, count(*) AS n, string_agg(CASE WHEN place <= 5 THEN '''Part-' || l_partkey || '''' END, ', ' ORDER BY place) AS firsts FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS place FROM lineitem) GROUP BY 1 HAVING count(*) > 4)
SELECT 'Order-' || o AS ID, 'xsd:maxOccurs' AS VIOLATION_TYPE, 'found ' || n || ' values: ' || firsts || CASE WHEN n > 5 THEN ', … (' || n || ' total)' ELSE '' END AS TARGET, 'at most 4 value(s)' AS EXPECTED, 'engine' AS MESSAGE_SOURCE FROM parts
UNION ALL SELECT 'Order-' || o_orderkey, 'class', 'referenced object Customer-' || o_custkey || ' not found in the data', 'a reference to a Customer', 'shacl' FROM orders WHERE o_custkey % 7 = 0
UNION ALL SELECT 'Order-' || o_orderkey, 'rdfs:range', 'referenced object Customer-' || o_custkey || ' found — Customer', 'a reference to one of: Nation, Region', 'engine' FROM orders WHERE o_custkey % 7 <> 0
"""


@_query(_PRESENTED)
def violations_presented(spark, sf):
    rules = [Rule("a", "maxCount", "Order", "Order.Part", 4), Rule("b", "class", "Order", "Order.Customer", "Customer", message="no such customer"), Rule("c", "range", "Order", "Order.Customer", values=("Nation", "Region"))]
    data = _with_gaps(spark, sf).unionByName(star.graph(spark, sf, "OrderParts"))
    return presented(validate(data, rules), data, rules, of_schema=True).select("ID", "VIOLATION_TYPE", "TARGET", "EXPECTED", "MESSAGE_SOURCE")


def _profile_documents(spark, sf):
    """Three documents by size of part: each has a class Part with a brand, whose values are the brands of its parts, and a property for each of its types; two share a keyword."""
    part = _table(spark, sf, "part").withColumn("n", F.col("p_size") % 3)
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    kind = F.regexp_replace("p_type", "[^A-Za-z]", "")
    doc, u = F.concat(F.lit("P-"), F.col("n").cast("string")), F.lit("http://x#")
    name = lambda *parts: F.concat(u, *parts)
    fact = lambda ID, key, value, at: F.struct(ID.alias("ID"), F.lit(key).alias("KEY"), value.alias("VALUE"), (F.col("n") * 100 + at).cast("bigint").alias("_ord"))
    once = part.select("n").distinct().select(doc.alias("INSTANCE_ID"), F.inline(F.array(
        fact(name(F.lit("Ontology"), F.col("n").cast("string")), "type", F.lit("http://www.w3.org/2002/07/owl#Ontology"), 0), fact(name(F.lit("Ontology"), F.col("n").cast("string")), "keyword", F.concat(F.lit("K"), (F.col("n") % 2).cast("string")), 1),
        fact(name(F.lit("Part")), "type", F.lit("http://y#Class"), 2), fact(name(F.lit("Part")), "stereotype", F.lit("http://y#concrete"), 3),
        fact(name(F.lit("Part.brand")), "domain", name(F.lit("Part")), 4), fact(name(F.lit("Part.brand")), "range", name(F.lit("Brand")), 5), fact(name(F.lit("Part.brand")), "multiplicity", F.lit("http://y#M:1..1"), 6),
        fact(name(F.lit("Part.unbound")), "type", F.lit("http://y#Property"), 7),
    )))
    brands = part.select("n", brand.alias("b")).distinct().select(doc.alias("INSTANCE_ID"), F.inline(F.array(fact(name(F.lit("Brand."), F.col("b")), "type", name(F.lit("Brand")), 8))))
    typed = part.select("n", kind.alias("k")).distinct().select(doc.alias("INSTANCE_ID"), F.inline(F.array(fact(name(F.lit("Part."), F.col("k")), "domain", name(F.lit("Part")), 9), fact(name(F.lit("Part."), F.col("k")), "dataType", F.lit("http://y#Integer"), 10), fact(name(F.lit("Part."), F.col("k")), "multiplicity", F.lit("http://y#M:0..1"), 11))))
    return once.unionByName(brands).unionByName(typed).select("ID", "KEY", "VALUE", "INSTANCE_ID", "_ord")


@_query("SELECT 'P-' || p_size % 3 AS INSTANCE_ID, 'Part.brand' AS property, 'Brand' AS range, string_agg(DISTINCT 'Brand.' || replace(p_brand, '#', ''), ',' ORDER BY 'Brand.' || replace(p_brand, '#', '')) AS \"values\" FROM part GROUP BY p_size % 3 UNION ALL SELECT DISTINCT 'P-' || p_size % 3, 'Part.unbound', NULL, '' FROM part")
def profile_enumerations(spark, sf):
    return bundles.enumerations(_profile_documents(spark, sf)).select("INSTANCE_ID", "property", "range", F.array_join("values", ",").alias("values"))


_TYPES_OF = "SELECT DISTINCT 'K' || (p_size % 3) % 2 AS keyword, p_size % 3 AS n, 'Part.' || regexp_replace(p_type, '[^A-Za-z]', '', 'g') AS property FROM part"


@_query(f"SELECT keyword, property, 'Attribute' AS kind, string_agg('P-' || n, ',' ORDER BY n) AS sources FROM ({_TYPES_OF}) GROUP BY 1, 2 UNION ALL SELECT keyword, 'Part.brand', 'Enumeration', string_agg(DISTINCT 'P-' || n, ',' ORDER BY 'P-' || n) FROM ({_TYPES_OF}) GROUP BY 1")
def profile_bundle(spark, sf):
    return bundles.bundle(_profile_documents(spark, sf)).select("keyword", "property", "kind", F.array_join("sources", ",").alias("sources"))


@_query("SELECT DISTINCT 'Part' AS name, 'class' AS kind, NULL AS multiplicity FROM part UNION ALL SELECT DISTINCT 'Part.brand', 'property', '1..1' FROM part UNION ALL SELECT DISTINCT 'Part.unbound', 'property', NULL FROM part UNION ALL SELECT DISTINCT 'Part.' || regexp_replace(p_type, '[^A-Za-z]', '', 'g'), 'property', '0..1' FROM part")
def schema_flattened(spark, sf):
    return bundles.flattened(_profile_documents(spark, sf)).select("name", "kind", "multiplicity")


@_query("SELECT DISTINCT 'Part.brand' AS property, 'Enumeration' AS kind, 'http://x#' AS namespace, NULL AS datatype FROM part UNION ALL SELECT DISTINCT 'Part.unbound', 'Enumeration', 'http://x#', NULL FROM part UNION ALL SELECT DISTINCT 'Part.' || regexp_replace(p_type, '[^A-Za-z]', '', 'g'), 'Attribute', 'http://x#', 'http://www.w3.org/2001/XMLSchema#integer' FROM part")
def schema_key_metadata(spark, sf):
    return bundles.key_metadata(_profile_documents(spark, sf))
