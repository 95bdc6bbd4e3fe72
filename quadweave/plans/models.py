"""Queries over the given tables laid out as power-grid models and as profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave.functions import grid, rdfs, terms
from quadweave.model import TYPE
from quadweave.operators import mutate
from quadweave.operators import tableview as t
from quadweave.plans import patterns as p
from quadweave.plans.catalogue import _query
from quadweave.plans.formats import _documents, _folder
from quadweave.sinks import files
from quadweave.sources import cimxml, star


def _laid_out(df: DataFrame, object_id: Column, cells: dict[str, Column], instance: Column) -> DataFrame:
    """Facts of one object for each row."""
    facts = F.array(*(F.struct(F.lit(k).alias("KEY"), v.cast("string").alias("VALUE"), F.lit(i).cast("bigint").alias("_ord")) for i, (k, v) in enumerate(cells.items())))
    return df.select(object_id.alias("ID"), F.inline(facts), instance.alias("INSTANCE_ID")).select("ID", "KEY", "VALUE", "INSTANCE_ID", "_ord")


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _id(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _terminals(spark, sf):
    """Customers as terminals of nations, which are the equipment."""
    cells = {TYPE: F.lit("Terminal"), "Terminal.ConductingEquipment": _id("Nation-", "c_nationkey"), "ACDCTerminal.connected": F.lit("true")}
    return _laid_out(_table(spark, sf, "customer"), _id("T-", "c_custkey"), cells, F.lit("SSH"))


def _limit_model(spark, sf):
    orders, eq = _table(spark, sf, "orders"), F.lit("EQ")
    sets = _laid_out(orders, _id("S-", "o_orderkey"), {TYPE: F.lit("OperationalLimitSet"), "OperationalLimitSet.Terminal": F.when(F.col("o_orderkey") % 3 > 0, _id("T-", "o_custkey")), "OperationalLimitSet.Equipment": F.when(F.col("o_orderkey") % 3 == 0, F.lit("Nation-1"))}, eq)
    own = {TYPE: F.lit("CurrentLimit"), "OperationalLimit.OperationalLimitSet": _id("S-", "o_orderkey"), "OperationalLimit.OperationalLimitType": _id("K-", "o_orderpriority"), "CurrentLimit.value": F.col("o_orderkey") * 10}
    kinds = _laid_out(orders.select("o_orderpriority").distinct(), _id("K-", "o_orderpriority"), {TYPE: F.lit("OperationalLimitType"), "IdentifiedObject.name": F.col("o_orderpriority")}, eq)
    parts = [_laid_out(orders, _id("L-", "o_orderkey"), own, eq), kinds, _terminals(spark, sf), star.graph(spark, sf, "Nation", keys=[TYPE])]
    for part in parts:
        sets = sets.unionByName(part)
    return sets.where(F.col("VALUE").isNotNull())


_LIMITS = "SELECT 'L-' || o_orderkey AS limit_id, 'S-' || o_orderkey AS set_id, o_orderpriority AS type_name, CAST(o_orderkey * 10 AS VARCHAR) AS value, 'CurrentLimit' AS limit_class, {} AS \"ID_Equipment\", 'Nation' AS \"Equipment_Type\" FROM orders {}"
_BY_TERMINAL = _LIMITS.format("'Nation-' || c_nationkey", "JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 > 0")


@_query(_BY_TERMINAL)
def limits_by_terminal(spark, sf):
    return grid.limits(_limit_model(spark, sf)).select("limit_id", "set_id", "type_name", "value", "limit_class", "ID_Equipment", "Equipment_Type")


@_query(_BY_TERMINAL + " UNION ALL " + _LIMITS.format("'Nation-1'", "WHERE o_orderkey % 3 = 0"))
def limits_with_and_without_terminal(spark, sf):
    return grid.limits(_limit_model(spark, sf), keep_without_terminal=True).select("limit_id", "set_id", "type_name", "value", "limit_class", "ID_Equipment", "Equipment_Type")


@_query("SELECT 'T-' || c_custkey AS ID, CASE WHEN c_nationkey IN (3, 5) THEN 'false' ELSE 'true' END AS connected FROM customer")
def switched_terminals(spark, sf):
    switched = grid.switch_terminals(_terminals(spark, sf), ["Nation-3", "Nation-5"])
    return switched.where("KEY = 'ACDCTerminal.connected'").selectExpr("ID", "VALUE AS connected")


def _model_headers(spark, sf):
    """Orders as state models that depend on customers, these on nations, these on regions."""
    header = lambda df, object_id, profile, on, instance: _laid_out(df, object_id, {TYPE: F.lit("FullModel"), "Model.profile": F.lit(profile)} | ({"Model.DependentOn": on} if on is not None else {}), instance)
    o, c, n, r = (_table(spark, sf, name) for name in ("orders", "customer", "nation", "region"))
    rows = header(o, _id("O-", "o_orderkey"), grid.STATE_VARIABLES, _id("C-", "o_custkey"), _id("io-", "o_orderkey"))
    rows = rows.unionByName(header(c, _id("C-", "c_custkey"), "http://p/EQ", _id("N-", "c_nationkey"), _id("ic-", "c_custkey")))
    rows = rows.unionByName(header(n, _id("N-", "n_nationkey"), "http://p/TP", _id("R-", "n_regionkey"), _id("in-", "n_nationkey")))
    return rows.unionByName(header(r, _id("R-", "r_regionkey"), "http://p/BD", None, _id("ir-", "r_regionkey")))


_PARTS = [("'O-' || o_orderkey", f"'{grid.STATE_VARIABLES}'", "'io-' || o_orderkey"), ("'C-' || o_custkey", "'http://p/EQ'", "'ic-' || o_custkey"), ("'N-' || c_nationkey", "'http://p/TP'", "'in-' || c_nationkey"), ("'R-' || n_regionkey", "'http://p/BD'", "'ir-' || n_regionkey")]
_CHAIN = "FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"


@_query(" UNION ALL ".join(f"SELECT 'O-' || o_orderkey AS root, {i} AS ID, {profile} AS PROFILE, {instance} AS INSTANCE_ID {_CHAIN}" for i, profile, instance in _PARTS))
def loaded_models(spark, sf):
    return grid.loaded_models(_model_headers(spark, sf))


@_query("SELECT 'R-' || r_regionkey AS ID, 'FullModel' AS Type, 'http://p/BD' AS \"Model.profile\" FROM region UNION ALL SELECT 'N-' || n_nationkey, 'FullModel', 'http://p/TP' FROM nation")
def model_parts(spark, sf):
    headers = _model_headers(spark, sf).where("INSTANCE_ID LIKE 'ir-%' OR INSTANCE_ID LIKE 'in-%'")
    return grid.model_parts(headers).select("ID", "Type", "`Model.profile`")


@_query("SELECT 'N-' || n_nationkey AS ID, KEY, VALUE FROM nation, (VALUES ('Type', 'FullModel'), ('Model.profile', 'http://p/TP'), ('Model.DependentOn', NULL)) v(KEY, x), LATERAL (SELECT coalesce(x, 'R-' || n_regionkey) AS VALUE) WHERE n_regionkey = 2")
def facts_of_models(spark, sf):
    data = _model_headers(spark, sf)
    wanted = data.where("KEY = 'Model.DependentOn' AND VALUE = 'R-2'")
    return grid.model_facts(data, wanted).select("ID", "KEY", "VALUE")


@_query("SELECT 'E-' || s_suppkey AS \"mRID\", s_name AS \"EIC\" FROM supplier WHERE s_suppkey % 2 = 0")
def eic_codes(spark, sf):
    kind = F.when(F.col("s_suppkey") % 2 == 0, "Substation").otherwise("Line")
    return grid.eic_map(_laid_out(_table(spark, sf, "supplier"), _id("E-", "s_suppkey"), {TYPE: kind, "IdentifiedObject.energyIdentCodeEic": F.col("s_name")}, F.lit("EQ")), "Substation")


def _documents_as_models(spark, sf, header: dict[str, Column] | None = None):
    """Every document an instance: its file name, and a header."""
    docs, instance = _table(spark, sf, "documents"), _id("i-", "doc_id")
    name = F.concat(F.lit("20230101T0000Z_1D_"), F.upper("lang"), F.lit("_EQ_"), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"), F.lit(".xml"))
    labels = _laid_out(docs, _id("d-", "doc_id"), {TYPE: F.lit("Distribution"), "label": name}, instance)
    return labels.unionByName(_laid_out(docs, _id("m-", "doc_id"), {TYPE: F.lit("FullModel")} | (header or {}), instance))


@_query("SELECT 'm-' || doc_id AS ID, '20230101T0000Z' AS \"Model.scenarioTime\", '1D' AS \"Model.processType\", upper(lang) AS \"Model.modelingEntity\", 'EQ' AS \"Model.messageType\", lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') AS \"Model.version\" FROM documents")
def headers_from_filenames(spark, sf):
    keys = list(grid.HEADER)
    return t.wide(grid.header_from_filenames(_documents_as_models(spark, sf)).where(F.col("KEY").isin(keys)), keys)


@_query("SELECT 'd-' || doc_id AS ID, '20240229T1230Z_2D_' || upper(lang) || '_SSH_' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || '.xml' AS label FROM documents")
def filenames_from_headers(spark, sf):
    header = dict(zip(grid.HEADER, (F.lit("2024-02-29T12:30:00Z"), F.lit("2D"), F.upper("lang"), F.lit("SSH"), F.col("doc_id") % 1000), strict=True))
    return grid.filenames_from_header(_documents_as_models(spark, sf, header)).where("KEY = 'label'").selectExpr("ID", "VALUE AS label")


@_query("SELECT 'm-' || doc_id AS ID, KEY, CASE WHEN KEY = 'Model.version' THEN '007' ELSE VALUE END AS VALUE FROM documents, (VALUES ('Type', 'FullModel'), ('Model.version', ''), ('Model.description', 'checked')) v(KEY, VALUE)")
def updated_headers(spark, sf):
    data = _documents_as_models(spark, sf, {"Model.version": F.col("doc_id")})
    return grid.update_header(data, {"Model.version": "007", "Model.description": "checked"}, add=True).where("ID LIKE 'm-%'").select("ID", "KEY", "VALUE")


def _profile(spark, sf):
    """Brands as classes below a root, parts as their properties; half of the brands are concrete."""
    parts, name, eq = _table(spark, sf, "part"), lambda c: F.concat(F.lit("http://s#"), c), F.lit("RDFS")
    brand = F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))
    brands = parts.select(brand.alias("brand")).distinct()
    a_class = {"type": F.lit("http://www.w3.org/2000/01/rdf-schema#Class"), "subClassOf": F.lit("http://s#Root"), "stereotype": F.when(F.substring("brand", -1, 1).isin("1", "3"), F.lit("http://s#concrete")).otherwise(F.lit("http://s#abstract"))}
    rows = _laid_out(brands, name(F.col("brand")), a_class, eq)
    used = F.when(F.col("p_partkey") % 4 == 0, "No").otherwise("Yes")
    most = F.when(F.col("p_size") % 3 == 0, "n").otherwise("1")
    own = {"domain": name(brand), "multiplicity": F.concat(F.lit("http://s#M:"), (F.col("p_size") % 2).cast("string"), F.lit(".."), most), "dataType": F.lit("http://s#String"), "AssociationUsed": used}
    rows = rows.unionByName(_laid_out(parts, name(_id("P", "p_partkey")), own, eq))
    root = spark.createDataFrame([("http://s#Root", "type", "http://www.w3.org/2000/01/rdf-schema#Class"), ("http://s#Root.name", "domain", "http://s#Root"), ("http://s#Root.name", "multiplicity", "http://s#M:1..1"), ("http://s#Root.name", "range", "http://s#Text")], "ID string, KEY string, VALUE string")
    return rows.unionByName(root.withColumn("INSTANCE_ID", eq).withColumn("_ord", F.lit(0).cast("bigint")))


_BRANDS = "SELECT DISTINCT replace(p_brand, '#', '') AS brand FROM part"


@_query(f"SELECT 'http://s#' || brand AS ID, brand[-1] IN ('1', '3') AS concrete FROM ({_BRANDS}) UNION ALL SELECT 'http://s#Root', false")
def profile_classes(spark, sf):
    return rdfs.classes(_profile(spark, sf))


@_query(f"SELECT 'http://s#' || brand AS class, unnest(['http://s#' || brand, 'http://s#Root']) AS ancestor FROM ({_BRANDS}) UNION ALL SELECT 'http://s#Root', 'http://s#Root'")
def profile_ancestors(spark, sf):
    return rdfs.ancestors(_profile(spark, sf))


@_query(f"SELECT replace(p_brand, '#', '') AS class, 'P' || p_partkey AS property, CAST(p_size % 2 AS INTEGER) AS min, CASE WHEN p_size % 3 > 0 THEN 1 ELSE -1 END AS max, 'String' AS datatype, CAST(NULL AS VARCHAR) AS range, p_partkey % 4 > 0 AS used FROM part UNION ALL SELECT brand, 'Root.name', 1, 1, NULL, 'Text', true FROM ({_BRANDS}) UNION ALL SELECT 'Root', 'Root.name', 1, 1, NULL, 'Text', true")
def profile_properties(spark, sf):
    return rdfs.properties(_profile(spark, sf)).withColumn("max", F.coalesce("max", F.lit(-1)))  # -1: no upper bound


@_query("SELECT 'Nation-' || n_nationkey AS ID, n_name AS \"Nation.n_name\" FROM nation")
def cimxml_load_order(spark, sf):
    """Two files with properties of the same objects: the first value is that of the file with the smaller path."""
    path, nations = _folder(spark), star.graph(spark, sf, "Nation")
    files.write_cimxml(nations, f"{path}/a", {"cim": terms.CIM}, references=["Nation.Region"])
    files.write_cimxml(mutate.set_value_at_key(nations, "Nation.n_name", "LATER"), f"{path}/b", {"cim": terms.CIM}, references=["Nation.Region"])
    _documents(spark, path)
    return t.wide(cimxml.read_cimxml(spark, [f"{path}/b", f"{path}/a"]), ["Nation.n_name"]).where("`Nation.n_name` IS NOT NULL")


@_query("SELECT 'Customer-' || c_custkey AS ID, true AS begins FROM customer")
def object_places(spark, sf):
    path = _folder(spark)
    files.write_cimxml(star.graph(spark, sf, "Customer"), path, {"cim": terms.CIM}, references=["Customer.Nation"])
    _documents(spark, path)
    return cimxml.object_lines(spark, path).select("ID", (F.contains("SOURCE_SNIPPET", F.lit("<cim:Customer")) & (F.col("SOURCE_LINE") > 1)).alias("begins"))


@_query("SELECT 'Nation-' || n_nationkey AS n FROM nation")
def pattern_exists_without_shared(spark, sf):
    """Without a shared variable any row decides: all nations stay, and none is taken away."""
    g = star.graph(spark, sf, "Nation", "Region")
    nations = p.pattern(g, "?n", TYPE, "Nation")
    return p.not_exists(p.exists(nations, p.pattern(g, "?r", TYPE, "Region")), p.pattern(g, "?x", TYPE, "Nothing"))
