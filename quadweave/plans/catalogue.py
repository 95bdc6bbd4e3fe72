"""Queries over the given tables, one for each operator, and the same in SQL over the base tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave.functions import counts, grid
from quadweave.model import TYPE
from quadweave.operators import diff as d
from quadweave.operators import filters as f
from quadweave.operators import mutate as m
from quadweave.operators import references as r
from quadweave.operators import tableview as t
from quadweave.plans import patterns as p
from quadweave.sources import star

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(function):
        _QUERIES[function.__name__] = function
        if sql is not None:
            _SQL[function.__name__] = sql
        return function

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quadweave.plans import documents, formats, models, profiling, rules  # noqa: F401  their queries join these

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


# The graph in SQL: facts of a class, as the adapter lays them out.
_CUSTOMER = "SELECT 'Customer-' || c_custkey AS ID, unnest([{'KEY': 'Type', 'VALUE': 'Customer'}, {'KEY': 'Customer.c_name', 'VALUE': c_name}, {'KEY': 'Customer.c_acctbal', 'VALUE': CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR)}, {'KEY': 'Customer.c_mktsegment', 'VALUE': c_mktsegment}, {'KEY': 'Customer.Nation', 'VALUE': 'Nation-' || c_nationkey}], recursive := true) FROM customer"
_NATION = "SELECT 'Nation-' || n_nationkey AS ID, unnest([{'KEY': 'Type', 'VALUE': 'Nation'}, {'KEY': 'Nation.n_name', 'VALUE': n_name}, {'KEY': 'Nation.Region', 'VALUE': 'Region-' || n_regionkey}], recursive := true) FROM nation"
_REGION = "SELECT 'Region-' || r_regionkey AS ID, unnest([{'KEY': 'Type', 'VALUE': 'Region'}, {'KEY': 'Region.r_name', 'VALUE': r_name}], recursive := true) FROM region"
_SUPPLIER = "SELECT 'Supplier-' || s_suppkey AS ID, unnest([{'KEY': 'Type', 'VALUE': 'Supplier'}, {'KEY': 'Supplier.s_name', 'VALUE': s_name}, {'KEY': 'Supplier.s_acctbal', 'VALUE': CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS VARCHAR)}, {'KEY': 'Supplier.Nation', 'VALUE': 'Nation-' || s_nationkey}], recursive := true) FROM supplier"
_ORDER = "SELECT 'Order-' || o_orderkey AS ID, unnest([{'KEY': 'Type', 'VALUE': 'Order'}, {'KEY': 'Order.o_orderstatus', 'VALUE': o_orderstatus}, {'KEY': 'Order.o_totalprice', 'VALUE': CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)}, {'KEY': 'Order.o_orderpriority', 'VALUE': o_orderpriority}, {'KEY': 'Order.Customer', 'VALUE': 'Customer-' || o_custkey}], recursive := true) FROM orders"
_MONEY = "CAST(CAST({} AS DECIMAL(18,2)) AS VARCHAR)"
_NO_ORDER = ("ID", "KEY", "VALUE")


@_query("SELECT 'Region' AS type, count(*) AS count FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Event', count(*) FROM events UNION ALL SELECT 'Document', count(*) FROM documents")
def types_count(spark, sf):
    return counts.types_count(star.graph(spark, sf, *star.CLASSES, keys=[TYPE]))


@_query("SELECT 'Region' AS type, count(*) AS count FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer")
def types_count_contains(spark, sf):
    return counts.types_count(star.graph(spark, sf, "Region", "Nation", "Customer", "Supplier", "Part", keys=[TYPE]), contains="O").where("type <> 'Part'")


@_query(f"SELECT 'Customer-' || c_custkey AS ID, 'Customer' AS Type, c_name AS \"Customer.c_name\", {_MONEY.format('c_acctbal')} AS \"Customer.c_acctbal\", c_mktsegment AS \"Customer.c_mktsegment\", 'Nation-' || c_nationkey AS \"Customer.Nation\" FROM customer")
def tableview_by_type(spark, sf):
    return t.type_tableview(star.graph(spark, sf, "Nation", "Customer"), "Customer")


@_query("SELECT 'Customer-' || c_custkey AS ID, 'Customer' AS Type, c_name AS \"Customer.c_name\", CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS \"Customer.c_acctbal\", c_mktsegment AS \"Customer.c_mktsegment\", 'Nation-' || c_nationkey AS \"Customer.Nation\" FROM customer")
def tableview_numeric(spark, sf):
    return t.type_tableview(star.graph(spark, sf, "Customer"), "Customer", string_to_number=True)


@_query(f"SELECT 'Order-' || o_orderkey AS ID, 'Order' AS Type, o_orderstatus AS \"Order.o_orderstatus\", {_MONEY.format('o_totalprice')} AS \"Order.o_totalprice\", o_orderpriority AS \"Order.o_orderpriority\", 'Customer-' || o_custkey AS \"Order.Customer\" FROM orders")
def tableview_by_key(spark, sf):
    return t.key_tableview(star.graph(spark, sf, "Customer", "Order"), "Order.o_totalprice")


@_query(f"SELECT 'Customer-' || c_custkey AS ID, c_name AS \"Customer.c_name\", 'Nation-' || c_nationkey AS \"Customer.Nation\" FROM customer WHERE c_custkey IN (1, 5, 9)")
def tableview_by_id(spark, sf):
    return t.id_tableview(star.graph(spark, sf, "Customer"), ["Customer-1", "Customer-5", "Customer-9"], keys=["Customer.c_name", "Customer.Nation"])


@_query("SELECT 'Order-' || l_orderkey AS ID, CASE WHEN count(*) > 1 THEN '[''' || string_agg('Part-' || l_partkey, ''', ''' ORDER BY l_linenumber, l_partkey) || ''']' ELSE min('Part-' || l_partkey) END AS \"Order.Part\" FROM lineitem GROUP BY l_orderkey")
def tableview_multivalue(spark, sf):
    return t.rendered(t.wide(star.graph(spark, sf, "OrderParts"), ["Order.Part"], multivalue=True))


@_query("SELECT 'Order-' || l_orderkey AS ID, 'Part-' || arg_min(l_partkey, l_linenumber::BIGINT * 10000000 + l_partkey) AS \"Order.Part\" FROM lineitem GROUP BY l_orderkey")
def tableview_first_value(spark, sf):
    return t.wide(star.graph(spark, sf, "OrderParts"), ["Order.Part"])


@_query(f"SELECT ID, KEY, VALUE FROM ({_CUSTOMER})")
def unpivot_roundtrip(spark, sf):
    return t.facts_of_view(t.type_tableview(star.graph(spark, sf, "Customer"), "Customer")).select(*_NO_ORDER)


@_query("SELECT 'Order-' || l_orderkey AS ID, 'Order.Part' AS KEY, 'Part-' || l_partkey AS VALUE FROM lineitem")
def unpivot_multivalue(spark, sf):
    return t.facts_of_view(t.wide(star.graph(spark, sf, "OrderParts"), ["Order.Part"], multivalue=True)).select(*_NO_ORDER)


@_query(f"SELECT ID, KEY, VALUE FROM ({_NATION}) UNION ALL SELECT ID, KEY, VALUE FROM ({_REGION})")
def tableviews_all_classes(spark, sf):
    return t.facts_of_views(t.tableviews(star.graph(spark, sf, "Nation", "Region"))).select(*_NO_ORDER)


@_query("SELECT 'Nation-' || n_nationkey AS ID, 'Nation.n_name' AS KEY, n_name AS VALUE, 'EQ' AS INSTANCE_ID FROM nation WHERE n_name = 'NATION_7'")
def filter_exact(spark, sf):
    return f.filter_facts(star.graph(spark, sf, "Nation"), KEY="Nation.n_name", VALUE="NATION_7").drop("_ord")


@_query("SELECT 'Customer-' || c_custkey AS ID, 'Customer.c_mktsegment' AS KEY, c_mktsegment AS VALUE, 'EQ' AS INSTANCE_ID FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def filter_list(spark, sf):
    return f.filter_facts(star.graph(spark, sf, "Customer"), KEY=["Customer.c_mktsegment"], VALUE=["BUILDING", "MACHINERY"]).drop("_ord")


@_query("SELECT 'Part-' || p_partkey AS ID, 'Part.p_name' AS KEY, p_name AS VALUE, 'EQ' AS INSTANCE_ID FROM part WHERE regexp_matches(p_name, 'r[ei]')")
def filter_regex(spark, sf):
    return f.filter_facts(star.graph(spark, sf, "Part"), KEY=r"p_name\z", VALUE="r[ei]", regex=True).drop("_ord")


@_query("SELECT 'Part-' || p_partkey AS ID, 'Part.p_brand' AS KEY, p_brand AS VALUE, 'EQ' AS INSTANCE_ID FROM part WHERE regexp_matches(p_brand, '(?:#1$)|(?:#2\\d)')")
def filter_regex_list(spark, sf):
    return f.filter_facts(star.graph(spark, sf, "Part"), KEY="brand", VALUE=[r"#1\z", r"#2\d"], regex=True).drop("_ord")


@_query(f"SELECT ID, KEY, VALUE FROM ({_CUSTOMER})")
def filter_by_type(spark, sf):
    return f.filter_by_type(star.graph(spark, sf, "Nation", "Customer"), "Customer").select(*_NO_ORDER)


@_query(f"SELECT ID, KEY, VALUE FROM ({_CUSTOMER}) WHERE ID IN (SELECT 'Customer-' || o_custkey FROM orders)")
def filter_by_ids(spark, sf):
    orders = star.graph(spark, sf, "Order").where("KEY = 'Order.Customer'").selectExpr("VALUE AS ID")
    return f.filter_by_facts(star.graph(spark, sf, "Customer"), orders).select(*_NO_ORDER)


@_query("SELECT 'Customer-' || c_custkey AS ID, unnest(['Customer.Nation', 'Type']) AS KEY, unnest(['Nation-7', 'Customer']) AS VALUE FROM customer WHERE c_nationkey = 7")
def filter_by_value(spark, sf):
    return f.filter_by_value(star.graph(spark, sf, "Customer"), "Nation-7").select(*_NO_ORDER)


@_query(f"SELECT ID, KEY, VALUE FROM ({_CUSTOMER}) WHERE ID IN (SELECT 'Customer-' || c_custkey FROM customer WHERE c_nationkey = 7)")
def filter_by_value_detailed(spark, sf):
    return f.filter_by_value(star.graph(spark, sf, "Customer"), "Nation-7", detailed=True).select(*_NO_ORDER)


@_query(f"SELECT KEY, VALUE FROM ({_CUSTOMER}) WHERE ID = 'Customer-11'")
def object_data(spark, sf):
    return f.object_data(star.graph(spark, sf, "Customer"), "Customer-11")


@_query("SELECT count(*) AS facts FROM nation, unnest([1, 2, 3])")
def scope_filter(spark, sf):
    return f.in_scope(star.graph(spark, sf, "Nation", "Order"), ["EQ"]).agg(F.count("*").alias("facts"))


@_query("SELECT 'Order-' || o_orderkey AS ID_FROM, 'Order.Customer' AS KEY, 'Customer-' || o_custkey AS ID_TO FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT 'Customer-' || c_custkey, 'Customer.Nation', 'Nation-' || c_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey")
def references_all(spark, sf):
    return r.references_all(star.graph(spark, sf, "Order", "Customer", "Nation"))


@_query(f"SELECT ID, KEY, VALUE, 0 AS level, CAST(NULL AS VARCHAR) AS ID_TO FROM ({_REGION}) WHERE ID = 'Region-1' UNION ALL SELECT ID, KEY, VALUE, 1, 'Region-1' FROM ({_NATION}) WHERE ID IN (SELECT 'Nation-' || n_nationkey FROM nation WHERE n_regionkey = 1)")
def references_to_1(spark, sf):
    return r.references_to(star.graph(spark, sf, "Region", "Nation"), "Region-1", 1).select(*_NO_ORDER, "level", "ID_TO")


@_query(f"WITH n AS (SELECT 'Nation-' || n_nationkey AS id FROM nation WHERE n_regionkey = 1) SELECT ID, level FROM (SELECT ID, 0 AS level FROM ({_REGION}) WHERE ID = 'Region-1' UNION ALL SELECT ID, 1 FROM ({_NATION}) WHERE ID IN (FROM n) UNION ALL SELECT ID, 2 FROM ({_CUSTOMER}) WHERE ID IN (SELECT 'Customer-' || c_custkey FROM customer WHERE 'Nation-' || c_nationkey IN (FROM n)) UNION ALL SELECT ID, 2 FROM ({_SUPPLIER}) WHERE ID IN (SELECT 'Supplier-' || s_suppkey FROM supplier WHERE 'Nation-' || s_nationkey IN (FROM n)))")
def references_to_2(spark, sf):
    return r.references_to(star.graph(spark, sf, "Region", "Nation", "Customer", "Supplier"), "Region-1", 2).select("ID", "level")


@_query(f"SELECT ID, KEY, VALUE, level FROM (SELECT *, 0 AS level FROM ({_ORDER}) WHERE ID = 'Order-5' UNION ALL SELECT *, 1 FROM ({_CUSTOMER}) WHERE ID = (SELECT 'Customer-' || o_custkey FROM orders WHERE o_orderkey = 5) UNION ALL SELECT *, 2 FROM ({_NATION}) WHERE ID = (SELECT 'Nation-' || c_nationkey FROM customer, orders WHERE c_custkey = o_custkey AND o_orderkey = 5))")
def references_from_2(spark, sf):
    return r.references_from(star.graph(spark, sf, "Order", "Customer", "Nation"), "Order-5", 2).select(*_NO_ORDER, "level")


@_query(f"SELECT ID, KEY, VALUE, level FROM (SELECT *, 0 AS level FROM ({_NATION}) WHERE ID = 'Nation-3' UNION ALL SELECT *, 1 FROM ({_REGION}) WHERE ID = (SELECT 'Region-' || n_regionkey FROM nation WHERE n_nationkey = 3) UNION ALL SELECT *, 1 FROM ({_CUSTOMER}) WHERE ID IN (SELECT 'Customer-' || c_custkey FROM customer WHERE c_nationkey = 3))")
def references_both(spark, sf):
    return r.references(star.graph(spark, sf, "Region", "Nation", "Customer"), "Nation-3", 1).select(*_NO_ORDER, "level")


@_query("SELECT 'Customer-' || c_custkey AS ID_FROM, 'Customer' AS Type, c_name AS \"Customer.c_name\" FROM customer WHERE c_nationkey = 3")
def references_to_simple(spark, sf):
    return r.references_to_simple(star.graph(spark, sf, "Nation", "Customer"), "Nation-3", [TYPE, "Customer.c_name"])


@_query("SELECT 'Customer-' || o_custkey AS ID_TO, 'Customer' AS Type FROM orders WHERE o_orderkey = 5")
def references_from_simple(spark, sf):
    return r.references_from_simple(star.graph(spark, sf, "Order", "Customer"), "Order-5")


@_query("SELECT 'Nation-3' AS ID, 'Nation' AS Type, 0 AS level, CAST(NULL AS VARCHAR) AS ID_FROM, CAST(NULL AS VARCHAR) AS ID_TO UNION ALL SELECT 'Region-' || n_regionkey, 'Region', 1, 'Nation-3', 'Region-' || n_regionkey FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'Customer-' || c_custkey, 'Customer', 1, 'Customer-' || c_custkey, 'Nation-3' FROM customer WHERE c_nationkey = 3")
def references_simple(spark, sf):
    return r.references_simple(star.graph(spark, sf, "Region", "Nation", "Customer"), "Nation-3", [TYPE])


def _with_gaps(spark, sf):
    """Orders whose customer is missing where its key is a multiple of 7."""
    customers = star.objects(spark.read.parquet(f"{sf}/customer.parquet").where("c_custkey % 7 <> 0"), star.CLASSES["Customer"])
    return star.graph(spark, sf, "Nation", "Order").unionByName(customers)


@_query("SELECT 'Order.Customer' AS KEY_FROM, count(*) AS count FROM orders WHERE o_custkey % 7 = 0 UNION ALL SELECT 'Nation.Region', count(*) FROM nation")
def dangling_counts(spark, sf):
    return r.dangling_references(_with_gaps(spark, sf))


@_query("SELECT 'Order-' || o_orderkey AS ID_FROM, 'Order.Customer' AS KEY_FROM, 'Customer-' || o_custkey AS VALUE_FROM, CAST(NULL AS VARCHAR) AS ID_TO FROM orders WHERE o_custkey % 7 = 0")
def dangling_detailed(spark, sf):
    return r.dangling_references(_with_gaps(spark, sf), detailed=True, relations=["Order.Customer"]).select("ID_FROM", "KEY_FROM", "VALUE_FROM", "ID_TO")


@_query("SELECT 'Order-' || o_orderkey AS order_id, c_name AS customer, n_name AS nation, r_name AS region FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def chained_join_limits(spark, sf):
    g = star.graph(spark, sf, "Order", "Customer", "Nation", "Region")
    view = lambda name, *keys: t.type_tableview(g, name, keys=list(keys)).toDF("ID_" + name, *(k.split(".")[0][0] + k.split(".")[1] for k in keys))
    orders, customers = view("Order", "Order.Customer"), view("Customer", "Customer.c_name", "Customer.Nation")
    nations, regions = view("Nation", "Nation.n_name", "Nation.Region"), view("Region", "Region.r_name")
    rows = orders.join(customers, F.col("OCustomer") == F.col("ID_Customer")).join(nations, F.col("CNation") == F.col("ID_Nation")).join(regions, F.col("NRegion") == F.col("ID_Region"))
    return rows.select(F.col("ID_Order").alias("order_id"), F.col("Cc_name").alias("customer"), F.col("Nn_name").alias("nation"), F.col("Rr_name").alias("region"))


@_query("SELECT 'Customer-' || c_custkey AS root, unnest(['Customer-' || c_custkey, 'Nation-' || n_nationkey, 'Region-' || n_regionkey]) AS ID FROM customer JOIN nation ON n_nationkey = c_nationkey")
def dependency_closure(spark, sf):
    g = star.graph(spark, sf, "Customer", "Nation", "Region")
    return r.dependency_closure(g.where(F.col("KEY").isin("Customer.Nation", "Nation.Region")).select("ID", "VALUE"), f.ids_of_type(g, "Customer"))


@_query(f"SELECT ID, KEY, CASE WHEN KEY = 'Nation.n_name' THEN 'X' ELSE VALUE END AS VALUE FROM ({_NATION})")
def set_value_at_key(spark, sf):
    return m.set_value_at_key(star.graph(spark, sf, "Nation"), "Nation.n_name", "X").select(*_NO_ORDER)


@_query(f"SELECT ID, KEY, CASE WHEN KEY = 'Nation.n_name' AND ID = 'Nation-4' THEN NULL ELSE VALUE END AS VALUE FROM ({_NATION})")
def set_value_at_key_and_id(spark, sf):
    return m.set_value_at_key_and_id(star.graph(spark, sf, "Nation"), "Nation.n_name", None, "Nation-4").select(*_NO_ORDER)


def _changes(spark, sf):
    rows = spark.read.parquet(f"{sf}/customer.parquet").where("c_custkey % 5 = 0")
    cells = F.array(F.struct(F.lit("Customer.c_mktsegment").alias("KEY"), F.lit("CHANGED").alias("VALUE")), F.struct(F.lit("Customer.note").alias("KEY"), F.lit("new").alias("VALUE")))
    return rows.select(F.concat(F.lit("Customer-"), F.col("c_custkey").cast("string")).alias("ID"), F.inline(cells))


_UPDATED = f"SELECT ID, KEY, CASE WHEN KEY = 'Customer.c_mktsegment' AND CAST(substr(ID, 10) AS BIGINT) % 5 = 0 THEN 'CHANGED' ELSE VALUE END AS VALUE FROM ({_CUSTOMER})"


@_query(_UPDATED)
def upsert_update(spark, sf):
    return m.update_from_facts(star.graph(spark, sf, "Customer"), _changes(spark, sf), add=False).select(*_NO_ORDER)


@_query(f"{_UPDATED} UNION ALL SELECT 'Customer-' || c_custkey, 'Customer.note', 'new' FROM customer WHERE c_custkey % 5 = 0")
def upsert_add(spark, sf):
    return m.update_from_facts(star.graph(spark, sf, "Customer"), _changes(spark, sf)).select(*_NO_ORDER)


@_query(_UPDATED)
def upsert_from_view(spark, sf):
    view = t.wide(_changes(spark, sf).where("KEY <> 'Customer.note'").withColumn("_ord", F.lit(0).cast("bigint")), ["Customer.c_mktsegment"])
    return m.update_from_view(star.graph(spark, sf, "Customer"), view).select(*_NO_ORDER)


@_query(f"SELECT ID, KEY, VALUE FROM ({_CUSTOMER}) WHERE NOT (KEY = 'Customer.Nation' AND VALUE IN ('Nation-1', 'Nation-2'))")
def remove_rows(spark, sf):
    g = star.graph(spark, sf, "Customer")
    return m.remove_facts(g, f.filter_facts(g, VALUE=["Nation-1", "Nation-2"])).select(*_NO_ORDER)


@_query("SELECT 'Customer-' || c_custkey AS ID, 'Customer.c_mktsegment' AS KEY, c_mktsegment AS VALUE, 'left_only' AS _merge FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT 'Customer-' || c_custkey, 'Customer.c_mktsegment', 'CHANGED', 'right_only' FROM customer WHERE c_custkey % 5 = 0")
def diff_datasets(spark, sf):
    g = star.graph(spark, sf, "Customer")
    return d.diff(g, m.update_from_facts(g, _changes(spark, sf), add=False)).select(*_NO_ORDER, "_merge")


@_query("SELECT 'Customer-' || c_custkey AS ID, 'Customer.c_mktsegment' AS KEY, unnest([c_mktsegment, 'CHANGED']) AS VALUE, unnest(['EQ', 'NEW']) AS INSTANCE_ID FROM customer WHERE c_custkey % 5 = 0")
def diff_by_instance(spark, sf):
    g = star.graph(spark, sf, "Customer")
    new = m.update_from_facts(g, _changes(spark, sf), add=False).withColumn("INSTANCE_ID", F.lit("NEW"))
    return d.diff_by_instance(g.unionByName(new), "EQ", "NEW")


@_query("SELECT true AS same, true AS any_order, false AS changed")
def content_hash_props(spark, sf):
    g = star.graph(spark, sf, "Nation", "Customer")
    whole = d.content_hash(g)
    flags = (whole == d.content_hash(g), whole == d.content_hash(g.orderBy(F.desc("ID"))), whole == d.content_hash(m.set_value_at_key_and_id(g, "Nation.n_name", None, "Nation-4")))
    return spark.createDataFrame([flags], "same boolean, any_order boolean, changed boolean")


@_query("WITH s AS (SELECT sum(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS p, sum(c_acctbal) FILTER (c_mktsegment = 'AUTOMOBILE') AS o FROM customer) SELECT 'Customer-' || c_custkey AS ID, round(c_acctbal * (1 + (1000000 - p - o) / p), 2) AS p FROM customer, s WHERE c_mktsegment = 'BUILDING'")
def scale_load(spark, sf):
    rows = spark.read.parquet(f"{sf}/customer.parquet").where("c_mktsegment IN ('BUILDING', 'AUTOMOBILE')")
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "ConformLoad").otherwise("NonConformLoad")
    cells = F.array(*(F.struct(F.lit(k).alias("KEY"), v.cast("string").alias("VALUE"), F.lit(i).cast("bigint").alias("_ord")) for i, (k, v) in enumerate([(TYPE, kind), ("EnergyConsumer.p", F.col("c_acctbal")), ("EnergyConsumer.q", F.col("c_acctbal") / 2)])))
    g = rows.select(F.concat(F.lit("Customer-"), F.col("c_custkey").cast("string")).alias("ID"), F.inline(cells)).withColumn("INSTANCE_ID", F.lit("SSH"))
    scaled = grid.scale_load(g, 1_000_000.0)
    return t.type_tableview(scaled, "ConformLoad", keys=["EnergyConsumer.p"]).select("ID", F.round(F.col("`EnergyConsumer.p`").cast("double"), 2).alias("p"))


@_query("SELECT Type, count, CAST(sum(count) OVER () AS BIGINT) AS TOTAL, round(count / sum(count) OVER () * 100, 6) AS percent FROM (SELECT c_mktsegment AS Type, count(*) AS count FROM customer GROUP BY 1)")
def unit_type_share(spark, sf):
    rows = spark.read.parquet(f"{sf}/customer.parquet")
    cells = F.array(F.struct(F.lit(TYPE).alias("KEY"), F.col("c_mktsegment").alias("VALUE")), F.struct(F.lit("GeneratingUnit.maxOperatingP").alias("KEY"), F.col("c_acctbal").cast("string").alias("VALUE")))
    g = rows.select(F.col("c_custkey").cast("string").alias("ID"), F.inline(cells))
    return counts.type_shares(g, "GeneratingUnit.maxOperatingP")


@_query("SELECT doc_id, '20230101T0000Z' AS scenario, CASE WHEN doc_id % 2 = 0 THEN '1D' ELSE '' END AS process, upper(lang) || '-' || source AS entity, 'EQ' AS message, lpad(CAST(doc_id % 100 AS VARCHAR), 3, '0') AS version, upper(lang) AS merging, source AS domain FROM documents")
def filename_metadata(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    process = F.when(F.col("doc_id") % 2 == 0, F.lit("_1D_")).otherwise(F.lit("_"))
    name = F.concat(F.lit("20230101T0000Z"), process, F.upper("lang"), F.lit("-"), F.col("source"), F.lit("_EQ_"), F.lpad((F.col("doc_id") % 100).cast("string"), 3, "0"), F.lit(".xml"))
    fields = docs.select("doc_id", grid.filename_fields(name).alias("f"))
    pick = lambda k: F.col(f"f.`Model.{k}`")
    return fields.select("doc_id", pick("scenarioTime").alias("scenario"), pick("processType").alias("process"), pick("modelingEntity").alias("entity"), pick("messageType").alias("message"), pick("version").alias("version"), pick("mergingEntity").alias("merging"), pick("domain").alias("domain"))


@_query("SELECT 'Customer-' || c_custkey AS c, c_name AS name, n_name AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_name < 'NATION_3'")
def pattern_bgp_filter(spark, sf):
    g = star.graph(spark, sf, "Customer", "Nation")
    return p.match(g, [("?c", "Customer.c_name", "?name"), ("?c", "Customer.Nation", "?n"), ("?n", "Nation.n_name", "?nation")]).where("nation < 'NATION_3'").select("c", "name", "nation")


@_query("SELECT 'Nation-' || n_nationkey AS n, c_name AS name FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING' AND c_acctbal > 5000")
def pattern_optional(spark, sf):
    g = star.graph(spark, sf, "Customer", "Nation")
    rich = p.match(g, [("?c", "Customer.Nation", "?n"), ("?c", "Customer.c_mktsegment", "BUILDING"), ("?c", "Customer.c_acctbal", "?b"), ("?c", "Customer.c_name", "?name")]).where(p.number("b") > 5000).select("n", "name")
    return p.optional(p.pattern(g, "?n", TYPE, "Nation"), rich)


@_query("SELECT 'Customer-' || c_custkey AS x, c_name AS name, CAST(NULL AS VARCHAR) AS brand FROM customer UNION ALL SELECT 'Part-' || p_partkey, NULL, p_brand FROM part")
def pattern_union(spark, sf):
    g = star.graph(spark, sf, "Customer", "Part")
    return p.union(p.pattern(g, "?x", "Customer.c_name", "?name"), p.pattern(g, "?x", "Part.p_brand", "?brand"))


@_query("SELECT 'Customer-' || c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def pattern_minus(spark, sf):
    g = star.graph(spark, sf, "Customer", "Order")
    return p.minus(p.pattern(g, "?c", TYPE, "Customer"), p.match(g, [("?o", "Order.Customer", "?c"), ("?o", "Order.o_orderpriority", "1-URGENT")]).select("c"))


@_query("SELECT 'Customer-' || c_custkey AS c FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def pattern_exists(spark, sf):
    g = star.graph(spark, sf, "Customer", "Order")
    return p.exists(p.pattern(g, "?c", TYPE, "Customer"), p.match(g, [("?o", "Order.Customer", "?c"), ("?o", "Order.o_orderstatus", "F")]).select("c"))


@_query("SELECT n_name AS nation, count(*) AS orders, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,2)))) AS BIGINT) AS total, count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 HAVING count(*) > 5")
def pattern_aggregate_having(spark, sf):
    g = star.graph(spark, sf, "Order", "Customer", "Nation")
    rows = p.match(g, [("?o", "Order.o_totalprice", "?price"), ("?o", "Order.Customer", "?c"), ("?c", "Customer.Nation", "?n"), ("?n", "Nation.n_name", "?nation")])
    price = F.col("price").cast("decimal(18,2)")
    return rows.groupBy("nation").agg(F.count("*").alias("orders"), F.round(F.sum(price)).cast("bigint").alias("total"), F.countDistinct("c").alias("customers")).where("orders > 5")


@_query("SELECT 'Order-' || o_orderkey AS o, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS price FROM orders ORDER BY 2 DESC, 1 LIMIT 10 OFFSET 5")
def pattern_order_limit(spark, sf):
    g = star.graph(spark, sf, "Order")
    return p.pattern(g, "?o", "Order.o_totalprice", "?price").withColumn("price", p.number("price")).orderBy(F.desc("price"), "o").offset(5).limit(10)


@_query("SELECT n_name AS nation, 'Nation-' || n_nationkey AS n, length(n_name) AS size FROM nation WHERE n_name IN ('NATION_1', 'NATION_12')")
def pattern_values_bind(spark, sf):
    g = star.graph(spark, sf, "Nation")
    given = p.values(spark, ["nation"], [("NATION_1",), ("NATION_12",), ("NOWHERE",)])
    return p.pattern(g, "?n", "Nation.n_name", "?nation").join(F.broadcast(given), "nation").withColumn("size", F.length("nation").cast("bigint"))


@_query("SELECT 'Customer-' || c_custkey AS s, unnest(['Nation-' || n_nationkey, 'Region-' || n_regionkey]) AS o FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'Nation-' || n_nationkey, 'Region-' || n_regionkey FROM nation")
def pattern_path_plus(spark, sf):
    g = star.graph(spark, sf, "Customer", "Nation")
    return p.one_or_more(p.path(g, ["Customer.Nation", "Nation.Region"]))


@_query("SELECT 'Region-' || r_regionkey AS s, 'Customer-' || c_custkey AS o FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def pattern_path_inverse_sequence(spark, sf):
    g = star.graph(spark, sf, "Customer", "Nation")
    return p.sequence(p.path(g, ["Nation.Region"], inverse=True), p.path(g, ["Customer.Nation"], inverse=True))


@_query("SELECT 'Nation-' || n_nationkey AS ID, 'inRegion' AS KEY, r_name AS VALUE FROM nation JOIN region ON r_regionkey = n_regionkey")
def pattern_construct(spark, sf):
    g = star.graph(spark, sf, "Nation", "Region")
    return p.construct(p.match(g, [("?n", "Nation.Region", "?r"), ("?r", "Region.r_name", "?name")]), [("?n", "inRegion", "?name")])


@_query("SELECT true AS found, false AS missing")
def pattern_ask(spark, sf):
    g = star.graph(spark, sf, "Nation")
    return spark.createDataFrame([(p.ask(p.pattern(g, "?n", "Nation.n_name", "NATION_1")), p.ask(p.pattern(g, "?n", "Nation.n_name", "NOWHERE")))], "found boolean, missing boolean")


@_query("SELECT 'Order-' || o_orderkey AS x FROM orders")
def pattern_graph_scope(spark, sf):
    return p.match(star.graph(spark, sf, "Customer", "Order"), [("?x", TYPE, "?t")], instance="SSH").select("x")


_HIERARCHY = "SELECT 'Customer-' || c_custkey AS a, 'Nation-' || c_nationkey AS b FROM customer UNION ALL SELECT 'Nation-' || n_nationkey, 'Region-' || n_regionkey FROM nation"


@_query(f"SELECT a AS s, b AS o FROM ({_HIERARCHY}) WHERE a LIKE 'Customer%' UNION ALL SELECT 'Customer-' || c_custkey, 'Customer-' || c_custkey FROM customer")
def pattern_path_optional(spark, sf):
    g = star.graph(spark, sf, "Customer", "Nation")
    return p.zero_or_one(g, p.path(g, ["Customer.Nation", "Nation.Region"]), p.pattern(g, "?s", TYPE, "Customer"))


@_query("SELECT 'Nation-' || n_nationkey AS s, 'Region-' || n_regionkey AS o FROM nation UNION ALL SELECT 'Nation-' || c_nationkey, 'Customer-' || c_custkey FROM customer")
def pattern_path_negated(spark, sf):
    g = star.graph(spark, sf, "Customer", "Nation")
    links = p.negated(g, [TYPE, "Nation.n_name"], [TYPE, "Nation.Region", "Nation.n_name", "Customer.c_name", "Customer.c_acctbal", "Customer.c_mktsegment"])
    return p.exists(links, p.pattern(g, "?s", TYPE, "Nation"))


@_query("SELECT 'Region-' || r_regionkey AS s, 'Customer-' || c_custkey AS o FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE r_name = 'ASIA' OR r_regionkey = 1 UNION ALL SELECT 'Region-' || r_regionkey, 'Nation-' || n_nationkey FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' OR r_regionkey = 1 UNION ALL SELECT 'Region-' || r_regionkey, 'Region-' || r_regionkey FROM region WHERE r_name = 'ASIA' OR r_regionkey = 1")
def pattern_path_star_from_end(spark, sf):
    """What leads to some regions: the walk starts where the path is bound, at its end."""
    g = star.graph(spark, sf, "Customer", "Nation", "Region")
    ends = g.where((F.col("KEY") == "Region.r_name") & ((F.col("VALUE") == "ASIA") | (F.col("ID") == "Region-1"))).select(F.col("ID").alias("s"))
    return p.zero_or_more(g, p.reversed_links(p.path(g, ["Customer.Nation", "Nation.Region"])), ends)


def _sparse(spark, sf):
    """Customers with their segment where the key is even; nations of those whose key is no multiple of 3."""
    g = star.graph(spark, sf, "Customer")
    segments = p.optional(p.pattern(g, "?c", TYPE, "Customer"), p.pattern(g.where(F.substring_index("ID", "-", -1).cast("bigint") % 2 == 0), "?c", "Customer.c_mktsegment", "?v"))
    nations = p.optional(p.pattern(g, "?c", TYPE, "Customer"), p.pattern(g.where(F.substring_index("ID", "-", -1).cast("bigint") % 3 > 0), "?c", "Customer.Nation", "?w"))
    return g, segments, nations


@_query("SELECT 'Customer-' || c_custkey AS c, CASE WHEN c_custkey % 2 = 0 OR c_mktsegment = 'BUILDING' THEN c_mktsegment END AS v FROM customer")
def pattern_optional_unbound(spark, sf):
    """Where v is unbound the second pattern binds it, where it is bound both have to agree."""
    g, segments, _ = _sparse(spark, sf)
    return p.optional(segments, p.match(g, [("?c", "Customer.c_mktsegment", "?v"), ("?c", "Customer.c_mktsegment", "BUILDING")]))


@_query("SELECT 'Customer-' || c_custkey AS c, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS v FROM customer WHERE c_custkey % 3 > 0 AND c_nationkey <> 7 AND NOT (c_custkey % 2 = 0 AND c_mktsegment = 'BUILDING')")
def pattern_minus_unbound(spark, sf):
    """Takes away customers of nation 7 whatever their v, and those with v = BUILDING; keys that are multiples of 3 go by their unbound w."""
    g, segments, nations = _sparse(spark, sf)
    of_seven = nations.where("w = 'Nation-7'").select("c", F.lit(None).cast("string").alias("v"))
    unbound = nations.where("w IS NULL").select("c", F.lit(None).cast("string").alias("v"))
    builds = segments.where("v = 'BUILDING'")
    return p.minus(segments, p.union(of_seven, unbound, builds))


@_query("SELECT 'Order-' || o_orderkey AS ID, 'Order.o_orderstatus' AS KEY, o_orderstatus AS VALUE FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT '_:' || o_orderkey, 'price', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT 'Order-' || o_orderkey, 'Order.detail', '_:' || o_orderkey FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT '_:' || o_orderkey, 'inner', '_:in' || o_orderkey FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT '_:in' || o_orderkey, 'priority', o_orderpriority FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT '_:in' || o_orderkey, 'of', 'Customer-' || o_custkey FROM orders WHERE o_orderkey % 4 = 0")
def pattern_describe_nested(spark, sf):
    """Orders with a blank node for details, which has another; the description takes both, but not the customer."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    key = F.col("o_orderkey").cast("string")
    fact = lambda s, k, v: F.struct(s.alias("ID"), F.lit(k).alias("KEY"), v.alias("VALUE"))
    order, blank, inner = F.concat(F.lit("Order-"), key), F.concat(F.lit("_:"), key), F.concat(F.lit("_:in"), key)
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    rows = orders.select(F.inline(F.array(fact(order, "Order.o_orderstatus", F.col("o_orderstatus")), fact(order, "Order.detail", blank), fact(blank, "price", price), fact(blank, "inner", inner), fact(inner, "priority", F.col("o_orderpriority")), fact(inner, "of", F.concat(F.lit("Customer-"), F.col("o_custkey").cast("string"))))))
    wanted = orders.where("o_orderkey % 4 = 0").select(order.alias("o"))
    return p.describe(rows.unionByName(star.graph(spark, sf, "Customer").select("ID", "KEY", "VALUE")), wanted, "o")
