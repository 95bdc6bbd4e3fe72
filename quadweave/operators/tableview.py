"""Wide views of objects, one column per property, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadweave.model import ORDER, TYPE, quoted
from quadweave.operators.filters import filter_by_facts, filter_by_type
from quadweave.steps import new_path

#: Numbers as the views accept them (a fixed pattern: optional sign, digits, fraction, exponent).
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
#: Properties up to which one aggregate takes them all; beyond that Spark's pivot does.
ONE_PASS = 64


def keys_of(rows: DataFrame) -> list[str]:
    """The properties that occur: one small job, bounded by spark.sql.pivotMaxValues."""
    most = int(rows.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = [r["KEY"] for r in rows.select("KEY").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} properties; name those that are wanted")
    return sorted(found)


def _cell(multivalue: bool) -> Column:
    if not multivalue:
        return F.min_by("VALUE", ORDER)
    return F.transform(F.array_sort(F.collect_list(F.struct(ORDER, "VALUE"))), lambda s: s["VALUE"])


def wide(rows: DataFrame, keys: list[str] | None = None, multivalue: bool = False, index: str = "ID") -> DataFrame:
    """One row per object; the first value of a property by load order, or all as an array."""
    keys = keys_of(rows) if keys is None else keys
    if not keys:
        return rows.select(index).distinct()
    if len(keys) > ONE_PASS or multivalue:
        return rows.groupBy(index).pivot("KEY", keys).agg(_cell(multivalue))
    here = rows.where(F.col("KEY").isin(keys))
    cells = [F.min_by(F.when(F.col("KEY") == k, F.col("VALUE")), F.when(F.col("KEY") == k, F.col(ORDER))).alias(k) for k in keys]
    return here.groupBy(index).agg(*cells)


def rendered(view: DataFrame, index: str = "ID") -> DataFrame:
    """A multivalue view as text: one value is itself, several are written like ['a', 'b']."""
    shown = [quoted(c) if c == index else F.when(F.size(quoted(c)) > 1, F.concat(F.lit("['"), F.array_join(quoted(c), "', '"), F.lit("']"))).otherwise(F.get(quoted(c), F.lit(0))).alias(c) for c in view.columns]
    return view.select(*shown)


def numbers(view: DataFrame, index: str = "ID") -> DataFrame:
    """Columns whose values are all numbers become doubles; one job decides."""
    columns = [c for c in view.columns if c != index]
    if not columns:
        return view
    bad = view.agg(*(F.count(F.when(quoted(c).isNotNull() & ~quoted(c).rlike(NUMBER), 1)).alias(str(i)) for i, c in enumerate(columns)), *(F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(columns))).first()
    turned = {c for i, c in enumerate(columns) if bad[str(i)] == 0 and bad[f"n{i}"] > 0}
    return view.select(*(quoted(c).try_cast("double").alias(c) if c in turned else quoted(c) for c in view.columns))


def _view(rows: DataFrame, string_to_number: bool, multivalue: bool, keys) -> DataFrame:
    view = wide(rows, keys, multivalue)
    return numbers(view) if string_to_number and not multivalue else view


def type_tableview(data: DataFrame, name: str, string_to_number: bool = False, type_key: str = TYPE, multivalue: bool = False, keys: list[str] | None = None) -> DataFrame:
    """The objects of a class; without any, an empty table with ID."""
    return _view(filter_by_type(data, name, type_key), string_to_number, multivalue, keys)


def key_tableview(data: DataFrame, key: str, string_to_number: bool = False, multivalue: bool = False, keys: list[str] | None = None) -> DataFrame:
    """The objects that have a property."""
    return _view(filter_by_facts(data, data.where(F.col("KEY") == key)), string_to_number, multivalue, keys)


def id_tableview(data: DataFrame, ids, string_to_number: bool = False, multivalue: bool = False, keys: list[str] | None = None) -> DataFrame:
    """The objects of some IDs: one, a list, or a table with ID."""
    if isinstance(ids, DataFrame):
        rows = filter_by_facts(data, ids)
    else:
        rows = data.where(F.col("ID").isin([ids] if isinstance(ids, str) else list(ids)))
    return _view(rows, string_to_number, multivalue, keys)


def tableviews(data: DataFrame, multivalue: bool = False) -> dict[str, DataFrame]:
    """A view for every class, all from one pass over the facts: the cells of objects are written by class, and a view reads its class alone."""
    spark = data.sparkSession
    types = data.where(F.col("KEY") == TYPE).select("ID", F.col("VALUE").alias("class")).where("class is not null").distinct()
    rows = data.where(F.col("KEY").isNotNull()).join(types, "ID").repartition("class", "ID")
    cells = rows.groupBy("class", "ID", "KEY").agg(_cell(multivalue).alias("cell")).groupBy("class", "ID").agg(F.map_from_entries(F.collect_list(F.struct("KEY", "cell"))).alias("cells"))
    where = new_path(spark, "views")
    cells.write.partitionBy("class").parquet(where)
    kind = "array<string>" if multivalue else "string"
    kept = spark.read.schema(f"ID string, cells map<string,{kind}>, class string").parquet(where)
    found: dict[str, list[str]] = {}
    for r in kept.select("class", F.explode(F.map_keys("cells")).alias("KEY")).distinct().collect():  # classes times properties
        found.setdefault(r["class"], []).append(r["KEY"])
    view = lambda c, keys: kept.where(F.col("class") == c).select("ID", *(F.try_element_at("cells", F.lit(k)).alias(k) for k in keys))
    return {c: view(c, sorted(keys)) for c, keys in sorted(found.items())}


def facts_of_view(view: DataFrame, instance_id: str | None = None, index: str = "ID") -> DataFrame:
    """Facts of a wide view, without empty cells; arrays give a fact for each element."""
    kinds = dict(view.dtypes)
    columns = [c for c in view.columns if c not in (index, "INSTANCE_ID")]
    cell = lambda i, c: F.struct(F.lit(c).alias("KEY"), (quoted(c).cast("array<string>") if kinds[c].startswith("array") else F.array(quoted(c).cast("string"))).alias("VALUES"), F.lit(i).alias("place"))
    instance = F.lit(instance_id).cast("string") if instance_id is not None or "INSTANCE_ID" not in view.columns else F.col("INSTANCE_ID")
    cells = view.select(quoted(index).alias("ID"), instance.alias("INSTANCE_ID"), F.inline(F.array(*(cell(i, c) for i, c in enumerate(columns)))))
    rows = cells.select("ID", "KEY", "INSTANCE_ID", "place", F.posexplode("VALUES").alias("at", "VALUE")).where(F.col("VALUE").isNotNull())
    return rows.select("ID", "KEY", "VALUE", "INSTANCE_ID", (F.shiftleft(F.col("place").cast("bigint"), 40) + F.col("at")).alias(ORDER))


def facts_of_views(views: dict[str, DataFrame], instance_id: str | None = None) -> DataFrame:
    """Facts of views by class; the class is added where a view has no Type."""
    found = None
    for name, view in views.items():
        whole = view if TYPE in view.columns else view.withColumn(TYPE, F.lit(name))
        rows = facts_of_view(whole, instance_id)
        found = rows if found is None else found.unionByName(rows)
    return found
