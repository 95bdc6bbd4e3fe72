"""Changed copies of a graph table; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.model import ORDER, facts
from quadweave.operators.tableview import facts_of_view


#: Added facts come behind loaded ones.
ADDED = 1 << 60


def _value(value):
    return F.lit(None if value is None else str(value)).cast("string")


def set_value_at_key(data: DataFrame, key: str, value) -> DataFrame:
    """Sets a property wherever it occurs; values are stored as text, None as null."""
    return data.withColumn("VALUE", F.when(F.col("KEY") == key, _value(value)).otherwise(F.col("VALUE")))


def set_value_at_key_and_id(data: DataFrame, key: str, value, object_id: str) -> DataFrame:
    """Sets a property of one object."""
    here = (F.col("KEY") == key) & (F.col("ID") == object_id)
    return data.withColumn("VALUE", F.when(here, _value(value)).otherwise(F.col("VALUE")))


def update_from_facts(data: DataFrame, changes: DataFrame, update: bool = True, add: bool = True) -> DataFrame:
    """Upsert by ID and KEY, and INSTANCE_ID if `changes` has it.

    Of several changes of one property the first counts; a null VALUE overwrites; added facts without
    INSTANCE_ID have none.  Both tables may be large, and Spark guesses their size by files that hold far less than
    the facts laid out from them: they are merged, and neither is sent whole to a task."""
    on = ["ID", "KEY"] + (["INSTANCE_ID"] if "INSTANCE_ID" in changes.columns else [])
    order = F.coalesce(ORDER, F.lit(0).cast("bigint"))
    first = facts(changes).groupBy(*on).agg(F.min_by(F.struct("VALUE"), order).alias("change"), F.min(order).alias("place"))
    kept = data
    if update:
        own = first.select(*(F.col(c).alias(f"_{c}") for c in on), "change")
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]
        value = F.when(F.col("change").isNotNull(), F.col("change.VALUE")).otherwise(F.col("VALUE"))
        kept = data.join(own.hint("merge"), same, "left").withColumn("VALUE", value).select(*data.columns)
    if not add:
        return kept
    there = data.select(*(F.col(c).alias(f"_{c}") for c in on))
    fresh = first.join(there.hint("merge"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on], "left_anti").withColumn("VALUE", F.col("change.VALUE"))
    fresh = fresh.withColumn(ORDER, F.lit(ADDED) + F.col("place")).drop("change", "place")  # behind all that was loaded
    if ORDER not in data.columns:
        fresh = fresh.drop(ORDER)
    if "INSTANCE_ID" not in on:
        fresh = fresh.withColumn("INSTANCE_ID", F.lit(None).cast("string"))
    return kept.unionByName(fresh, allowMissingColumns=True)


def update_from_view(data: DataFrame, view: DataFrame, update: bool = True, add: bool = True, instance_id: str | None = None) -> DataFrame:
    """Upsert from a wide view."""
    changes = facts_of_view(view, instance_id)
    if instance_id is None and "INSTANCE_ID" not in view.columns:
        changes = changes.drop("INSTANCE_ID")
    return update_from_facts(data, changes, update, add)


def remove_facts(data: DataFrame, what: DataFrame, columns=("ID", "KEY", "VALUE")) -> DataFrame:
    """Drops the rows that equal one of `what` on some columns; nulls are equal."""
    drop = what.select(*(F.col(c).alias(f"_{c}") for c in columns)).distinct()
    return data.join(drop, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns], "left_anti")
