"""Selections of facts and of objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadweave.model import COLUMNS, ORDER, TYPE


def _matches(column: str, wanted, regex: bool) -> Column:
    if isinstance(wanted, (list, tuple, set)):
        wanted = list(wanted)
        if regex:
            return F.col(column).rlike("|".join(f"(?:{p})" for p in wanted)) if wanted else F.lit(False)
        return F.col(column).isin(wanted) if wanted else F.lit(False)
    return F.col(column).rlike(wanted) if regex else F.col(column) == F.lit(wanted)


def filter_facts(data: DataFrame, ID=None, KEY=None, VALUE=None, INSTANCE_ID=None, regex: bool = False) -> DataFrame:
    """Rows that match every given column: a value, one of a list, or with `regex` a pattern found anywhere."""
    for column, wanted in zip(COLUMNS, (ID, KEY, VALUE, INSTANCE_ID), strict=True):
        if wanted is not None:
            data = data.where(_matches(column, wanted, regex))
    return data


def ids_of_type(data: DataFrame, name: str, type_key: str = TYPE) -> DataFrame:
    return data.where((F.col("KEY") == type_key) & (F.col("VALUE") == name)).select("ID")


def filter_by_type(data: DataFrame, name: str, type_key: str = TYPE) -> DataFrame:
    """All facts of the objects of a class; an object declared several times counts once."""
    return data.join(ids_of_type(data, name, type_key), "ID", "left_semi")


def filter_by_facts(data: DataFrame, other: DataFrame) -> DataFrame:
    """All facts of the objects that occur in another table."""
    return data.join(other.select("ID"), "ID", "left_semi")


def filter_by_value(data: DataFrame, value, detailed: bool = False, type_key: str = TYPE, regex: bool = False) -> DataFrame:
    """Objects with a matching value: the matching facts and types, types first; all facts if `detailed`."""
    hits = filter_facts(data, VALUE=value, regex=regex)
    objects = data.join(hits.select("ID"), "ID", "left_semi")
    if detailed:
        return objects
    kept = objects.where(_matches("VALUE", value, regex) | (F.col("KEY") == type_key))
    return kept.dropDuplicates(list(COLUMNS)).orderBy("ID", F.desc(F.col("KEY") == type_key), *([ORDER] if ORDER in data.columns else []))


def object_data(data: DataFrame, object_id: str) -> DataFrame:
    """KEY and VALUE of one object."""
    return data.where(F.col("ID") == object_id).select("KEY", "VALUE")


def namespace_map(data: DataFrame) -> tuple[dict[str, str], str]:
    """Prefixes with their URIs, the last of a prefix wins, and the XML base ("" if there is none)."""
    rows = filter_by_type(data, "NamespaceMap").where(F.col("KEY") != TYPE)
    last = rows.groupBy("KEY").agg(F.max_by("VALUE", ORDER).alias("VALUE")).collect()  # one row a prefix
    found = {r["KEY"]: r["VALUE"] for r in last}
    return found, found.pop("xml_base", "") or ""


def in_scope(data: DataFrame, scope=None) -> DataFrame:
    """Facts of the given instances; of all without a scope."""
    return data if scope is None else data.where(_matches("INSTANCE_ID", [scope] if isinstance(scope, str) else scope, False))
