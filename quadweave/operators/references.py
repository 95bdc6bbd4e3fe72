"""Links between objects: a value that is the ID of another object refers to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadweave.model import COLUMNS, ORDER, TYPE
from quadweave.operators.hot import sized
from quadweave.operators.reach import reach
from quadweave.operators.tableview import wide
from quadweave.steps import written


def references_all(data: DataFrame) -> DataFrame:
    """Every link once: ID_FROM, KEY, ID_TO."""
    ids = data.select(F.col("ID").alias("ID_TO")).distinct()
    links = data.where(F.col("VALUE").isNotNull()).select(F.col("ID").alias("ID_FROM"), "KEY", F.col("VALUE").alias("ID_TO")).distinct()
    return links.join(ids, "ID_TO", "left_semi").select("ID_FROM", "KEY", "ID_TO")


def _start(data: DataFrame, object_id: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return data.where(F.col("ID") == object_id).select(*COLUMNS, ORDER, F.lit(0).alias("level"), none.alias("ID_TO"), none.alias("ID_FROM"))


def _links(data: DataFrame, known: DataFrame, inbound: bool) -> DataFrame:
    """(ID_FROM, ID_TO) of the objects one link away from known ones (ID), once; the first link of each by load order is kept.

    It is written, being far smaller than the facts; outbound ends may be values of no object, which have no facts."""
    near, far = ("ID_FROM", "ID_TO") if inbound else ("ID_TO", "ID_FROM")
    links = data.select(F.col("ID").alias("ID_FROM"), F.col("VALUE").alias("ID_TO"), ORDER).join(sized(known).withColumnRenamed("ID", far), far)
    return written(links.where(F.col(near).isNotNull()).groupBy(near).agg(F.min_by(far, F.struct(ORDER, far)).alias(far)), "links")


def _walk(data: DataFrame, object_id: str, levels: int, inbound: bool) -> DataFrame:
    near = "ID_FROM" if inbound else "ID_TO"
    found = _start(data, object_id)
    known = written(found.select("ID").distinct(), "known")
    for level in range(1, levels + 1):
        first = _links(data, known, inbound)
        if first.isEmpty():
            break
        rows = data.join(sized(first), F.col("ID") == F.col(near))
        found = found.unionByName(rows.select(*COLUMNS, ORDER, F.lit(level).alias("level"), "ID_TO", "ID_FROM"))
        known = first.select(F.col(near).alias("ID"))
    return found


def references_to(data: DataFrame, object_id: str, levels: int = 1) -> DataFrame:
    """Facts of the object (level 0) and of those that refer to it, level by level."""
    return _walk(data, object_id, levels, True)


def references_from(data: DataFrame, object_id: str, levels: int = 1) -> DataFrame:
    """Facts of the object (level 0) and of those that it refers to, level by level."""
    return _walk(data, object_id, levels, False)


def references(data: DataFrame, object_id: str, levels: int = 1) -> DataFrame:
    """Both ways; a fact that both have is taken from the outbound side, at its lowest level."""
    both = references_from(data, object_id, levels).withColumn("_side", F.lit(0)).unionByName(references_to(data, object_id, levels).withColumn("_side", F.lit(1)))
    order = Window.partitionBy(*COLUMNS).orderBy("_side", "level", ORDER)
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_side")


def _simple(walked: DataFrame, index: str, columns) -> DataFrame:
    return wide(walked.where((F.col("level") == 1) & F.col("KEY").isin(list(columns))), list(columns), index=index)


def references_to_simple(data: DataFrame, object_id: str, columns=(TYPE,)) -> DataFrame:
    """One row per referring object, with some of its properties."""
    return _simple(references_to(data, object_id), "ID_FROM", columns)


def references_from_simple(data: DataFrame, object_id: str, columns=(TYPE,)) -> DataFrame:
    """One row per object referred to, with some of its properties."""
    return _simple(references_from(data, object_id), "ID_TO", columns)


def references_simple(data: DataFrame, object_id: str, columns=(TYPE, "IdentifiedObject.name"), levels: int = 1) -> DataFrame:
    """One row per object around another, with properties, the lowest level and the link it was reached by."""
    walked = references(data, object_id, levels)
    keys = list(columns)
    cells = [F.min_by(F.when(F.col("KEY") == k, F.col("VALUE")), F.when(F.col("KEY") == k, F.col(ORDER))).alias(k) for k in keys]
    place = F.struct("level", F.col("ID_FROM").isNull(), ORDER)
    return walked.groupBy("ID").agg(*cells, F.min("level").alias("level"), F.min_by("ID_FROM", place).alias("ID_FROM"), F.min_by("ID_TO", place).alias("ID_TO")).orderBy("level", "ID")


def dangling_references(data: DataFrame, detailed: bool = False, pattern: str = r"\.[A-Z]", relations=None) -> DataFrame:
    """Reference properties whose value is no typed object: counts by property, or the facts themselves.

    Properties are told by a pattern, or by the names in `relations`."""
    is_link = F.col("KEY").isin(list(relations)) if relations is not None else F.col("KEY").rlike(pattern)
    typed = data.where(F.col("KEY") == TYPE).select(F.col("ID").alias("VALUE"))
    loose = data.where(is_link).join(typed, "VALUE", "left_anti")
    if not detailed:
        return loose.groupBy(F.col("KEY").alias("KEY_FROM")).agg(F.count("*").alias("count"))
    none = F.lit(None).cast("string")
    return loose.select(*(none.alias(f"{c}_TO") for c in COLUMNS), *(F.col(c).alias(f"{c}_FROM") for c in COLUMNS), F.lit("right_only").alias("_merge"))


def dependency_closure(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, ID) for everything that roots (ID) reach over links (ID, VALUE), themselves included; cycles end."""
    steps = links.select(F.col("ID").alias("s"), F.col("VALUE").alias("o"))
    return reach(steps, roots.select(F.col("ID").alias("s")), zero=True).select(F.col("s").alias("root"), F.col("o").alias("ID"))
