"""Relational tables as a graph: each row an object, each column a fact, each foreign key a reference."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave.model import ORDER


@dataclass(frozen=True)
class Mapping:
    """A table's class, its key, its plain columns, its references (column to class) and its instance."""

    name: str
    table: str
    key: str
    columns: tuple[str, ...]
    references: dict[str, str] = field(default_factory=dict)
    instance: str = "EQ"


CLASSES = {
    m.name: m
    for m in (
        Mapping("Region", "region", "r_regionkey", ("r_name",)),
        Mapping("Nation", "nation", "n_nationkey", ("n_name",), {"n_regionkey": "Region"}),
        Mapping("Customer", "customer", "c_custkey", ("c_name", "c_acctbal", "c_mktsegment"), {"c_nationkey": "Nation"}),
        Mapping("Supplier", "supplier", "s_suppkey", ("s_name", "s_acctbal"), {"s_nationkey": "Nation"}),
        Mapping("Part", "part", "p_partkey", ("p_name", "p_brand", "p_type", "p_size", "p_retailprice")),
        Mapping("Order", "orders", "o_orderkey", ("o_orderstatus", "o_totalprice", "o_orderpriority"), {"o_custkey": "Customer"}, "SSH"),
        Mapping("Event", "events", "event_id", ("event_type", "user_id", "props"), {}, "EV"),
        Mapping("Document", "documents", "doc_id", ("lang", "source", "n_chars"), {}, "DOC"),
    )
}


def _text(df: DataFrame, column: str) -> Column:
    """Numbers with a fixed scale, so that their text does not depend on the engine."""
    kind = df.schema[column].dataType.simpleString()
    return F.col(column).cast("decimal(18,2)").cast("string") if kind in ("double", "float") else F.col(column).cast("string")


def objects(df: DataFrame, m: Mapping, keys: list[str] | None = None) -> DataFrame:
    """The facts of one table, or those of some properties: one scan, which reads only the columns of these."""
    ID, place = F.concat(F.lit(f"{m.name}-"), F.col(m.key).cast("string")), F.col(m.key).cast("bigint") * 16
    values = [("Type", F.lit(m.name))] + [(f"{m.name}.{c}", _text(df, c)) for c in m.columns]
    values += [(f"{m.name}.{to}", F.concat(F.lit(f"{to}-"), F.col(c).cast("string"))) for c, to in m.references.items()]
    wanted = [(i, key, value) for i, (key, value) in enumerate(values) if keys is None or key in keys]
    if len(wanted) == 1:
        i, key, value = wanted[0]
        return df.select(ID.alias("ID"), F.lit(key).alias("KEY"), value.alias("VALUE"), F.lit(m.instance).alias("INSTANCE_ID"), (place + i).alias(ORDER))
    cells = [F.struct(F.lit(key).alias("KEY"), value.alias("VALUE"), F.lit(m.instance).alias("INSTANCE_ID"), (place + i).alias(ORDER)) for i, key, value in wanted]
    facts = F.array(*cells) if cells else F.array().cast(f"array<struct<KEY:string,VALUE:string,INSTANCE_ID:string,{ORDER}:bigint>>")
    return df.select(ID.alias("ID"), F.inline(facts))


def order_parts(lines: DataFrame) -> DataFrame:
    """The parts of an order: a property with several values, in the order of line and part."""
    order = 16 + F.col("l_linenumber").cast("bigint") * 10_000_000 + F.col("l_partkey")
    part = F.concat(F.lit("Part-"), F.col("l_partkey").cast("string"))
    return lines.select(F.concat(F.lit("Order-"), F.col("l_orderkey").cast("string")).alias("ID"), F.lit("Order.Part").alias("KEY"), part.alias("VALUE"), F.lit("SV").alias("INSTANCE_ID"), order.alias(ORDER))


def graph(spark: SparkSession, sf_dir: str, *names: str, keys: list[str] | None = None) -> DataFrame:
    """The graph of some classes, whole or of some properties; `OrderParts` adds the parts of orders."""
    found = None
    for name in names:
        if name == "OrderParts":
            part = order_parts(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
        else:
            part = objects(spark.read.parquet(f"{sf_dir}/{CLASSES[name].table}.parquet"), CLASSES[name], keys)
        found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError("no class is named")
    return found
