"""Questions that are asked of power-grid models."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadweave.model import ORDER, TYPE
from quadweave.operators.filters import filter_by_type
from quadweave.operators.hot import joined
from quadweave.operators.mutate import update_from_facts, update_from_view
from quadweave.operators.references import dependency_closure
from quadweave.operators.tableview import key_tableview, type_tableview
from quadweave.steps import written

#: The profile of state variables in its usual edition (a fixed value).
STATE_VARIABLES = "http://entsoe.eu/CIM/StateVariables/4/1"
HEADER = ("Model.scenarioTime", "Model.processType", "Model.modelingEntity", "Model.messageType", "Model.version")


def instance_ids(profiles) -> dict[str, str]:
    """A fresh UUID for every profile."""
    return {p: str(uuid.uuid4()) for p in profiles}


def limits(data: DataFrame, keep_without_terminal: bool = False) -> DataFrame:
    """Operational limits with their set, type, terminal, and the equipment with its class."""
    named = lambda view, *pairs: view.select(*(F.col(f"`{a}`").alias(b) for a, b in pairs))
    sets = named(type_tableview(data, "OperationalLimitSet", keys=["OperationalLimitSet.Terminal", "OperationalLimitSet.Equipment"]), ("ID", "set_id"), ("OperationalLimitSet.Terminal", "terminal_id"), ("OperationalLimitSet.Equipment", "set_equipment"))
    own = named(key_tableview(data, "OperationalLimit.OperationalLimitSet", keys=["OperationalLimit.OperationalLimitSet", "OperationalLimit.OperationalLimitType", "CurrentLimit.value", TYPE]), ("ID", "limit_id"), ("OperationalLimit.OperationalLimitSet", "set_id"), ("OperationalLimit.OperationalLimitType", "type_id"), ("CurrentLimit.value", "value"), (TYPE, "limit_class"))
    types = named(type_tableview(data, "OperationalLimitType", keys=["IdentifiedObject.name"]), ("ID", "type_id"), ("IdentifiedObject.name", "type_name"))
    terminals = named(type_tableview(data, "Terminal", keys=["Terminal.ConductingEquipment"]), ("ID", "terminal_id"), ("Terminal.ConductingEquipment", "terminal_equipment"))
    classes = data.where(F.col("KEY") == TYPE).select(F.col("ID").alias("ID_Equipment"), F.col("VALUE").alias("Equipment_Type"))
    rows = sets.join(own, "set_id").join(types, "type_id").join(terminals, "terminal_id", "left" if keep_without_terminal else "inner")
    return rows.withColumn("ID_Equipment", F.coalesce("terminal_equipment", "set_equipment")).join(classes, "ID_Equipment")


def switch_terminals(data: DataFrame, equipment, connected: str = "false") -> DataFrame:
    """Sets the connection status of the terminals of some equipment, in the instance that holds the status."""
    if connected not in ("true", "false"):
        raise ValueError("connected is 'true' or 'false'")
    ids = [equipment] if isinstance(equipment, str) else list(equipment)
    terminals = data.where((F.col("KEY") == "Terminal.ConductingEquipment") & F.col("VALUE").isin(ids)).select("ID")
    status = data.where(F.col("KEY") == "ACDCTerminal.connected").join(terminals, "ID", "left_semi")
    return update_from_facts(data, status.select("ID", "KEY", F.lit(connected).alias("VALUE"), "INSTANCE_ID", ORDER), update=True, add=False)


def scale_load(data: DataFrame, setpoint: float, cos_f: float | None = None, conform: str = "ConformLoad", other: str = "NonConformLoad", p: str = "EnergyConsumer.p", q: str = "EnergyConsumer.q") -> DataFrame:
    """Scales the power of conform loads so that all loads add up to a set point; the others stay as they are."""
    number = lambda c: F.col(f"`{c}`").try_cast("double")
    loads = type_tableview(data, conform, keys=[p, q])
    sums = loads.agg(F.sum(number(p)).alias("p"), F.sum(number(q)).alias("q")).first()
    rest = type_tableview(data, other, keys=[p]).agg(F.sum(number(p)).alias("p")).first()["p"] or 0.0
    if not sums["p"]:
        raise ValueError("there is no power to scale")
    tangent = math.sqrt(1 / cos_f**2 - 1) if cos_f is not None else abs((sums["q"] or 0.0) / sums["p"])
    factor = (setpoint - rest) / sums["p"]
    scaled = loads.select("ID", (number(p) * factor).alias(p), (number(p) * factor * tangent).alias(q))
    return update_from_view(data, scaled, update=True, add=False)


def loaded_models(data: DataFrame, profile: str = STATE_VARIABLES) -> DataFrame:
    """(root, ID, PROFILE, INSTANCE_ID): for every model of a profile, all parts it depends on, however indirectly."""
    header = data.where(F.col("KEY").isin("Model.profile", "Model.DependentOn"))
    roots = header.where((F.col("KEY") == "Model.profile") & (F.col("VALUE") == profile))
    reached = dependency_closure(header.where(F.col("KEY") == "Model.DependentOn").select("ID", "VALUE"), roots.select("ID"))
    profiles = header.where(F.col("KEY") == "Model.profile").select("ID", F.col("VALUE").alias("PROFILE"), "INSTANCE_ID").distinct()
    # Both sides are without repeats, so the result is; very many models may depend on one part.
    return joined(written(reached, "closure"), written(profiles, "profiles"), ["ID"]).select("root", "ID", "PROFILE", "INSTANCE_ID")


def model_facts(data: DataFrame, models: DataFrame) -> DataFrame:
    """Facts of the instances that a table of model parts names."""
    return data.join(models.select("INSTANCE_ID").distinct(), "INSTANCE_ID", "left_semi")


def model_parts(data: DataFrame) -> DataFrame:
    return type_tableview(data, "FullModel")


def eic_map(data: DataFrame, name: str) -> DataFrame:
    """mRID and EIC code of the objects of a class."""
    return filter_by_type(data, name).where(F.col("KEY") == "IdentifiedObject.energyIdentCodeEic").select(F.col("ID").alias("mRID"), F.col("VALUE").alias("EIC"))


def filename_fields(name: Column) -> Column:
    """Header fields of a file name of four or five parts, as a struct; null parts where it has other numbers."""
    parts = F.split(F.element_at(F.split(name, r"\."), 1), "_")
    n = F.size(parts)
    at = lambda four, five: F.when(n == 5, F.get(parts, F.lit(five))).when(n == 4, F.lit("") if four is None else F.get(parts, F.lit(four)))
    entity = at(1, 2)
    split = F.split(entity, "-")
    m = F.size(split)
    fields = {
        "Model.scenarioTime": at(0, 0),
        "Model.processType": at(None, 1),
        "Model.modelingEntity": entity,
        "Model.messageType": at(2, 3),
        "Model.version": at(3, 4),
        "Model.mergingEntity": F.when(m == 1, F.lit("")).when(m.isin(2, 3), F.get(split, F.lit(0))),
        "Model.domain": F.when(m == 1, F.lit("")).when(m.isin(2, 3), F.get(split, F.lit(1))),
        "Model.forEntity": F.when(m == 1, F.get(split, F.lit(0))).when(m == 2, F.lit("")).when(m == 3, F.get(split, F.lit(2))),
    }
    return F.struct(*(F.when(entity == "", F.lit(None)).otherwise(v).alias(k) if k in ("Model.mergingEntity", "Model.domain", "Model.forEntity") else v.alias(k) for k, v in fields.items()))


def header_from_filenames(data: DataFrame, update: bool = False, add: bool = True, fields=filename_fields) -> DataFrame:
    """Adds header facts that the file name of an instance tells to its FullModel."""
    labels = data.where(F.col("KEY") == "label").select("INSTANCE_ID", fields(F.col("VALUE")).alias("f"))
    names = [f.name for f in labels.schema["f"].dataType.fields]
    cells = F.array(*(F.struct(F.lit(n).alias("KEY"), F.col(f"f.`{n}`").alias("VALUE")) for n in names))
    models = data.where((F.col("KEY") == TYPE) & (F.col("VALUE") == "FullModel")).select("ID", "INSTANCE_ID")
    changes = models.join(labels, "INSTANCE_ID").select("ID", "INSTANCE_ID", F.inline(cells)).where(F.col("VALUE").isNotNull())
    return update_from_facts(data, changes, update, add)


def filename_of(scenario: Column, process: Column, entity: Column, message: Column, version: Column, file_type: str = "xml") -> Column:
    """A file name from header fields; times are given in UTC."""
    stamp = F.date_format(F.coalesce(F.try_to_timestamp(scenario), F.try_to_timestamp(scenario, F.lit("yyyyMMdd'T'HHmm'Z'"))), "yyyyMMdd'T'HHmm'Z'")
    return F.concat(F.concat_ws("_", stamp, process, entity, message, F.lpad(version.cast("int").cast("string"), 3, "0")), F.lit(f".{file_type}"))


def filenames_from_header(data: DataFrame, key: str = "label") -> DataFrame:
    """Renames every instance's label by what its FullModel says."""
    models = data.join(data.where((F.col("KEY") == TYPE) & (F.col("VALUE") == "FullModel")).select("ID"), "ID", "left_semi")
    cells = [F.min_by(F.when(F.col("KEY") == k, F.col("VALUE")), F.when(F.col("KEY") == k, F.col(ORDER))).alias(k) for k in HEADER]
    header = models.groupBy("INSTANCE_ID").agg(*cells)
    named = header.select("INSTANCE_ID", filename_of(*(F.col(f"`{k}`") for k in HEADER)).alias("VALUE")).where(F.col("VALUE").isNotNull())
    changes = data.where(F.col("KEY") == key).select("ID", "KEY", "INSTANCE_ID", ORDER).join(named, "INSTANCE_ID")
    return update_from_facts(data, changes, update=True, add=False)


def header_of(data: DataFrame) -> dict[str, str]:
    """The header of the one FullModel of a table."""
    rows = filter_by_type(data, "FullModel").select("KEY", "VALUE").collect()  # a header
    return {r["KEY"]: r["VALUE"] for r in rows}


def update_header(data: DataFrame, fields: dict[str, str], update: bool = True, add: bool = False) -> DataFrame:
    """Sets header fields of every FullModel."""
    models = data.where((F.col("KEY") == TYPE) & (F.col("VALUE") == "FullModel")).select("ID", "INSTANCE_ID")
    cells = F.array(*(F.struct(F.lit(k).alias("KEY"), F.lit(v).cast("string").alias("VALUE")) for k, v in fields.items()))
    return update_from_facts(data, models.select("ID", "INSTANCE_ID", F.inline(cells)), update, add)
