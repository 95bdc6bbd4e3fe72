"""Profiles that instances declare in their headers, and the validation of every instance against its own.

A profile is a declared schema with names by which headers may call it.  Headers give hints: values of `HEADER_KEYS`, ranked by key
and then by load order.  A hint that is a name of exactly one profile declares it; where no hint of an instance is one, parts of
profile names of the older edition count.  Matching is one join of the hints with the table of names; validation is one run of all rules, in
which instance and profile are keys (see `shapes`), so that profiles are never merged and instances never mixed.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadweave.model import ORDER
from quadweave.plans.shapes import Rule, rules_of_schema, validate

# Header properties that name a profile, most telling first.
HEADER_KEYS = ("Model.messageType", "keyword", "Model.profile", "conformsTo")
# Parts of profile names of the older edition, and the profile each stands for.
OLDER_NAMES = {
    "EquipmentCore": "EQ",
    "EquipmentOperation": "EQ",
    "EquipmentShortCircuit": "EQ",
    "SteadyState": "SSH",
    "StateVariables": "SV",
    "Topology/": "TP",
    "EquipmentBoundary": "EQBD",
    "TopologyBoundary": "TPBD",
    "DiagramLayout": "DL",
    "Dynamics": "DY",
    "GeographicalLocation": "GL",
    "FileHeader": "FH",
}


@dataclass(frozen=True)
class Profile:
    """A declared schema, {class: {property: {min, max, datatype, range, in}}}, and the names that headers use for it."""

    name: str
    classes: dict[str, dict[str, dict]] = field(default_factory=dict)
    keyword: str | None = None
    version: str | None = None
    conforms_to: str | None = None

    @property
    def names(self) -> set[str]:
        return {n for n in (self.name, self.keyword, self.version, self.conforms_to) if n}


def names_of(profiles: list[Profile]) -> dict[str, str]:
    """The profile behind each name; a name that several profiles share tells none of them."""
    owners: dict[str, set[str]] = {}
    for p in profiles:
        for name in p.names:
            owners.setdefault(name, set()).add(p.name)
    return {name: next(iter(of)) for name, of in owners.items() if len(of) == 1}


def hints(data: DataFrame) -> DataFrame:
    """(INSTANCE_ID, hint, place): what headers say of their profile; the smaller place counts for more."""
    rank = F.array_position(F.array(*(F.lit(k) for k in HEADER_KEYS)), F.col("KEY"))
    rows = data.where(F.col("KEY").isin(*HEADER_KEYS) & F.col("VALUE").isNotNull())
    return rows.select("INSTANCE_ID", F.col("VALUE").alias("hint"), F.struct(rank.alias("rank"), F.col(ORDER).alias("ord")).alias("place"))


def declared(data: DataFrame, profiles: list[Profile]) -> DataFrame:
    """(INSTANCE_ID, PROFILE, place) for every profile that an instance declares."""
    spark, own = data.sparkSession, {p.name for p in profiles}
    said = hints(data)
    names = spark.createDataFrame(sorted(names_of(profiles).items()), "hint string, PROFILE string")
    place = lambda part: F.struct("place.rank", "place.ord", part.alias("part"))
    exact = said.join(F.broadcast(names), "hint").select("INSTANCE_ID", "PROFILE", place(F.lit(0)).alias("place"))
    others = said.join(exact.select("INSTANCE_ID").distinct(), "INSTANCE_ID", "left_anti")
    older = [F.when(F.contains("hint", F.lit(part)), F.struct(F.lit(i).alias("part"), F.lit(name).alias("PROFILE"))) for i, (part, name) in enumerate(OLDER_NAMES.items()) if name in own]
    found = others.select("INSTANCE_ID", "place", F.explode(F.array_compact(F.array(*older))).alias("o")) if older else None
    rows = exact if found is None else exact.unionByName(found.select("INSTANCE_ID", "o.PROFILE", place(F.col("o.part")).alias("place")))
    return rows.groupBy("INSTANCE_ID", "PROFILE").agg(F.min("place").alias("place"))


def resolved(data: DataFrame, profiles: list[Profile]) -> DataFrame:
    """(INSTANCE_ID, FILE_NAME, PROFILE) of every instance: its first label, and the profile its best hint declares; null where nothing does."""
    label = F.when(F.col("KEY") == "label", F.col("VALUE"))
    instances = data.groupBy("INSTANCE_ID").agg(F.min_by(label, F.when(label.isNotNull(), F.col(ORDER))).alias("FILE_NAME"))
    best = declared(data, profiles).groupBy("INSTANCE_ID").agg(F.min_by("PROFILE", "place").alias("PROFILE"))
    return instances.join(best, "INSTANCE_ID", "left").select("INSTANCE_ID", "FILE_NAME", "PROFILE")


def undeclared(data: DataFrame, profiles: list[Profile], most: int = 4) -> DataFrame:
    """(INSTANCE_ID, HINTS) of instances without a profile, with their `most` best hints."""
    instances = data.select("INSTANCE_ID").distinct().join(declared(data, profiles).select("INSTANCE_ID").distinct(), "INSTANCE_ID", "left_anti")
    first = hints(data).withColumn("n", F.row_number().over(Window.partitionBy("INSTANCE_ID").orderBy("place"))).where(F.col("n") <= most)
    listed = first.groupBy("INSTANCE_ID").agg(F.array_sort(F.collect_list(F.struct("place", "hint"))).alias("h"))
    return instances.join(listed, "INSTANCE_ID", "left").select("INSTANCE_ID", F.coalesce(F.transform("h", lambda h: h["hint"]), F.array().cast("array<string>")).alias("HINTS"))


def largest_per_keyword(sizes: DataFrame) -> DataFrame:
    """(keyword, profile, size) of the largest of the profiles (keyword, profile, size) that share a keyword; ties to the smaller name.

    Keywords are freed of underscores; profiles without one are left out."""
    largest = sizes.where("keyword is not null").groupBy("keyword").agg(F.min_by(F.struct("profile", "size"), F.struct(-F.col("size"), F.col("profile"))).alias("best"))
    return largest.select(F.replace("keyword", F.lit("_"), F.lit("")).alias("keyword"), "best.profile", "best.size")


def rules_of_profiles(profiles: list[Profile], closed: bool = False) -> list[Rule]:
    return [replace(rule, profile=p.name) for p in profiles for rule in rules_of_schema(p.classes, closed)]


def validate_profiles(data: DataFrame, profiles: list[Profile], chosen: list[str] | None = None, closed: bool = False, lexical: bool = True) -> DataFrame:
    """Violations with INSTANCE_ID and PROFILE: every instance against each profile that it declares, by itself.

    chosen: names of profiles (any that headers may use) that every instance is held against instead."""
    if chosen is None:
        pairs = declared(data, profiles).select("INSTANCE_ID", "PROFILE")
    else:
        names = names_of(profiles)
        if missing := [c for c in chosen if c not in names]:
            raise ValueError(f"no profile is called {', '.join(missing)}; there are {', '.join(sorted(p.name for p in profiles))}")
        wanted = F.array(*(F.lit(n) for n in dict.fromkeys(names[c] for c in chosen)))
        pairs = data.select("INSTANCE_ID").distinct().select("INSTANCE_ID", F.explode(wanted).alias("PROFILE"))
    return validate(data, rules_of_profiles(profiles, closed), lexical=lexical, pairs=pairs)
