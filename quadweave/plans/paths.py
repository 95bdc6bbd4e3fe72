"""Property paths of several steps as facts: the values of a path stand under the path's text as their key.

A path is a property, or one of ("inverse", path), ("sequence", path, path, ...), ("alternative", path, path, ...),
("zero_or_more", path), ("one_or_more", path) and ("zero_or_one", path).  The last three are walked from given starts only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.model import TYPE
from quadweave.operators.reach import reach


# Signs of repeated steps in query texts.
REPEATED = {"zero_or_more": "*", "one_or_more": "+", "zero_or_one": "?"}


def text_of(path: str | tuple) -> str:
    """The path as in query texts: ^a, a/b, (a|b)."""
    if isinstance(path, str):
        return path
    kind, *parts = path
    inner = [text_of(p) for p in parts]
    if kind == "inverse":
        return f"^{inner[0]}" if isinstance(parts[0], str) else f"^({inner[0]})"
    if kind in REPEATED:
        return f"{inner[0] if isinstance(parts[0], str) or parts[0][0] == 'alternative' else f'({inner[0]})'}{REPEATED[kind]}"
    return "/".join(inner) if kind == "sequence" else f"({'|'.join(inner)})"


def repeats(path: str | tuple) -> bool:
    """Whether a path has steps that are repeated, or may be left out."""
    return not isinstance(path, str) and (path[0] in REPEATED or any(map(repeats, path[1:])))


def ends_in_type(path: str | tuple) -> bool:
    """Whether all values of a path are classes."""
    if isinstance(path, str):
        return path == TYPE
    if path[0] in REPEATED:
        return False  # the start itself is a value, or may lie in between
    return {"inverse": lambda p: False, "sequence": lambda p: ends_in_type(p[-1]), "alternative": lambda p: all(map(ends_in_type, p))}[path[0]](path[1:])


def _turned(path: str | tuple) -> str | tuple:
    """The path taken backwards."""
    if isinstance(path, str):
        return ("inverse", path)
    kind, *parts = path
    if kind == "inverse":
        return parts[0]
    return (kind, *(_turned(p) for p in (reversed(parts) if kind == "sequence" else parts)))


def pairs(data: DataFrame, path: str | tuple, within: Sequence[str] = (), starts: DataFrame | None = None) -> DataFrame:
    """(ID, VALUE, *within) for each value of a path, once; a reference to an object without facts ends a sequence.

    Steps stay among facts that agree in the columns `within`.  starts (ID, *within): the objects that are asked for; of a path with repeated
    steps nothing else is walked."""
    if isinstance(path, str):
        return data.where(F.col("KEY") == path).select("ID", "VALUE", *within).distinct()
    if not repeats(path):
        starts = None
    kind, *parts = path
    if kind == "inverse":
        if repeats(parts[0]):
            return pairs(data, _turned(parts[0]), within, starts)
        return pairs(data, parts[0], within).select(F.col("VALUE").alias("ID"), F.col("ID").alias("VALUE"), *within)
    if kind in REPEATED:
        if starts is None:
            raise ValueError(f"{text_of(path)} is walked from given objects only")
        return _repeated(kind, pairs(data, parts[0], within), starts, list(within))
    if kind == "alternative":
        return reduce(DataFrame.unionByName, (pairs(data, p, within, starts) for p in parts)).distinct()
    found = pairs(data, parts[0], within, starts)
    for p in parts[1:]:
        middle = found.select(F.col("VALUE").alias("ID"), *within).distinct() if repeats(p) else None
        step = pairs(data, p, within, middle)
        found = found.withColumnRenamed("VALUE", "over").join(step.withColumnRenamed("ID", "over"), ["over", *within]).select("ID", "VALUE", *within).distinct()
    return found


def _repeated(kind: str, links: DataFrame, starts: DataFrame, within: list[str]) -> DataFrame:
    """Walks over links (ID, VALUE, *within) from starts; names carry the columns `within`, so that a walk stays where it began."""
    name = lambda c: F.to_json(F.struct(F.col(c).alias("name"), *within)) if within else F.col(c)
    own = starts.select(name("ID").alias("s")).distinct()
    steps = links.select(name("ID").alias("s"), name("VALUE").alias("o"))
    found = zero_or_one(own, steps) if kind == "zero_or_one" else reach(steps, own, zero=kind == "zero_or_more")
    part = lambda c, f: F.get_json_object(c, f"$.{f}") if within else F.col(c)
    return found.select(part("s", "name").alias("ID"), part("o", "name").alias("VALUE"), *(part("s", c).alias(c) for c in within))


def zero_or_one(starts: DataFrame, links: DataFrame) -> DataFrame:
    return links.join(starts, "s", "left_semi").unionByName(starts.select("s", F.col("s").alias("o"))).distinct()


def facts(data: DataFrame, paths: list[str | tuple], within: Sequence[str] = (), starts: DataFrame | None = None) -> DataFrame:
    """(ID, KEY, VALUE, *within) of all paths; see `pairs`."""
    return reduce(DataFrame.unionByName, (pairs(data, p, within, starts).select("ID", F.lit(text_of(p)).alias("KEY"), "VALUE", *within) for p in paths))
