"""Graph patterns as DataFrames: bindings of variables, one column each.

There is no query language here: a pattern is a list of (subject, property, value) in which names that begin
with ? are variables, and everything after it is DataFrame work on the bindings.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave.operators.reach import reach
from quadweave.operators.tableview import NUMBER
from quadweave.plans import paths


def _is_variable(term) -> bool:
    return isinstance(term, str) and term.startswith("?")


def pattern(data: DataFrame, subject: str, key: str, value: str, instance: str | None = None) -> DataFrame:
    """Bindings of one pattern; a variable that occurs twice has to have the same value, and none is left unbound."""
    terms = {"ID": subject, "KEY": key, "VALUE": value} | ({"INSTANCE_ID": instance} if instance is not None else {})
    rows, places = data, {}
    for column, term in terms.items():
        if not _is_variable(term):
            rows = rows.where(F.col(column) == term)
        elif term[1:] in places:
            rows = rows.where(F.col(column) == F.col(places[term[1:]]))
        else:
            places[term[1:]] = column
    found = rows.select(*(F.col(c).alias(v) for v, c in places.items())).distinct()
    return found.where(reduce(lambda a, b: a & b, (F.col(v).isNotNull() for v in places))) if places else found


def match(data: DataFrame, patterns: list[tuple], instance: str | None = None) -> DataFrame:
    """Bindings of all patterns together: those with most constants first, each next shares a variable if one can."""
    left = sorted(patterns, key=lambda p: sum(map(_is_variable, p)))
    found = pattern(data, *left.pop(0), instance=instance)
    while left:
        nearest = next((p for p in left if any(_is_variable(t) and t[1:] in found.columns for t in p)), None)
        if nearest is None:
            raise ValueError("patterns that share no variable are not joined")
        left.remove(nearest)
        more = pattern(data, *nearest, instance=instance)
        found = found.join(more, [c for c in more.columns if c in found.columns])
    return found


def union(*found: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def _shared(found: DataFrame, more: DataFrame) -> list[str]:
    return [c for c in more.columns if c in found.columns]


def _open(df: DataFrame, names: list[str]) -> list[str]:
    """Those of some variables that the plan cannot prove to be bound."""
    return [f.name for f in df.schema.fields if f.name in names and f.nullable]


def _split(df: DataFrame, names: list[str], most: int = 2) -> list[tuple[frozenset[str], DataFrame]]:
    """The table by which of some variables are unbound; of more than `most` a job finds which sets occur."""
    if not names:
        return [(frozenset(), df)]
    if len(names) <= most:
        sets = [frozenset(c) for n in range(len(names) + 1) for c in combinations(names, n)]
    else:
        rows = df.select(*(F.col(c).isNull().alias(c) for c in names)).distinct().collect()  # 2 to the number of variables at most
        sets = [frozenset(c for c in names if r[c]) for r in rows]
    is_ = lambda unbound: reduce(lambda a, b: a & b, [F.col(c).isNull() if c in unbound else F.col(c).isNotNull() for c in names])
    return [(unbound, df.where(is_(unbound))) for unbound in sets]


def _sides(found: DataFrame, more: DataFrame) -> list[tuple[DataFrame, list[tuple[list[str], DataFrame]]]]:
    """Parts of found, each with the parts of more and the variables that are bound in both, on which alone they have to agree."""
    shared = _shared(found, more)
    rights = _split(more, _open(more, shared))
    return [(left, [([c for c in shared if c not in no and c not in nor], right) for nor, right in rights]) for no, left in _split(found, _open(found, shared))]


def join(found: DataFrame, more: DataFrame) -> DataFrame:
    """Bindings of both that agree wherever both are bound; an unbound variable fits any value and takes it.

    Rows that have no variable bound in common are not joined: such a pair is an error."""
    shared = _shared(found, more)
    if not shared:
        raise ValueError("patterns that share no variable are not joined")
    out = []
    for left, rights in _sides(found, more):
        for keys, right in rights:
            if len(keys) == len(shared):
                out.append(left.join(right, keys).select(*found.columns, *(c for c in more.columns if c not in shared)))
                continue
            renamed = right.select(*(F.col(c).alias(f"__{c}") if c in shared else F.col(c) for c in more.columns))
            if keys:
                joined = left.join(renamed, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{c}") for c in keys]))
            else:  # one row of each side, if there is one, makes it an error
                said = F.concat_ws("", F.lit("bindings that have no variable bound in common are not joined"), F.substring(shared[0], 1, 0), F.substring(f"__{shared[0]}", 1, 0))
                joined = left.limit(1).join(F.broadcast(renamed.limit(1)), F.raise_error(said).cast("boolean"))
            out.append(joined.select(*(F.coalesce(c, f"__{c}").alias(c) if c in shared else F.col(c) for c in found.columns), *(c for c in more.columns if c not in shared)))
    return reduce(DataFrame.unionByName, out)


def _with_counterpart(found: DataFrame, more: DataFrame, kept: bool, disjoint: bool) -> DataFrame:
    """Bindings that have a compatible counterpart, or those that have none; `disjoint`: whether one without a common variable is one."""
    shared = _shared(found, more)
    if not shared or not (_open(found, shared) or _open(more, shared)):
        if shared:
            return found.join(more, shared, "left_semi" if kept else "left_anti")
        return found.join(F.broadcast(more.limit(1)), F.lit(True), "left_semi" if kept else "left_anti") if disjoint else (found.limit(0) if kept else found)
    out = []
    for left, rights in _sides(found, more):
        flags = []
        for i, (keys, right) in enumerate(rights):
            if not keys and not disjoint:
                continue
            flag = f"__there{i}"
            flags.append(flag)
            if keys:
                left = left.join(right.select(*keys).distinct().withColumn(flag, F.lit(True)), keys, "left")
            else:
                left = left.join(F.broadcast(right.limit(1).select(F.lit(True).alias(flag))), F.lit(True), "left")
        there = F.coalesce(*flags, F.lit(False)) if flags else F.lit(False)
        out.append(left.where(there if kept else ~there).select(*found.columns))
    return reduce(DataFrame.unionByName, out)


def optional(found: DataFrame, more: DataFrame) -> DataFrame:
    """Bindings joined as by `join`, and those without a counterpart as they are."""
    shared = _shared(found, more)
    if not shared:
        raise ValueError("patterns that share no variable are not joined")
    if not (_open(found, shared) or _open(more, shared)):
        return found.join(more, shared, "left").select(*found.columns, *(c for c in more.columns if c not in shared))
    return join(found, more).unionByName(_with_counterpart(found, more, False, True), allowMissingColumns=True)


def exists(found: DataFrame, more: DataFrame) -> DataFrame:
    """Bindings with a counterpart that agrees wherever both are bound; without a common variable any row at all is one."""
    return _with_counterpart(found, more, True, True)


def not_exists(found: DataFrame, more: DataFrame) -> DataFrame:
    """Bindings without such a counterpart."""
    return _with_counterpart(found, more, False, True)


def minus(found: DataFrame, more: DataFrame) -> DataFrame:
    """Like not_exists, but rows that have no variable bound in common take nothing away."""
    return _with_counterpart(found, more, False, False)


def values(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """Bindings that are given."""
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))


def number(column: str) -> Column:
    """A binding as a double; null unless it is written as a number."""
    return F.when(F.col(column).rlike(NUMBER), F.col(column).try_cast("double"))


def path(data: DataFrame, keys: list[str], subject: str = "s", value: str = "o", inverse: bool = False) -> DataFrame:
    """Links over any of some properties, in either direction."""
    ends = (value, subject) if inverse else (subject, value)
    return data.where(F.col("KEY").isin(keys)).select(F.col("ID").alias(ends[0]), F.col("VALUE").alias(ends[1])).distinct()


def sequence(first: DataFrame, second: DataFrame) -> DataFrame:
    """Links (s, o) over two steps."""
    return first.select("s", F.col("o").alias("m")).join(second.select(F.col("s").alias("m"), "o"), "m").select("s", "o").distinct()


def one_or_more(links: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(s, o) over one or more links (s, o), from the bindings of s in `starts`, or from everywhere.

    The whole closure of long chains is quadratic; what grows from starts is not."""
    return reach(links, links if starts is None else starts)


def zero_or_more(data: DataFrame, links: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """The closure with every start reaching itself; without starts, every object of the graph is one."""
    return reach(links, data.select(F.col("ID").alias("s")) if starts is None else starts, zero=True)


def zero_or_one(data: DataFrame, links: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """At most one link, with every start reaching itself; without starts, every object of the graph is one."""
    own = (data.select(F.col("ID").alias("s")) if starts is None else starts.select("s")).distinct()
    return paths.zero_or_one(own, links.select("s", "o"))


def reversed_links(links: DataFrame) -> DataFrame:
    """(s, o) of links taken backwards: closures that are bound at their end start there."""
    return links.select(F.col("o").alias("s"), F.col("s").alias("o"))


def negated(data: DataFrame, keys: list[str], inverse_keys: list[str] | None = None) -> DataFrame:
    """Links (s, o) over any property but some; with inverse_keys also those taken backwards, but for these."""
    rows = data.where(F.col("VALUE").isNotNull())
    other = lambda but: rows.where(~F.col("KEY").isin(but)) if but else rows
    found = other(list(keys)).select(F.col("ID").alias("s"), F.col("VALUE").alias("o")) if keys or inverse_keys is None else None
    back = other(list(inverse_keys)).select(F.col("VALUE").alias("s"), F.col("ID").alias("o")) if inverse_keys is not None else None
    return reduce(DataFrame.unionByName, [p for p in (found, back) if p is not None]).distinct()


def construct(found: DataFrame, template: list[tuple]) -> DataFrame:
    """Facts by a template of variables and constants; those with an unbound part are left out."""
    term = lambda t: F.col(t[1:]) if _is_variable(t) else F.lit(t)
    parts = [F.struct(term(s).alias("ID"), term(k).alias("KEY"), term(v).alias("VALUE")) for s, k, v in template]
    return found.select(F.inline(F.array(*parts))).where(F.col("ID").isNotNull() & F.col("KEY").isNotNull() & F.col("VALUE").isNotNull()).distinct()


def describe(data: DataFrame, found: DataFrame, variable: str, blank: Column | None = None) -> DataFrame:
    """All facts of the objects that a variable is bound to, and of the blank nodes behind them, however deep.

    blank: which VALUEs are blank nodes (those written _:name, if nothing else is said); a walk goes on through these alone."""
    is_blank = F.col("VALUE").startswith("_:") if blank is None else blank
    starts = found.select(F.col(variable).alias("s")).where("s is not null").distinct()
    links = data.where(is_blank).select(F.col("ID").alias("s"), F.col("VALUE").alias("o"))
    wanted = reach(links, starts, zero=True).select(F.col("o").alias("ID")).distinct()
    return data.join(wanted, "ID", "left_semi")


def ask(found: DataFrame) -> bool:
    return not found.isEmpty()
