"""Constraints as data: all rules are checked in a few joins, however many there are.

A rule names the objects it is for (a class, or those with a property), a property path and a condition.  The
rules are a small table; values meet them by property and class, in one plan for all conditions on single
values, and one each for counts, sets, pairs and closed classes.  Rules with parts (and, or, not, xone, node, qualified
counts) are data as well: all of one depth are combined in one step from what was found a level deeper, innermost first, and what
is found is written between levels, so that a plan grows with the depth of nesting and not with the number of rules.  Which parts of and, or,
not and xone an object fails is kept in the bits of a few words, not as a row for each part.

With `pairs` of instances and profiles, both are further keys of every join: facts meet only facts of their instance, and only the
rules of the profiles that it is paired with, all in the one run.
"""

from __future__ import annotations

from copy import copy
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadweave.functions.rdfs import descriptions
from quadweave.model import TYPE
from quadweave.operators.filters import in_scope
from quadweave.operators.hot import joined
from quadweave.operators.tableview import NUMBER
from quadweave.plans import paths
from quadweave.steps import tasks_for, written

VIOLATIONS = ("ID", "KEY", "VALUE", "VIOLATION_TYPE", "MESSAGE", "SEVERITY", "SOURCE_SHAPE")
#: Rules up to which their table is broadcast.
BROADCAST_RULES = 50_000
VALUE_COMPONENTS = ("datatype", "pattern", "minLength", "maxLength", "minInclusive", "maxInclusive", "minExclusive", "maxExclusive", "in", "nodeKind")
QUALIFIED = ("qualifiedMinCount", "qualifiedMaxCount")
#: Rules whose parts are for the values of their path, not for their own objects.
NESTS = ("node", *QUALIFIED)
BOOLEAN = ("and", "or", "not", "xone")
PARTS = (*BOOLEAN, *NESTS)
#: Parts that one word holds; the sign is left out.
WORD = 63

# Lexical forms of the XSD types, and the narrower form that is worth a warning.
_INTEGER = "[+-]?[0-9]+"
_DECIMAL = rf"(?:{_INTEGER}|[+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+))"
_FLOAT = rf"(?:{_DECIMAL}(?:[eE][+-]?[0-9]+)?|[+-]?INF|NaN)"
_DATE = "-?[0-9]{4,}-[0-9]{2}-[0-9]{2}"
_ZONE = "(?:Z|[+-][0-9]{2}:[0-9]{2})?"
LEXICAL = {
    **dict.fromkeys(("integer", "int", "long", "short", "byte"), (_INTEGER, None)),
    "nonNegativeInteger": (r"\+?[0-9]+", None),
    "positiveInteger": (r"\+?0*[1-9][0-9]*", None),
    "decimal": (_DECIMAL, _INTEGER),
    "float": (_FLOAT, _INTEGER),
    "double": (_FLOAT, _INTEGER),
    "boolean": ("true|false|1|0", "1|0"),
    "date": (_DATE + _ZONE, None),
    "dateTime": (rf"{_DATE}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(?:\.[0-9]+)?{_ZONE}", None),
}
REFERENCE_LIKE = r"^(?:[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|\w+://\S+|urn:\S+|[A-Za-z]\w*\.\w+)\z"


@dataclass(frozen=True)
class Rule:
    """One condition of a shape.  `parent` names the rule it is a part of, `alternative` which part; `profile` is the one it belongs to.

    Parts of `node` and of qualified counts have the target "nodes of <label>".  The `values` of a qualified count name rules whose
    shapes claim values before it.

    `target` is a class, or (as flags tell) a property whose subjects or objects are meant, or one object.  `way` is a path of
    several steps (see `paths`), whose text is then the rule's `path`."""

    shape: str
    component: str
    target: str
    path: str | None = None
    value: str | float | None = None
    values: tuple[str, ...] = ()
    inverse: bool = False
    subjects_of: bool = False
    objects_of: bool = False
    target_node: bool = False
    severity: str = "Violation"
    message: str | None = None
    parent: str | None = None
    alternative: int = 0
    name: str | None = None
    way: tuple | None = None
    shape_name: str | None = None
    shape_description: str | None = None
    profile: str | None = None

    @property
    def label(self) -> str:
        """What parts refer to as their parent."""
        return self.name or f"{self.shape}|{self.component}|{self.path}"


_RULES = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("shape", "component", "target", "path", "text", "severity", "message", "parent", "label", "PROFILE")]
    + [T.StructField("number", T.DoubleType()), T.StructField("items", T.ArrayType(T.StringType())), *(T.StructField(n, T.BooleanType()) for n in ("inverse", "packed", "loose"))]
    + [T.StructField(n, T.IntegerType()) for n in ("depth", "alternatives", "rule")]
)


def _number(value) -> float | None:
    try:
        return None if value is None else float(value)
    except ValueError:
        return None


def _target(r: Rule) -> str:
    flags = {"subjects of": r.subjects_of, "objects of": r.objects_of, "node": r.target_node}
    return next((f"{said} {r.target}" for said, on in flags.items() if on), r.target)


def _row(i: int, r: Rule, depth: int, alternatives: int, packed: bool, loose: bool):
    text = None if r.value is None else str(r.value)
    items = list(r.values)
    if r.component == "datatype":
        text, narrow = LEXICAL.get(str(r.value), (None, None))
        items = [narrow] if narrow else []
        text = rf"^(?:{text})\z" if text else None
    return (r.shape, r.component, _target(r), r.path, text, r.severity, r.message, r.parent, r.label, r.profile, _number(r.value), items, r.inverse, packed, loose, depth, alternatives, i)


def _as_number(c: Column) -> Column:
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def _readings() -> dict[str, Column]:
    """What conditions ask of a value, told once for all rules that it meets."""
    return {"as_number": _as_number(F.col("VALUE")), "last_part": F.expr("substring_index(substring_index(VALUE, '#', -1), '/', -1)")}


def _fails() -> Column:
    """Whether a value, with what `_readings` gives of it, fails the single-value condition that stands next to it."""
    value, is_ = F.col("VALUE"), F.col("component")
    n = F.col("as_number")
    reference = value.rlike(REFERENCE_LIKE) | F.col("known")
    checks = {
        "datatype": ~F.expr("VALUE rlike text"),
        "pattern": ~F.expr("VALUE rlike text"),
        "minLength": F.length(value) < F.col("number"),
        "maxLength": F.length(value) > F.col("number"),
        "minInclusive": n < F.col("number"),
        "maxInclusive": n > F.col("number"),
        "minExclusive": n <= F.col("number"),
        "maxExclusive": n >= F.col("number"),
        "in": ~F.expr("array_contains(items, last_part)"),
        "nodeKind": F.when(F.col("text") == "IRI", ~reference).otherwise(reference),
    }
    chain = None
    for name, check in checks.items():
        chain = F.when(is_ == name, check) if chain is None else chain.when(is_ == name, check)
    return F.coalesce(chain, F.lit(False))


def _depths(rules: list[Rule]) -> list[int]:
    """How many rules with parts stand around each rule."""
    outer = {r.label: r.parent for r in rules if r.component in PARTS}
    known: dict[str | None, int] = {}

    def depth(label: str | None) -> int:
        chain, seen = [], set()
        while label in outer and label not in known:
            if label in seen:
                raise ValueError(f"rule {label} is a part of itself")
            seen.add(label)
            chain.append(label)
            label = outer[label]
        base = known.get(label, 0)
        for inner in reversed(chain):
            base += 1
            known[inner] = base
        return base

    return [depth(r.parent) for r in rules]


class _Run:
    """The plans of one validation; every one gives (rule, scope, ID, KEY, VALUE, kind)."""

    def __init__(self, data: DataFrame, rules: list[Rule], lexical: bool, pairs: DataFrame | None = None):
        spark = data.sparkSession
        #: Keys that facts share, and that a focus has besides its ID.
        self.instance = ["INSTANCE_ID"] if pairs is not None else []
        self.scope = ["INSTANCE_ID", "PROFILE"] if pairs is not None else []
        self.data = data.select("ID", "KEY", "VALUE", *self.instance).where(F.col("VALUE").isNotNull())
        #: Tasks among which facts and objects are dealt; 0 where they are so few that it is left to Spark.
        self.tasks = tasks_for(self.data)
        self.rules, self.lexical = rules, lexical
        depths, parts = _depths(rules), {}
        for i, r in enumerate(rules):
            if r.component in PARTS:
                parts.setdefault(r.label, ([], set()))[0].append(i)
        for r in rules:
            if r.parent in parts:
                parts[r.parent][1].add(r.alternative)
        self.deepest = max((d for d, r in zip(depths, rules, strict=True) if r.component in PARTS), default=-1)
        outer = [{rules[p].component in BOOLEAN for p in parts[r.parent][0]} if r.parent in parts else set() for r in rules]
        #: Rules that are parts of and, or, not and xone, and those that stand by themselves or are parts of others; some are both.
        self.packed = [r for r, of in zip(rules, outer, strict=True) if True in of]
        self.loose = [r for r, of in zip(rules, outer, strict=True) if not of or False in of]
        rows = [_row(i, r, depth, len(parts[r.label][1]) if r.component in PARTS else 0, True in of, not of or False in of) for i, (r, depth, of) in enumerate(zip(rules, depths, outer, strict=True))]
        table = spark.createDataFrame(rows, _RULES)
        self.table = self.sized(table if pairs is not None else table.drop("PROFILE"), len(rows))
        rows = [(i, parent, r.alternative, depths[parent]) for i, r in enumerate(rules) if r.parent in parts for parent in parts[r.parent][0] if rules[parent].component in NESTS]
        self.parts = self.sized(spark.createDataFrame(rows, "rule int, parent int, alternative int, of_depth int"), len(rows))
        self.deal(depths, parts, pairs is not None)
        typed = self.data.where(F.col("KEY") == TYPE).select("ID", F.col("VALUE").alias("target"), *self.instance)
        for said, column, keys in (("subjects of ", "ID", {r.target for r in rules if r.subjects_of}), ("objects of ", "VALUE", {r.target for r in rules if r.objects_of})):
            if keys:
                typed = typed.unionByName(self.data.where(F.col("KEY").isin(sorted(keys))).select(F.col(column).alias("ID"), F.concat(F.lit(said), "KEY").alias("target"), *self.instance))
        nodes = sorted({r.target for r in rules if r.target_node})
        if nodes:
            named = spark.createDataFrame([(n, f"node {n}") for n in nodes], "ID string, target string")
            typed = typed.unionByName(named.join(self.data.select("ID", *self.instance).distinct(), "ID") if self.instance else named)
        if pairs is None:
            self.members = self.dealt(typed).distinct()
        else:
            self.members = self.dealt(typed.distinct().join(pairs.select("INSTANCE_ID", "PROFILE").distinct(), "INSTANCE_ID"))
        #: Values of rules with nested shapes, by depth.
        self.nested: dict[int, DataFrame] = {}
        ways = self.ways = {r.path: r.way for r in rules if r.way}
        self.walked = sorted({_target(r) for r in rules if r.way and paths.repeats(r.way)})
        self.walk()
        self.to_classes = sorted(name for name, way in ways.items() if paths.ends_in_type(way))

    @staticmethod
    def sized(table: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(table) if rows <= BROADCAST_RULES else table

    def dealt(self, table: DataFrame, *keys: str) -> DataFrame:
        """The table in `tasks` parts, by objects or other keys: what stays with its object is joined and counted where it is."""
        return table.repartition(self.tasks, *(keys or ("ID", *self.instance))) if self.tasks else table

    def built(self, table: DataFrame) -> DataFrame:
        """A dealt side of a join that has few rows a key: the other side streams past it and is not sorted."""
        return table.hint("shuffle_hash") if self.tasks else table

    def deal(self, depths: list[int], parts: dict, profiles: bool) -> None:
        """Deals a bit to each alternative of each rule with and, or, not or xone; a word is for rules of one target and depth."""
        words, masks, bits, at = [], [], {}, {}
        for i, r in enumerate(self.rules):
            if r.component not in BOOLEAN:
                continue
            own, mask = (_target(r), r.profile, depths[i]), {}
            alternatives = sorted(parts[r.label][1])
            if own not in at or at[own][1] + len(alternatives) > WORD:
                at[own] = (len(words), 0)
                words.append((len(words), *own))
            mask[at[own][0]] = 0
            for a in alternatives:
                if at[own][1] == WORD:
                    at[own] = (len(words), 0)
                    words.append((len(words), *own))
                word, place = at[own]
                bits.setdefault((r.label, a), []).append((word, 1 << place))
                mask[word] = mask.get(word, 0) | 1 << place
                at[own] = (word, place + 1)
            masks += [(i, word, m, r.component, len(alternatives), len(mask)) for word, m in mask.items()]
        #: Depths with rules that are told by words; those with rules whose parts take several words.
        self.word_depths = {w[-1] for w in words}
        self.wide_depths = {depths[m[0]] for m in masks if m[-1] > 1}
        spark = self.data.sparkSession
        table = spark.createDataFrame(words, "word int, target string, PROFILE string, depth int")
        self.words = self.sized(table if profiles else table.drop("PROFILE"), len(words))
        self.masks = self.sized(spark.createDataFrame(masks, "rule int, word int, mask bigint, component string, alternatives int, spans int"), len(masks))
        rows = [(i, word, bit) for i, r in enumerate(self.rules) for word, bit in bits.get((r.parent, r.alternative), ())]
        self.bits = self.sized(spark.createDataFrame(rows, "rule int, word int, bit bigint"), len(rows))

    def only(self, flag: str) -> _Run:
        """The same with the rules that are packed, or those that are loose."""
        own = copy(self)
        own.rules, own.table = getattr(self, flag), self.table.where(flag)
        return own

    def of(self, *components: str) -> DataFrame:
        return self.table.where(F.col("component").isin(list(components)))

    def has(self, *components: str) -> bool:
        return any(r.component in components for r in self.rules)

    def focus(self, rules: DataFrame) -> DataFrame:
        """Objects that rules are for, with the rules' columns."""
        return self.members.join(rules, ["target", *self.scope[1:]])

    def values(self, rules: DataFrame, readings: dict[str, Column] | None = None) -> DataFrame:
        """Values along the rules' paths of the objects they are for; readings are told of each before it meets rules."""
        some = lambda facts, way: facts.join(self.sized(rules.where(way).select(F.col("path").alias("KEY")).distinct(), len(self.rules)), "KEY", "left_semi")
        rows = some(self.along, "not inverse").withColumn("inverse", F.lit(False))
        if any(r.inverse for r in self.rules):
            back = some(self.data.select(F.col("VALUE").alias("ID"), "KEY", F.col("ID").alias("VALUE"), *self.instance), "inverse")
            rows = rows.unionByName(back.withColumn("inverse", F.lit(True)))
        # Objects meet before rules do: a fact is shuffled once, and not for each of its rules.
        own = self.members.join(self.sized(rules.select("target", *self.scope[1:]).distinct(), len(self.rules)), ["target", *self.scope[1:]], "left_semi")
        rows = rows.join(self.built(own), ["ID", *self.instance]).withColumns(readings or {})
        by = rules.withColumnsRenamed({c: f"__{c}" for c in ("target", "inverse", *self.scope[1:])})
        fits = [F.col(c) == F.col(f"__{c}") for c in ("target", "inverse", *self.scope[1:])]
        return rows.join(by, reduce(Column.__and__, fits, F.col("KEY") == F.col("path"))).drop(*(f"__{c}" for c in ("target", "inverse", *self.scope[1:])))

    def walk(self) -> None:
        """Lays out the values of paths of several steps; those of repeated steps from the members of their rules' targets."""
        if self.ways:
            starts = self.members.where(F.col("target").isin(self.walked)).select("ID", *self.instance).distinct() if self.walked else None
            self.along = self.data.unionByName(paths.facts(self.data, list(self.ways.values()), self.instance, starts))
        else:
            self.along = self.data

    def nesting(self, depth: int) -> DataFrame:
        """(rule, scope, ID, VALUE): values of the rules of one depth with nested shapes; those that are counted, once."""
        at = {r.component for d, r in zip(_depths(self.rules), self.rules, strict=True) if d == depth}
        kinds = [k for k in (("node",), QUALIFIED) if at.intersection(k)]
        rows = [self.values(self.of(*k).where(F.col("depth") == depth)).select("rule", *self.scope, "ID", "VALUE") for k in kinds]
        return reduce(DataFrame.unionByName, (r if k == ("node",) else r.distinct() for k, r in zip(kinds, rows, strict=True)))

    def nest(self) -> None:
        """Values of rules with nested shapes become members of a class of their own, from outside in."""
        depths = _depths(self.rules)
        of = {r.label: {d for d, x in zip(depths, self.rules, strict=True) if x.label == r.label} for r in self.rules if r.component in NESTS}
        # A claim from another depth adds members to what has been walked; its values are told again later.
        steady = all(of.get(v, {d}) == {d} for d, r in zip(depths, self.rules, strict=True) if r.component in QUALIFIED for v in r.values)
        for depth in sorted({d for d, r in zip(depths, self.rules, strict=True) if r.component in NESTS}):
            rows = written(self.nesting(depth), "nested")
            if steady:
                self.nested[depth] = rows
            labels = self.of(*NESTS).select("rule", F.explode(F.concat(F.array("label"), "items")).alias("label"))
            nodes = self.dealt(rows.select("rule", F.col("VALUE").alias("ID"), *self.scope)).distinct().join(labels, "rule").select("ID", F.concat(F.lit("nodes of "), "label").alias("target"), *self.scope)
            self.members = self.dealt(written(self.members.unionByName(nodes).distinct(), "members"))
            if self.walked:
                self.walk()

    def found(self, rows: DataFrame, key="path", value="VALUE", kind="component") -> DataFrame:
        part = lambda c: F.lit(None).cast("string") if c is None else F.col(c)
        return rows.select("rule", *self.scope, "ID", part(key).alias("KEY"), part(value).alias("VALUE"), part(kind).alias("kind"))

    def single_values(self) -> list[DataFrame]:
        rows = self.values(self.of(*VALUE_COMPONENTS), _readings()).withColumn("known", F.col("path").isin(self.to_classes))
        if any(r.component == "nodeKind" and r.path not in self.to_classes for r in self.rules):
            # Only these values are looked up; very many rows may have the same.
            asked = (F.col("component") == "nodeKind") & ~F.col("known")
            ids = self.data.select(F.col("ID").alias("VALUE"), *self.instance).distinct().withColumn("there", F.lit(True))
            told = joined(written(rows.where(asked), "asked"), written(ids, "ids"), ["VALUE", *self.instance], "left").withColumn("known", F.coalesce("there", F.lit(False)))
            rows = rows.where(~asked).unionByName(told.drop("there"))
        narrow = (F.col("component") == "datatype") & (F.size("items") > 0) & F.expr("VALUE rlike concat('^(?:', get(items, 0), ')\\\\z')") if self.lexical else F.lit(False)
        kind = F.when(_fails(), F.col("component")).when(narrow, F.lit("lexicalForm"))
        return [self.found(rows.withColumn("kind", kind).where(F.col("kind").isNotNull()), kind="kind")]

    def counts(self) -> list[DataFrame]:
        own = ["rule", *self.scope, "ID"]
        bounds = self.of("minCount", "maxCount")
        counted = self.values(bounds).groupBy(*own).agg(F.count("*").alias("n"))
        wrong = F.when(F.col("component") == "maxCount", F.col("n") > F.col("number")).otherwise(F.coalesce("n", F.lit(0)) < F.col("number"))
        return [self.found(self.focus(bounds).join(self.built(counted), own, "left").where(wrong), value=None)]

    def has_value(self) -> list[DataFrame]:
        own = ["rule", *self.scope, "ID"]
        there = self.values(self.of("hasValue")).where("VALUE = text").select(own)
        return [self.found(self.focus(self.of("hasValue")).join(there, own, "left_anti"), value=None)]

    def classes(self) -> list[DataFrame]:
        on = ["VALUE", *self.instance]
        types = self.dealt(self.data.where(F.col("KEY") == TYPE).select(F.col("ID").alias("VALUE"), F.col("VALUE").alias("class"), *self.instance), *on).distinct()
        wrong = self.dealt(self.values(self.of("class")), *on).join(self.built(types.withColumnRenamed("class", "text")), ["VALUE", "text", *self.instance], "left_anti")
        ranged = self.dealt(self.values(self.of("range")), *on).join(self.built(types.select(*on).distinct()), on, "left_semi")
        allowed = self.of("range").select("rule", F.explode("items").alias("class")).join(types, "class").select("rule", *on).distinct() if self.has("range") else None
        outside = ranged.join(self.built(allowed), ["rule", *on], "left_anti") if allowed is not None else None
        return [self.found(wrong), *([self.found(outside)] if outside is not None else [])]

    def pairs(self) -> list[DataFrame]:
        names = ("equals", "disjoint", "lessThan", "lessThanOrEquals")
        own = ["rule", *self.scope, "ID"]
        a = self.values(self.of(*names)).select(*own, "component", "path", "VALUE").distinct()
        b = self.values(self.of(*names).withColumn("path", F.col("text"))).select(*own, "component", "path", "VALUE").distinct()
        of = lambda rows, *c: rows.where(F.col("component").isin(*c))
        on = [*own, "VALUE"]
        only = of(a, "equals").join(of(b, "equals"), on, "left_anti").unionByName(of(b, "equals").join(of(a, "equals"), on, "left_anti"))
        both = of(a, "disjoint").join(of(b, "disjoint"), on, "left_semi")
        other = of(b, "lessThan", "lessThanOrEquals").select(*own, F.col("VALUE").alias("other"))
        x, y = _as_number(F.col("VALUE")), _as_number(F.col("other"))
        ordered = F.when(F.col("component") == "lessThan", x < y).otherwise(x <= y)
        unordered = of(a, "lessThan", "lessThanOrEquals").join(other, own).where(~F.coalesce(ordered, F.lit(False)))
        return [self.found(only), self.found(both), self.found(unordered)]

    def closed(self) -> list[DataFrame]:
        rows = self.focus(self.of("closed")).join(self.data, ["ID", *self.instance]).where((F.col("KEY") != TYPE) & ~F.expr("array_contains(items, KEY)"))
        return [self.found(rows, key="KEY")]

    def leaves(self) -> DataFrame:
        parts: list[DataFrame] = []
        for components, plan in ((VALUE_COMPONENTS, self.single_values), (("minCount", "maxCount"), self.counts), (("hasValue",), self.has_value), (("class", "range"), self.classes), (("equals", "disjoint", "lessThan", "lessThanOrEquals"), self.pairs), (("closed",), self.closed)):
            if self.has(*components):
                parts += plan()
        if not parts:
            names = ", ".join(f"{c} string" for c in (*self.scope, "ID", "KEY", "VALUE", "kind"))
            return self.data.sparkSession.createDataFrame([], f"rule int, {names}")
        return reduce(DataFrame.unionByName, parts)

    def failing(self, found: DataFrame, bits: DataFrame | None = None) -> DataFrame:
        """(word, scope, ID, bits): parts of and, or, not and xone that objects fail; a warning of form is no failure."""
        own = ["word", *self.scope, "ID"]
        rows = found.where("kind <> 'lexicalForm'").join(self.bits, "rule").select(*own, F.col("bit").alias("bits"))
        return (rows if bits is None else rows.unionByName(bits)).groupBy(*own).agg(F.bit_or("bits").alias("bits"))

    def boolean(self, depth: int, bits: DataFrame) -> list[DataFrame]:
        """What and, or, not and xone of one depth find, an object's word at a time: rules come in behind the last exchange of objects."""
        own = ["rule", *self.scope, "ID"]
        n, all_of, is_ = F.col("n"), F.col("alternatives"), F.col("component")
        wrong = F.when(is_ == "and", n > 0).when(is_ == "or", n == all_of).when(is_ == "not", n == 0).otherwise(n != all_of - 1)
        focus = self.members.join(self.words.where(F.col("depth") == depth), ["target", *self.scope[1:]]).select("word", *self.scope, "ID")
        rows = focus.join(bits.hint("merge"), ["word", *self.scope, "ID"], "left").join(self.masks, "word").withColumn("n", F.coalesce(F.bit_count(F.col("bits").bitwiseAND(F.col("mask"))), F.lit(0)))
        out = [self.found(rows.where(F.col("spans") == 1).where(wrong), key=None, value=None)]
        if depth in self.wide_depths:
            counted = rows.where(F.col("spans") > 1).groupBy(*own, "component", "alternatives").agg(F.sum("n").alias("n"))
            out.append(self.found(counted.where(wrong), key=None, value=None))
        return out

    def combined(self, depth: int, found: DataFrame, bits: DataFrame | None) -> DataFrame:
        """What the rules with parts of one depth find, given what was found a level deeper; a warning of form is no failure."""
        parts = self.parts.where(F.col("of_depth") == depth)
        failed = found.where("kind <> 'lexicalForm'").join(parts, "rule").select(F.col("parent").alias("rule"), "alternative", *self.scope, "ID").distinct()
        at = F.col("depth") == depth
        out = self.boolean(depth, bits) if depth in self.word_depths else []
        nodes = failed.select("rule", *self.scope, F.col("ID").alias("VALUE")).distinct()
        if self.has(*NESTS) and self.of_depth(depth, *NESTS):
            rows = self.nested[depth] if depth in self.nested else self.nesting(depth)
            if self.of_depth(depth, "node"):
                of_values = rows.join(self.of("node").where(at).select("rule", "path", "component"), "rule")
                out.append(self.found(of_values.join(nodes, ["rule", *self.scope, "VALUE"], "left_semi")))
            if self.of_depth(depth, *QUALIFIED):
                out.append(self.qualified(self.of(*QUALIFIED).where(at), rows, nodes))
        return reduce(DataFrame.unionByName, out)

    def of_depth(self, depth: int, *components: str) -> bool:
        return any(d == depth and r.component in components for d, r in zip(_depths(self.rules), self.rules, strict=True))

    def qualified(self, rules: DataFrame, rows: DataFrame, failed: DataFrame) -> DataFrame:
        """Bounds on how many values conform to a shape; values that conform to one of the shapes in `items` do not count.

        rows: (rule, ID, VALUE) of all values.  failed: (rule, VALUE) of values that do not conform to the shape of a rule."""
        node = [*self.scope, "VALUE"]
        rows = self.dealt(rows.join(rules.select("rule"), "rule", "left_semi"), "rule", *node)
        out = failed.select("rule", *node)
        if any(r.values for r in self.rules if r.component in QUALIFIED):
            siblings = self.table.select(F.col("label").alias("sibling"), F.col("rule").alias("other"))
            claims = rules.select("rule", F.explode("items").alias("sibling")).join(siblings, "sibling").select("rule", "other")
            asked = rows.select("rule", *node).distinct().join(claims, "rule")
            claimed = asked.join(failed.withColumnRenamed("rule", "other"), ["other", *node], "left_anti").select("rule", *node)
            out = out.unionByName(claimed)
        own = ["rule", *self.scope, "ID"]
        counted = self.dealt(rows.join(self.built(out.distinct()), ["rule", *node], "left_anti")).groupBy(*own).agg(F.count("*").alias("n"))
        n = F.coalesce("n", F.lit(0))
        wrong = F.when(F.col("component") == "qualifiedMinCount", n < F.col("number")).otherwise(n > F.col("number"))
        return self.found(self.focus(rules).join(self.built(counted), own, "left").where(wrong), value=None)


def validate(data: DataFrame, rules: list[Rule], scope=None, lexical: bool = True, pairs: DataFrame | None = None) -> DataFrame:
    """Violations of all rules by the facts in scope.

    pairs (INSTANCE_ID, PROFILE): every instance by itself against the rules of each of its profiles; both are columns of the result."""
    run = _Run(in_scope(data, scope), rules, lexical, pairs)
    if run.has(*NESTS):
        run.nest()
    if run.deepest < 0:
        found = run.leaves()
    else:
        # Parts that are told by words are never written as a row each.
        leaves = written(run.only("loose").leaves(), "found")
        bits = written(run.failing(run.only("packed").leaves()), "bits") if run.word_depths else None
        below = None
        for depth in range(run.deepest, -1, -1):
            if below is None:
                below = run.combined(depth, leaves, bits)
            else:
                below = run.combined(depth, leaves.unionByName(below), run.failing(below, bits) if bits is not None else None)
            if depth:
                below = written(below, "combined")
        found = leaves.unionByName(below)  # whatever stands deeper is a part
    top = run.table.where(F.col("parent").isNull()).select("rule", "shape", "component", "severity", "message", "text", "items")
    rows = found.join(top, "rule")
    said = F.coalesce("message", F.concat(F.lit("sh:"), F.col("component"), F.coalesce(F.concat(F.lit(" "), F.col("text")), F.lit(""))))
    severity = F.when(F.col("kind") == "lexicalForm", F.lit("Warning")).otherwise(F.col("severity"))
    return rows.select("ID", "KEY", "VALUE", F.col("kind").alias("VIOLATION_TYPE"), said.alias("MESSAGE"), severity.alias("SEVERITY"), F.col("shape").alias("SOURCE_SHAPE"), *run.scope)


def rules_of_schema(schema: dict[str, dict[str, dict]], closed: bool = False) -> list[Rule]:
    """Rules of a declared schema: {class: {property: {min, max, datatype, range, in}}}."""
    rules: list[Rule] = []
    for name, properties in schema.items():
        for key, p in properties.items():
            add = lambda component, key=key, name=name, **k: rules.append(Rule(f"{name}.{key}", component, name, key, **k))
            if p.get("min"):
                add("minCount", value=p["min"])
            if p.get("max") is not None:
                add("maxCount", value=p["max"])
            if p.get("datatype"):
                add("datatype", value=p["datatype"])
            if p.get("range"):
                add("range", values=tuple(p["range"]))
            if p.get("in"):
                add("in", values=tuple(p["in"]))
        if closed:
            rules.append(Rule(f"{name}.closed", "closed", name, values=tuple(properties)))
    return rules


def _said_of_shapes(violations: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds SHAPE_NAME and SHAPE_DESCRIPTION: of the shape's rules for the property in KEY, or else of those for no property."""
    said: dict[tuple[str, str], list] = {}
    for r in rules:
        names = said.setdefault((r.shape, r.path or ""), [None, None])
        names[:] = [old if old is not None else new for old, new in zip(names, (r.shape_name, r.shape_description), strict=True)]
    spark, out = violations.sparkSession, violations
    for i, own in enumerate((True, False)):
        rows = [(shape, path, *names) for (shape, path), names in said.items() if bool(path) == own]
        table = spark.createDataFrame(rows, f"SOURCE_SHAPE string, __path string, __name{i} string, __text{i} string")
        table = table if own else table.drop("__path")
        out = out.withColumn("__path", F.col("KEY")) if own else out
        out = out.join(F.broadcast(table) if len(rows) <= BROADCAST_RULES else table, ["SOURCE_SHAPE", "__path"] if own else "SOURCE_SHAPE", "left")
    out = out.withColumns({"SHAPE_NAME": F.coalesce("__name0", "__name1"), "SHAPE_DESCRIPTION": F.coalesce("__text0", "__text1")})
    return out.select(*violations.columns, "SHAPE_NAME", "SHAPE_DESCRIPTION")


def enriched(violations: DataFrame, data: DataFrame, rules: list[Rule] = (), profile: DataFrame | None = None) -> DataFrame:
    """Adds what is known of the object, the shape and the schema; the first by load order counts.

    OBJECT_TYPE, OBJECT_NAME, INSTANCE_ID and INSTANCE_LABEL are of the data, SHAPE_NAME and SHAPE_DESCRIPTION of the rules, and
    SCHEMA_DESCRIPTION, SCHEMA_MULTIPLICITY and CLASS_DESCRIPTION of the profile, a graph; null where nothing is given."""
    pick = lambda key, name: F.min_by(F.when(F.col("KEY") == key, F.col("VALUE")), F.when(F.col("KEY") == key, F.col("_ord"))).alias(name)
    about = data.groupBy("ID").agg(pick(TYPE, "OBJECT_TYPE"), pick("IdentifiedObject.name", "OBJECT_NAME"), F.min_by("INSTANCE_ID", "_ord").alias("INSTANCE_ID"))
    labels = data.where(F.col("KEY") == "label").groupBy("INSTANCE_ID").agg(F.min_by("VALUE", "_ord").alias("INSTANCE_LABEL"))
    rows = _said_of_shapes(violations, list(rules)).join(about, "ID", "left").join(labels, "INSTANCE_ID", "left")
    if profile is None:
        return rows.withColumns({c: F.lit(None).cast("string") for c in ("SCHEMA_DESCRIPTION", "SCHEMA_MULTIPLICITY", "CLASS_DESCRIPTION")})
    known = descriptions(profile)
    of_keys = known.select(F.col("name").alias("KEY"), F.col("description").alias("SCHEMA_DESCRIPTION"), F.col("multiplicity").alias("SCHEMA_MULTIPLICITY"))
    of_classes = known.select(F.col("name").alias("OBJECT_TYPE"), F.col("description").alias("CLASS_DESCRIPTION"))
    return rows.join(of_keys, "KEY", "left").join(of_classes, "OBJECT_TYPE", "left")


def grouped(violations: DataFrame, samples: int = 3) -> DataFrame:
    """Count and first objects of each shape and kind; ranks are taken per group, nothing is gathered whole."""
    from pyspark.sql import Window

    order = Window.partitionBy("SOURCE_SHAPE", "VIOLATION_TYPE").orderBy("ID", "VALUE")
    first = violations.withColumn("n", F.row_number().over(order)).where(F.col("n") <= samples).groupBy("SOURCE_SHAPE", "VIOLATION_TYPE").agg(F.array_sort(F.collect_list("ID")).alias("SAMPLES"))
    counts = violations.groupBy("SOURCE_SHAPE", "VIOLATION_TYPE").agg(F.count("*").alias("COUNT"))
    return counts.join(first, ["SOURCE_SHAPE", "VIOLATION_TYPE"])


def sarif(violations: DataFrame, tool: str = "quadweave", samples: int = 3) -> dict:
    """A SARIF 2.1.0 report with one result for each shape and kind."""
    levels = {"Violation": "error", "Warning": "warning", "Info": "note"}
    said = violations.groupBy("SOURCE_SHAPE", "VIOLATION_TYPE").agg(F.min("MESSAGE").alias("MESSAGE"), F.min("SEVERITY").alias("SEVERITY"))
    rows = grouped(violations, samples).join(said, ["SOURCE_SHAPE", "VIOLATION_TYPE"]).orderBy("SOURCE_SHAPE", "VIOLATION_TYPE").collect()  # shapes times kinds
    results = [{"ruleId": r["SOURCE_SHAPE"], "level": levels.get(r["SEVERITY"], "error"), "message": {"text": f"{r['MESSAGE']}: {r['COUNT']} found, such as {', '.join(r['SAMPLES'])}"}, "properties": {"kind": r["VIOLATION_TYPE"], "count": r["COUNT"]}} for r in rows]
    ids = sorted({r["SOURCE_SHAPE"] for r in rows})
    return {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": [{"id": i} for i in ids]}}, "results": results}]}


def report_lines(violations: DataFrame) -> DataFrame:
    """`line`: a validation report as N-Triples, one blank node for each violation."""
    from quadweave.functions.terms import literal, subject

    sh = "http://www.w3.org/ns/shacl#"
    node = F.concat(F.lit("_:v"), F.hex(F.xxhash64(*(F.coalesce(F.col(c), F.lit("")) for c in VIOLATIONS))))
    link = lambda name, term: F.when(term.isNotNull(), F.concat(node, F.lit(f" <{sh}{name}> "), term, F.lit(" .")))
    lines = F.array(
        F.concat(node, F.lit(f" <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <{sh}ValidationResult> .")),
        link("focusNode", subject(F.col("ID"))),
        link("resultPath", F.when(F.col("KEY").isNotNull(), F.concat(F.lit("<http://iec.ch/TC57/CIM100#"), F.col("KEY"), F.lit(">")))),
        link("value", literal(F.col("VALUE"))),
        link("sourceConstraintComponent", F.concat(F.lit(f"<{sh}"), F.upper(F.substring("VIOLATION_TYPE", 1, 1)), F.substr("VIOLATION_TYPE", F.lit(2)), F.lit("ConstraintComponent>"))),
        link("resultMessage", literal(F.col("MESSAGE"))),
        link("resultSeverity", F.concat(F.lit(f"<{sh}"), F.col("SEVERITY"), F.lit(">"))),
    )
    return violations.select(F.explode(lines).alias("line")).where(F.col("line").isNotNull())


def violations_of_report(lines: DataFrame, line: str = "line") -> DataFrame:
    """The violations that `report_lines` (or another report of this form) states; shapes are not part of it."""
    from quadweave.functions.terms import facts_of_quads
    from quadweave.operators.tableview import wide

    sh = "http://www.w3.org/ns/shacl#"
    rows = facts_of_quads(lines.select(F.col(line).alias("value"))).where(F.col("KEY").startswith(sh))
    short = rows.select("ID", F.substr("KEY", F.lit(len(sh) + 1)).alias("KEY"), "VALUE", F.lit(0).cast("bigint").alias("_ord"))
    view = wide(short, ["focusNode", "resultPath", "value", "sourceConstraintComponent", "resultMessage", "resultSeverity"])
    name = F.regexp_replace(F.regexp_replace("sourceConstraintComponent", f"^{sh}", ""), r"ConstraintComponent\z", "")
    kind = F.concat(F.lower(F.substring(name, 1, 1)), F.substr(name, F.lit(2)))
    return view.select(F.col("focusNode").alias("ID"), F.col("resultPath").alias("KEY"), F.col("value").alias("VALUE"), kind.alias("VIOLATION_TYPE"), F.col("resultMessage").alias("MESSAGE"), F.regexp_replace("resultSeverity", f"^{sh}", "").alias("SEVERITY"))
