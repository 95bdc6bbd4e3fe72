"""Shapes written in Turtle, as rules."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence

from quadweave.model import TYPE
from quadweave.plans.paths import text_of
from quadweave.plans.shapes import QUALIFIED, Rule
from quadweave.sources.cimxml import clean_id

# Vocabularies.
SH = "http://www.w3.org/ns/shacl#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_TOKEN = re.compile(r'\s+|#[^\n]*|("""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')|(<[^>]*>)|(@[A-Za-z][\w-]*|\^\^)|([\[\]();,]|\.(?=\s|$|\]|<))|([^\s\[\]();,<"\']+)')
_VALUE = {"minCount", "maxCount", "minLength", "maxLength", "minInclusive", "maxInclusive", "minExclusive", "maxExclusive", "pattern", "hasValue", "datatype", "class", "nodeKind", "equals", "disjoint", "lessThan", "lessThanOrEquals"}


def _tokens(text: str) -> list[str]:
    return [m[0] for m in _TOKEN.finditer(text) if m.lastindex]


def triples(text: str) -> list[tuple[str, str, str]]:
    """Statements with full names; literals keep their text, blank nodes are named _:n, lists are chains."""
    tokens, out, prefixes, base = _tokens(text), [], {}, ""
    at = number = 0

    def fresh() -> str:
        nonlocal number
        number += 1
        return f"_:{number}"

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def name(token: str) -> str:
        if token.startswith("<"):
            inner = token[1:-1]
            return inner if ":" in inner else base + inner
        if token == "a":
            return RDF + "type"
        prefix, colon, local = token.partition(":")
        return prefixes[prefix] + local if colon and prefix in prefixes else token

    def term() -> str:
        nonlocal at
        token = take()
        if token == "[":
            node = fresh()
            if tokens[at] != "]":
                properties(node)
            take()
            return node
        if token == "(":
            items = []
            while tokens[at] != ")":
                items.append(term())
            take()
            node = RDF + "nil"
            for item in reversed(items):
                cell = fresh()
                out.extend([(cell, RDF + "first", item), (cell, RDF + "rest", node)])
                node = cell
            return node
        if token[0] in "\"'":
            quote = 3 if token.startswith('"""') else 1
            value = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), token[quote:-quote])
            if at < len(tokens) and tokens[at] == "^^":
                take(), take()
            elif at < len(tokens) and tokens[at].startswith("@"):
                take()
            return value
        return name(token)

    def properties(node: str) -> None:
        while True:
            key = name(take())
            while True:
                out.append((node, key, term()))
                if tokens[at] != ",":
                    break
                take()
            while at < len(tokens) and tokens[at] == ";":
                take()
            if at >= len(tokens) or tokens[at] in (".", "]"):
                return

    while at < len(tokens):
        if tokens[at].lower() in ("@prefix", "prefix", "@base", "base"):
            word = take().lower()
            if word.endswith("prefix"):
                prefix = take().rstrip(":")
                prefixes[prefix] = name(take())
            else:
                base = name(take())
            if at < len(tokens) and tokens[at] == ".":
                take()
            continue
        node = term()
        if tokens[at] != ".":
            properties(node)
        take()
    return out


def _local(uri: str) -> str:
    return re.split(r"[#/]", uri)[-1]


# Names of repeated steps.
_REPEATED = {"zeroOrMorePath": "zero_or_more", "oneOrMorePath": "one_or_more", "zeroOrOnePath": "zero_or_one"}


class _Shapes:
    def __init__(self, text: str):
        self.of: dict[str, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
        for s, p, o in triples(text):
            self.of[s][p.removeprefix(SH)].append(o)
        self.rules: list[Rule] = []
        self.skipped: list[str] = []

    def items(self, node: str) -> list[str]:
        found = []
        while node != RDF + "nil" and node in self.of:
            found += self.of[node][RDF + "first"]
            node = self.of[node][RDF + "rest"][0]
        return found

    def path(self, node: str) -> str | tuple | None:
        """A property, or a path of `paths`."""
        if not node.startswith("_:"):
            return TYPE if node == RDF + "type" else _local(node)
        own = self.of[node]
        if own.get("inversePath"):
            kind, parts = "inverse", own["inversePath"]
        elif own.get("alternativePath"):
            kind, parts = "alternative", self.items(own["alternativePath"][0])
        elif own.get(RDF + "first"):
            kind, parts = "sequence", self.items(node)
        elif repeated := next((name for name in _REPEATED if own.get(name)), None):
            kind, parts = _REPEATED[repeated], own[repeated]
        else:
            return None
        steps = [self.path(p) for p in parts]
        return None if None in steps or not steps else (kind, *steps)

    @staticmethod
    def label(shape: str, node: str, component: str, number: int, target: str, parent: str | None) -> str:
        """A name of its own for each rule with parts: targets and outer rules have rules of their own."""
        return "|".join((shape, node, component, str(number), parent or target))

    def add(self, node: str, shape: str, target: str, how: str, parent: str | None, alternative: int, said: tuple[str | None, str | None] = (None, None), within: tuple[str, ...] = (), claims: Sequence[str] = ()) -> None:
        if node in within:  # a shape that is a part of itself has no depth
            self.skipped.append(shape)
            return
        within = (*within, node)
        own = self.of[node]
        said = tuple(own[key][0] if own.get(key) else inherited for key, inherited in zip(("name", "description"), said, strict=True))
        path, inverse, way = None, False, None
        if own.get("path"):
            found = self.path(own["path"][0])
            if found is None:
                self.skipped.append(shape)
                return
            if isinstance(found, str):
                path = found
            elif found[0] == "inverse" and isinstance(found[1], str):
                path, inverse = found[1], True
            else:
                path, way = text_of(found), found
        common = {"path": path, "inverse": inverse, "way": way, "shape_name": said[0], "shape_description": said[1], **({how: True} if how else {}), "parent": parent, "alternative": alternative, "severity": _local(own["severity"][0]) if own.get("severity") else "Violation", "message": own["message"][0] if own.get("message") else None}
        make = lambda component, **k: self.rules.append(Rule(shape, component, target, **(common | k)))
        for component in sorted(_VALUE & own.keys()):
            for value in own[component]:
                make(component, value=_local(value) if component in ("datatype", "class", "nodeKind", "equals", "disjoint", "lessThan", "lessThanOrEquals") else value)
        for values in own.get("in", []):
            make("in", values=tuple(_local(v) for v in self.items(values)))
        if own.get("closed") == ["true"]:
            ignored = [_local(i) for ignore in own.get("ignoredProperties", []) for i in self.items(ignore)]
            paths = [self.path(self.of[p]["path"][0]) for p in own.get("property", []) if self.of[p].get("path")]
            make("closed", values=tuple(p for p in paths if isinstance(p, str)) + tuple(ignored))
        for component in ("and", "or", "not", "xone", "node"):
            for number, value in enumerate(own.get(component, [])):
                label = self.label(shape, node, component, number, target, parent)
                make(component, name=label)
                inner = f"nodes of {label}" if component == "node" else target
                for i, part in enumerate([value] if component in ("not", "node") else self.items(value)):
                    self.add(part, shape, inner, how if component != "node" else "", label, i, said, within)
        for component in QUALIFIED:
            for value in own.get(component, []):
                label = self.label(shape, node, component, 0, target, parent)
                make(component, name=label, value=value, values=tuple(claims))
                for part in own.get("qualifiedValueShape", []):
                    self.add(part, shape, f"nodes of {label}", "", label, 0, said, within)
        of = lambda p: shape if p.startswith("_:") else _local(p)
        counted = {p: self.label(of(p), p, next(c for c in QUALIFIED if self.of[p].get(c)), 0, target, parent) for p in own.get("property", []) if any(self.of[p].get(c) for c in QUALIFIED)}
        for p in own.get("property", []):
            others = [label for q, label in counted.items() if self.of[q].get("qualifiedValueShape") != self.of[p].get("qualifiedValueShape")]
            disjoint = self.of[p].get("qualifiedValueShapesDisjoint") == ["true"]
            self.add(p, of(p), target, how, parent, alternative, said, within, others if disjoint else ())
        if own.get("sparql") or own.get("target"):
            self.skipped.append(shape)

    def compile(self) -> list[Rule]:
        for node in list(self.of):
            for key, how in (("targetClass", ""), ("targetSubjectsOf", "subjects_of"), ("targetObjectsOf", "objects_of"), ("targetNode", "target_node")):
                for target in self.of[node].get(key, []):
                    self.add(node, _local(node), clean_id(target) if how == "target_node" else _local(target), how, None, 0)
        return self.rules


def rules_of_turtle(text: str) -> tuple[list[Rule], list[str]]:
    """The rules of shapes, and the names of shapes with parts that are not rules (queries, other paths and targets)."""
    shapes = _Shapes(text)
    return shapes.compile(), sorted(set(shapes.skipped))
