"""RDF terms as text: from facts to N-Quads terms, and back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Namespaces, the form of a UUID, and a line of N-Quads.
CIM = "http://iec.ch/TC57/CIM100#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
QUAD = r"^\s*(\S+)\s+(\S+)\s+(.+?)(?:\s+(<[^>]*>|_:[^\s\"<]+))?\s*\.\s*\z"


def _is_uri(c: Column) -> Column:
    return c.startswith("http://") | c.startswith("https://") | c.startswith("urn:")


def _bracketed(c: Column) -> Column:
    return F.concat(F.lit("<"), c, F.lit(">"))


def _lookup(table: dict[str, str], key: Column) -> Column:
    """A small table of the driver as an expression; null where it has no entry."""
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def subject(c: Column) -> Column:
    return _bracketed(F.when(_is_uri(c), c).otherwise(F.concat(F.lit("urn:uuid:"), c)))


def predicate(c: Column, namespaces: dict[str, str] | None = None, cim: str = CIM) -> Column:
    own = F.coalesce(_lookup(namespaces or {}, c), F.lit(cim))
    return F.when(c == "Type", F.lit(f"<{RDF_TYPE}>")).when(c.startswith("http://") | c.startswith("https://"), _bracketed(c)).otherwise(_bracketed(F.concat(own, c)))


def literal(c: Column) -> Column:
    escaped = F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def value_term(key: Column, value: Column, enumerations=(), datatypes: dict[str, str] | None = None, cim: str = CIM) -> Column:
    """A class, a URI, an enumeration value, a literal by its schema, a UUID reference, or a plain literal."""
    datatypes = datatypes or {}
    in_cim = _bracketed(F.concat(F.lit(cim), value))
    kind = _lookup({k: v or "" for k, v in datatypes.items()}, key)
    typed = F.when(kind != "", F.concat(literal(value), F.lit("^^"), _bracketed(kind))).otherwise(literal(value))
    chain = F.when(_is_uri(value), _bracketed(value)).when(key == "Type", in_cim)
    if enumerations:
        chain = chain.when(key.isin(list(enumerations)), in_cim)
    if datatypes:
        chain = chain.when(kind.isNotNull(), typed)
    return chain.when(value.rlike(UUID), _bracketed(F.concat(F.lit("urn:uuid:"), value))).otherwise(literal(value))


def quads(data: DataFrame, namespaces=None, enumerations=(), datatypes=None, cim: str = CIM) -> DataFrame:
    """`line`: a statement for every fact with a value; without INSTANCE_ID it has no graph."""
    key, value = F.col("KEY"), F.col("VALUE")
    terms = [subject(F.col("ID")), predicate(key, namespaces, cim), value_term(key, value, enumerations, datatypes, cim), subject(F.col("INSTANCE_ID")), F.lit(".")]
    return data.where(value.isNotNull()).select(F.concat_ws(" ", *terms).alias("line"))


_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\(.)", re.S)
_CONTROL = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def _unescape_one(text: str) -> str:
    def one(m):
        return chr(int(m[1] or m[2], 16)) if m[3] is None else _CONTROL.get(m[3], m[3])

    return _ESCAPE.sub(one, text)


@F.pandas_udf(T.StringType())
def _unescape(texts):
    return texts.map(_unescape_one, na_action="ignore")


def _iri(c: Column, cim: str) -> Column:
    inner = F.regexp_replace(c, r"^<(.*)>\z", "$1")
    for prefix in ("_:", "urn:uuid:", cim):
        inner = F.when(inner.startswith(prefix), F.substr(inner, F.lit(len(prefix) + 1))).otherwise(inner)
    return inner


def facts_of_quads(lines: DataFrame, line: str = "value", cim: str = CIM) -> DataFrame:
    """ID, KEY, VALUE, INSTANCE_ID of N-Quads lines; comments and blanks are passed over, other lines are errors.

    Datatypes and languages are dropped; only values with a backslash go through Python."""
    text = F.col(line)
    kept = lines.where((F.trim(text) != "") & ~F.ltrim(text).startswith("#"))
    term = lambda i: F.regexp_extract(text, QUAD, i)
    sound = F.when(text.rlike(QUAD), text).otherwise(F.raise_error(F.concat(F.lit("not N-Quads: "), F.substring(text, 1, 200))).cast("string"))
    terms = kept.withColumn(line, sound).select(term(1).alias("s"), term(2).alias("k"), term(3).alias("o"), term(4).alias("g"))
    quoted = F.col("o").startswith('"')
    bare = F.regexp_replace("o", r'(?s)^"(.*)"(\^\^<[^>]*>|@[\w-]+)?\z', "$1")
    parts = terms.select("s", "k", "g", "o", F.when(quoted, bare).alias("q"))
    parts = parts.withColumn("u", _unescape(F.when(F.contains("q", F.lit("\\")), F.col("q"))))
    key = F.when(F.col("k") == f"<{RDF_TYPE}>", F.lit("Type")).otherwise(_iri(F.col("k"), cim))
    return parts.select(_iri(F.col("s"), cim).alias("ID"), key.alias("KEY"), F.coalesce("u", "q", _iri(F.col("o"), cim)).alias("VALUE"), F.when(F.col("g") != "", _iri(F.col("g"), cim)).alias("INSTANCE_ID"))
