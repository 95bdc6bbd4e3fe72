"""Personal data: patterns, and terms that disclose what the patterns found. DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card and phone numbers.  Each found value is a protected
entity.  The method then asks which terms give an entity away.  Over all distinct texts it counts in how many
a term t (a word outside base spans) stands together with an entity e, anywhere in the text, in how many either occurs,
and with N texts takes

    PMI(t, e) = log2(N * n(t, e) / (n(t) * n(e))),   IC(e) = log2(N / n(e)).

PMI equals IC where t and e occur only together, so that either reveals the other.  A few texts bear out little: PMI is an
estimate, and is discounted by its support, as is usual for mutual information of rare words (least = min(n(t), n(e))):

    discounted(t, e) = PMI(t, e) * n(t, e) / (n(t, e) + 1) * least / (least + 1).

t discloses where discounted >= threshold * IC.  With the threshold of 0.6 a pair needs four texts at least, whatever N is, so words that
merely stand once beside an address tell nothing.  Every occurrence of a disclosing term, in every text that holds it, is a
span of kind `term`.  Copies of a text count once.  Sanitising generalises base spans to their kind, and of disclosing terms
those with digits to [NUMBER] and those with a capital to [NAME]; others are removed.

No pair is made that could not disclose: the entity and the term need the least support that the discount asks for, and common words fall by the
best that any entity could do for them.  A text's pairs are made as a stream that is summed before it is shuffled.

Base matches are leftmost and do not overlap within a kind; one that fails its test is dropped and what it
covers is not searched again.  The patterns below are those of the contract, written so that they need time
in proportion to the text: possessive where no shorter match could succeed, and starting only where a longer
run of the same characters does not begin earlier.

Defined results: a null or empty text has no spans (its digest is that of the empty string).  Repeated rows
get the same spans.  Rows without doc_id are treated like others.  Extra columns are kept by `with_spans`
and `sanitised`; `with_spans` replaces columns named like the ones it adds, `sanitised` adds none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadweave.llm.scratch import private, written

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = r"[A-Za-z0-9._%+-]"
_RUN = r"(?<![0-9])(?<![0-9][\x20-])"
PATTERNS = {
    # A match may start right behind the last one, in the midst of local characters.
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Runs of other lengths match no card; whole runs of 14 to 19 digits are all that can.
    "card": rf"{_RUN}[0-9](?:[\x20-]?[0-9]){{13,18}}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_IP_VALID = rf"\A{_BYTE}(?:\.{_BYTE}){{3}}\z"

#: Words of letters, digits and marks.
WORD = r"(?<![\p{L}\p{N}_])[\p{L}\p{N}][\p{L}\p{M}\p{N}'’]*+(?![\p{L}\p{N}_])"
THRESHOLD = 0.6
#: Rows up to which a list of terms or of texts is broadcast.
BROADCAST_TERMS = 100_000
#: Bytes of spans up to which they are broadcast to the texts.
BROADCAST_BYTES = 48 << 20


def let(value: Column, body) -> Column:
    """`body(value)` with value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


_BLOCK = 64


def _starts(lengths: Column, body) -> Column:
    """Calls body with a function from index (from 0) to the sum of the lengths before it; in two levels."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / _BLOCK).cast("int")), lambda b: total(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK))))
    before = F.aggregate(blocks, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    at = lambda sums, i: F.get(sums, F.floor(i / _BLOCK).cast("int")) + total(F.slice(lengths, (F.floor(i / _BLOCK) * _BLOCK).cast("int") + 1, F.pmod(i, F.lit(_BLOCK))))
    return let(before, lambda sums: body(lambda i: at(sums, i)))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points."""
    cut = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return let(cut, lambda c: _placed(c["gaps"], c["found"]))


def _placed(gaps: Column, found: Column) -> Column:
    sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m))

    def spans(sums):
        def one(value, i):
            start = sums(i) + F.length(F.get(gaps, i))
            return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))

        return F.transform(found, one)

    return let(sizes, lambda lengths: _starts(lengths, spans))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total, i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(F.pmod(i, F.lit(2)) == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(_IP_VALID)
    if kind == "card":
        return _luhn(_digits(value))
    return F.length(_digits(value)).between(10, 15)


def _valid_spans(text: Column, number: int, kind: str) -> Column:
    kept = F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
    return F.transform(kept, lambda m: F.struct(m["start"].cast("int").alias("start"), F.lit(number).alias("kind"), m["end"].cast("int").alias("end"), m["value"].alias("value")))


def _count(spans: str, number: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("bigint")


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end, value>> in order; kind is the place in KINDS."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    text = F.coalesce(text, F.lit(""))
    digit = text.rlike("[0-9]")
    possible = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), "phone": F.contains(text, F.lit("+"))}
    parts = []
    for number, kind in enumerate(KINDS[:4]):
        shaped = _valid_spans(text, number, kind)
        parts.append(F.when(possible[kind] & (F.lit(True) if kind == "email" else digit), shaped).otherwise(none))
    return F.array_sort(F.concat(*parts))


def _masked(text: Column, base: Column) -> Column:
    """The text with line ends in place of base spans, so that all else keeps its position."""

    def step(state, s):
        start = F.greatest(s["start"], state["at"])
        shown = F.concat(F.substring(text, state["at"] + 1, start - state["at"]), F.repeat(F.lit("\n"), F.greatest(s["end"] - start, F.lit(0))))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["parts"], F.array(shown)).alias("parts"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    done = F.aggregate(base, begin, step, lambda state: F.concat(F.array_join(state["parts"], ""), F.substring(text, state["at"] + 1, F.length(text))))
    return F.when(F.size(base) > 0, done).otherwise(text)


def _words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def _term_spans(text: Column, terms: Column) -> Column:
    """array<struct<start, kind, end, value>> of all occurrences of some terms."""
    return F.filter(F.transform(matches(text, WORD), lambda m: F.struct(m["start"].cast("int").alias("start"), F.lit(4).alias("kind"), m["end"].cast("int").alias("end"), F.lower(m["value"]).alias("value"))), lambda m: F.array_contains(terms, m["value"]))


def _sized(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is small."""
    return F.broadcast(table) if table.count() <= BROADCAST_TERMS else table


def least_support(threshold: float) -> int:
    """Texts that a pair needs to disclose: PMI is IC at most, and the discount (n / (n + 1))^2 at most."""
    if not 0 < threshold < 1:
        raise ValueError("threshold lies between 0 and 1")
    n = 1
    while (n / (n + 1)) ** 2 < threshold:
        n += 1
    return n


def discloses(total: Column, n_te: Column, n_t: Column, n_e: Column, threshold: float) -> Column:
    information = F.log2(total / n_e)
    least = F.least(n_t, n_e)
    discounted = F.log2(total * n_te / (n_t * n_e)) * n_te / (n_te + 1) * least / (least + 1)
    return (information > 0) & (discounted >= threshold * information)


def _told(found: DataFrame, others: DataFrame, total: Column, threshold: float) -> DataFrame:
    """(hash, told): the disclosing terms of every distinct text that has some."""
    support = least_support(threshold)
    mentions = written(found.select("hash", F.explode("entities").alias("entity")), "mentions")
    entities = mentions.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= support)
    shared = written(mentions.join(_sized(written(entities, "entities")), "entity"), "shared")
    beside = found.join(_sized(written(shared.select("hash").distinct(), "beside")), "hash", "left_semi")
    held = beside.select("hash", F.explode("words").alias("term"))
    met = _sized(written(held.groupBy("term").agg(F.count("*").alias("m_t")).where(F.col("m_t") >= support), "met"))
    words = lambda texts, column: texts.select("hash", F.explode(column).alias("term"))
    everywhere = words(found, F.col("words")).unionByName(words(others, _words(F.col("text"))))
    counts = everywhere.join(met, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t")).join(met, "term")
    # The best that any entity could do: n(t, e) and n(e) are m_t at most, and n(e) has the least support.
    best = 1 - F.log2(F.col("n_t") / F.col("m_t")) / F.log2(total / support)
    possible = _sized(written(counts.where((total > support) & (best >= threshold)), "possible"))
    rare = held.join(possible, "term")
    pairs = rare.join(shared, "hash").groupBy("term", "entity").agg(F.count("*").alias("n_te"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"))
    telling = written(pairs.where(discloses(total, F.col("n_te"), F.col("n_t"), F.col("n_e"), threshold)).select("term").distinct(), "telling")
    rows = everywhere.join(_sized(telling), "term", "left_semi")
    return written(rows.groupBy("hash").agg(F.collect_set("term").alias("told")), "told")


def _identity(text: Column) -> Column:
    """128 bits that stand for a text: 64 would meet by chance in a large corpus."""
    return F.unhex(F.md5(text))


def spans_by_text(df: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(hash, base, terms) of every distinct text that has spans; hash is `_identity` of the text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = df.select(_identity(whole).alias("hash"), whole.alias("text"))
    entity = lambda s: F.concat(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), F.lit(":"), F.lower(s["value"]))
    held = written(texts.withColumn("base", base_spans(F.col("text"))).where(F.size("base") > 0), "held").dropDuplicates(["hash"])
    shown = held.select("hash", "base", _masked(F.col("text"), F.col("base")).alias("text"), F.array_distinct(F.transform("base", entity)).alias("entities"))
    found = written(shown.withColumn("words", _words(F.col("text"))), "found")
    copies = written(texts.groupBy("hash").agg(F.count("*").alias("n")), "copies")
    rest = texts.join(_sized(found.select("hash")), "hash", "left_anti")
    again = _sized(written(copies.where("n > 1").select("hash"), "again"))
    others = rest.join(again, "hash", "left_anti").unionByName(rest.join(again, "hash", "left_semi").dropDuplicates(["hash"]))
    told = _told(found, others, F.lit(float(copies.count())), threshold)
    told_bytes = told.agg(F.sum(64 + F.aggregate("told", F.lit(0), lambda a, t: a + 24 + F.octet_length(t)))).first()[0] or 0
    told_of = F.broadcast(told) if told_bytes <= BROADCAST_BYTES else told
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    of_found = found.select("hash", "base", "text").join(told_of, "hash", "left").select("hash", "base", F.when(F.col("told").isNotNull(), _term_spans(F.col("text"), F.col("told"))).otherwise(none).alias("terms"))
    of_others = others.join(told_of, "hash").select("hash", none.alias("base"), _term_spans(F.col("text"), F.col("told")).alias("terms"))
    return of_found.unionByName(of_others)


def with_spans(df: DataFrame, key: str = "doc_id", text: str = "text", names: tuple[str, str] = ("base", "terms"), **options) -> DataFrame:
    """All columns, and `base` and `terms` (array<struct<start, kind, end, value>>), or as `names` has them."""
    spans = written(spans_by_text(df, text, **options), "spans")
    size = spans.agg(F.sum(64 + 48 * (F.size("base") + F.size("terms")) + F.aggregate(F.concat("base", "terms"), F.lit(0), lambda a, s: a + F.octet_length(s["value"])))).first()[0] or 0
    rows = df.drop(*names)
    h, b, t = private(rows, "__hash", "__base", "__terms", taken=names)
    spans = spans.select(F.col("hash").alias(h), F.col("base").alias(b), F.col("terms").alias(t))
    if size <= BROADCAST_BYTES:  # else texts and spans meet by a shuffle
        spans = F.broadcast(spans)
    joined = rows.withColumn(h, _identity(F.coalesce(F.col(text), F.lit("")))).join(spans, h, "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return joined.withColumn(names[0], F.coalesce(F.col(b), none)).withColumn(names[1], F.coalesce(F.col(t), none)).drop(h, b, t)


def sanitised(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All columns, with the text generalised: base spans become [KIND], disclosing terms [NUMBER], [NAME] or nothing."""
    base, terms = private(df, "__base", "__terms")
    spans = with_spans(df, key, text, (base, terms), **options)
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS[:4]), F.lit(""))
    whole = F.col(text)

    def put(s):
        own = F.substring(whole, s["start"] + 1, s["end"] - s["start"])
        of_term = F.when(own.rlike(r"\p{N}"), F.lit("[NUMBER]")).when(own.rlike(r"\p{Lu}"), F.lit("[NAME]")).otherwise(F.lit(""))
        return F.when(s["kind"] == 4, of_term).otherwise(F.element_at(names, s["kind"] + 1))

    def step(state, s):
        shown = F.concat(F.substring(whole, state["at"] + 1, s["start"] - state["at"]), put(s))
        # A span inside what is already replaced only moves the end.
        parts = F.when(s["start"] >= state["at"], F.concat(state["parts"], F.array(shown))).otherwise(state["parts"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), parts.alias("parts"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    done = F.aggregate(F.array_sort(F.concat(base, terms)), begin, step, lambda state: F.concat(F.array_join(state["parts"], ""), F.substring(whole, state["at"] + 1, F.length(whole))))
    clean = F.when(F.size(base) + F.size(terms) > 0, done).otherwise(whole)
    return spans.withColumn(text, clean).drop(base, terms)


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digests(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Counts of base spans, a digest of them and the list of all spans, for every row."""
    spans = with_spans(df.select(key, text), key, text, **options)
    counts = [_count("base", n).alias(f"n_{kind}") for n, kind in enumerate(KINDS[:4])]
    return spans.select(key, *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.array_sort(F.concat("base", "terms"))).alias("spans"))
