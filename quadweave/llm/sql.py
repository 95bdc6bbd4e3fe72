"""The same results in SQL, where SQL can say them; DuckDB runs these over the base tables."""

from __future__ import annotations

from quadweave.llm import licenses, vector_codes
from quadweave.llm.warc import CHUNK_BYTES

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGIT = f"substr('{_BASE32}', CAST((v >> {{}}) & 31 AS INTEGER) + 1, 1)"

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(list_transform(range(8), lambda i: CAST('0x' || substr(hex, 5 * i + 1, 5) AS BIGINT)), lambda v: {" || ".join(_DIGIT.format(s) for s in (15, 10, 5, 0))}), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to,
  CASE WHEN page_id <> first OR payload_bytes = 0 THEN CAST(0 AS BIGINT) ELSE CAST(ceil(payload_bytes / {CHUNK_BYTES}) AS BIGINT) - 1 END AS last_chunk
FROM d
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * d.e[i])) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.e) = len(d.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM l UNION SELECT r.doc_id, l.b FROM reach r JOIN l ON l.a = r.other)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.least, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY 1) m ON m.doc_id = w.doc_id
"""

def _row(name: str, text: str) -> str:
    words = licenses._split(text)
    return f"('{name}', '{text.replace(chr(39), chr(39) * 2)}', {licenses.step(len(words))}, {min(licenses.SHINGLE, len(words))})"


_WORDS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_PARTS = "list_transform(range(1, len({0}) - size + 2), lambda i: {{'start': i - 1, 'shingle': array_to_string({0}[i:i + size - 1], ' ')}})"

#: All shingles of all texts meet those of the templates; each hit lies in at most two windows.
LICENSES = f"""
WITH t AS (SELECT license, step, size, {_WORDS.format("template")} AS tw FROM (VALUES {", ".join(_row(*t) for t in licenses.default_templates().items())}) v(license, template, step, size)),
u AS (SELECT DISTINCT license, step, size, shingle FROM (SELECT license, step, size, unnest({_PARTS.format("tw")}, recursive := true) FROM t)),
m AS (SELECT license, count(*) AS m FROM u GROUP BY 1),
d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
s AS (SELECT doc_id, size, unnest({_PARTS.format("words")}, recursive := true) FROM d, (SELECT DISTINCT size FROM t)),
h AS (SELECT doc_id, license, step, size, start, shingle FROM s JOIN u USING (size, shingle)),
w AS (SELECT *, unnest([start // step * step, start // step * step - step]) AS place FROM h),
c AS (SELECT doc_id, license, place, count(DISTINCT shingle) / any_value(m) AS containment FROM w JOIN m USING (license) WHERE place >= 0 AND start + size <= place + 2 * step GROUP BY 1, 2, 3)
SELECT doc_id, license, CAST(min(place) AS INTEGER) AS first_word, count(*) AS windows, max(containment) AS containment FROM c WHERE containment >= {licenses.CONTAINMENT} GROUP BY 1, 2
"""

#: As op12 has it: labels of every seventh row move on.
NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = d.label AS same, d.vec_id, CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * d.e[i])) AS BIGINT) AS score FROM v a JOIN v d ON a.vec_id <> d.vec_id AND len(a.e) = len(d.e) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def _codebooks() -> str:
    parts, rounds = vector_codes.PARTS, vector_codes.ROUNDS
    near = "SELECT p.part, p.row, min(struct_pack(gap := list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i]))), entry := c.entry)) AS best FROM p JOIN c{0} c USING (part) GROUP BY 1, 2"
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor({vector_codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT row, part, list_slice(e, part * (len(e) // {parts}) + 1, (part + 1) * (len(e) // {parts})) AS x FROM v, range({parts}) t(part))",
        f"c0 AS MATERIALIZED (SELECT part, row - 1 AS entry, x FROM p WHERE row <= {vector_codes.ENTRIES})",
    ]
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(r)})")
        steps.append(f"m{r} AS (SELECT part, entry, list(CAST(floor(total / n) AS BIGINT) ORDER BY i) AS x FROM (SELECT part, best.entry AS entry, i, sum(x[i]) AS total, count(*) AS n FROM a{r} JOIN p USING (part, row), range(1, len(x) + 1) t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2)")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (part, entry))")
    steps.append(f"a{rounds} AS ({near.format(rounds)})")
    steps.append(f"b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})")
    steps.append(f"r AS (SELECT row, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.gap) AS BIGINT) AS error FROM a{rounds} GROUP BY 1)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN v USING (row), b"


CODEBOOKS = _codebooks()
