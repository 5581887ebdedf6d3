"""DuckDB SQL for the operators' queries."""

from __future__ import annotations

import hashlib

from .license_texts import TEMPLATES


def _slots(shards: int, slots: int) -> str:
    """The lookup table as a SQL list, filled here by following each claim in time order."""
    h = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:15], 16)
    orders = []
    for s in range(shards):
        start, stride = h(f"start:{s}") % slots, h(f"stride:{s}") % (slots - 1) + 1
        orders.append(iter([(start + j * stride) % slots for j in range(slots)]))
    owner: dict[int, int] = {}
    turn = 0
    while len(owner) < slots:
        owner[next(x for x in orders[turn % shards] if x not in owner)] = turn % shards
        turn += 1
    return "[" + ",".join(str(owner[i]) for i in range(slots)) + "]"


OP5 = f"""
WITH keyed AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null:' || coalesce(text, ''))), 1, 15))::BIGINT % 6421 AS slot
  FROM documents
)
SELECT doc_id, CAST(slot AS INTEGER) AS slot, CAST(({_slots(64, 6421)})[slot + 1] AS INTEGER) AS shard FROM keyed
"""

OP3 = r"""
WITH sized AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS src, hash(text) AS th,
         ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS key
  FROM documents
), sources AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * sum(size) AS most,
         CAST([5, 2, 1][(row_number() OVER (ORDER BY src) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM sized GROUP BY src
), levels AS (
  SELECT *, (SELECT sum(source_size) * 1.5::DOUBLE FROM sources) AS total,
         coalesce(sum(most) OVER (ORDER BY most / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
         sum(weight) OVER (ORDER BY most / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares
  FROM sources
), level AS (
  SELECT max((total - spent) / shares) FILTER (WHERE (total - spent) / shares * weight <= most) AS level FROM levels
), targets AS (
  SELECT src, source_size, least(weight * coalesce(level, 1e300), most) AS target FROM sources, level
), placed AS (
  SELECT s.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         sum(size) OVER (PARTITION BY src ORDER BY key, doc_id, size, th ROWS UNBOUNDED PRECEDING) - size AS start
  FROM sized s JOIN targets t USING (src)
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
                 ELSE budget // source_size * size + least(size, greatest(0, budget % source_size - start)) END AS BIGINT) AS taken
FROM placed
"""

OP7 = r"""
WITH d AS (
  SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents
), b AS (
  SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM benchmark
), dt AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM d
), bt AS (SELECT item_id, len(ws) AS m, least(13, len(ws)) AS width, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS q FROM b
), eq AS (
  SELECT DISTINCT doc_id, item_id, m, width, p - q AS diag, q FROM dt JOIN bt USING (w)
), near AS (
  SELECT doc_id, item_id, m, width, diag, list(q) AS qs FROM eq GROUP BY ALL HAVING count(*) >= ceil(0.8 * width - 1e-9)
), win AS (
  SELECT doc_id, item_id, width, diag, s, len(list_filter(qs, lambda q: q >= s AND q < s + width)) AS same
  FROM (SELECT *, unnest(generate_series(0, m - width)) AS s FROM near)
)
SELECT doc_id, item_id, CAST(max(same) AS INTEGER) AS best, CAST(max(width) AS INTEGER) AS width,
       CAST(min(diag + s) AS INTEGER) AS first_word, CAST(max(diag + s + width - 1) AS INTEGER) AS last_word
FROM win WHERE same >= ceil(0.8 * width - 1e-9) GROUP BY doc_id, item_id
"""


def _templates() -> str:
    quoted = [f"({i}, '{name}', '" + text.replace("'", "''") + "')" for i, (name, _, text) in enumerate(TEMPLATES)]
    return ", ".join(quoted)


OP1 = r"""
WITH t AS (
  SELECT i, name, regexp_extract_all(lower(body), '[\p{L}\p{N}]+') AS ws FROM (VALUES %s) v(i, name, body)
), tl AS (
  SELECT i, name, len(ws) - 1 AS m, list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1]) AS g FROM t
), tg AS (
  SELECT i, m, gram, count(*) AS c FROM (SELECT i, m, unnest(g) AS gram FROM tl) GROUP BY ALL
), d AS (
  SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents
), dg AS (
  SELECT doc_id, row_id, list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1]) AS g FROM d WHERE len(ws) > 1
), gp AS (
  SELECT row_id, unnest(g) AS gram, generate_subscripts(g, 1) AS p FROM dg
), every AS (
  SELECT row_id, i, m, c, gram, p FROM gp JOIN tg USING (gram)
), likely AS (
  SELECT row_id, i FROM (SELECT row_id, i, m, gram, least(count(*), any_value(c)) AS s FROM every GROUP BY row_id, i, m, gram)
  GROUP BY row_id, i, m HAVING sum(s) >= m * 0.8 / 1.2 - 1e-9
), hit AS (
  SELECT every.* FROM every SEMI JOIN likely USING (row_id, i)
), win AS (
  SELECT a.row_id, a.i, a.m, a.p AS s, b.p AS e FROM hit a JOIN hit b ON a.row_id = b.row_id AND a.i = b.i
  WHERE b.p - a.p + 1 BETWEEN a.m * 0.8 / 1.2 - 1e-9 AND a.m * 1.2 / 0.8 + 1e-9
), same AS (
  SELECT row_id, i, m, s, e, gram, least(count(*), any_value(c)) AS n FROM win JOIN hit USING (row_id, i, m)
  WHERE p BETWEEN s AND e GROUP BY row_id, i, m, s, e, gram
), scored AS (
  SELECT row_id, i, s, e, 2.0::DOUBLE * sum(n) / (e - s + 1 + m) AS dice FROM same GROUP BY row_id, i, m, s, e
), best AS (
  SELECT *, row_number() OVER (PARTITION BY row_id, i ORDER BY dice DESC, s, e) AS rn FROM scored
)
SELECT doc_id, name AS license_id, CAST(i AS INTEGER) AS template, round(dice, 6) AS dice, CAST(s - 1 AS INTEGER) AS first_word,
       CAST(e - s + 2 AS INTEGER) AS n_words
FROM best JOIN dg USING (row_id) JOIN tl USING (i) WHERE rn = 1 AND dice >= 0.8 - 1e-9
""" % _templates()

OP12 = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'r': r, 'x': x} ORDER BY pos) AS turns,
         list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
           lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS crc
  FROM t GROUP BY conv_id
), headed AS (
  SELECT conv_id, turns, xor(crc, 4294967295) % 6 AS h FROM own
), rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(l.turns, [])[1:o.h], o.turns[o.h + 1:len(o.turns)]) AS seq
  FROM headed o LEFT JOIN headed l ON l.conv_id = o.conv_id - o.conv_id % 100
), prefixes AS (
  SELECT conv_id, d AS depth, seq[1:d] AS prefix, len(seq) = d AS whole FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE whole), '')) AS ends_sha256,
         (count(*) - 1) * coalesce(length(prefix[depth].x), 0) AS own
  FROM prefixes GROUP BY depth, prefix
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, count(c.depth) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
  LEFT JOIN (SELECT depth - 1 AS depth, prefix[1:depth - 1] AS prefix FROM nodes WHERE depth > 0) c ON c.depth = n.depth AND c.prefix = n.prefix
  GROUP BY ALL
), below AS (
  SELECT a AS depth, prefix[1:a] AS prefix, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM linked) GROUP BY ALL
)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM linked JOIN below USING (depth, prefix)
"""


def _rounds(rounds: int) -> str:
    """The rounds of assigning and averaging, and the last assignment, as further parts of a WITH clause."""
    parts = []
    for k in range(rounds + 1):
        parts.append(f"""d{k} AS MATERIALIZED (
  SELECT r, part, e, sum((c.x - b.x) * (c.x - b.x)) AS d FROM c JOIN b{k} b USING (part, w) GROUP BY r, part, e
), a{k} AS MATERIALIZED (
  SELECT r, part, min(d) AS d, min_by(e, d * 1000 + e) AS e FROM d{k} GROUP BY r, part
)""")
        if k < rounds:
            parts.append(f"""b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.e, b.w, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
    SELECT part, e, w, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM a{k} JOIN c USING (r, part) GROUP BY part, e, w
  ) m USING (part, e, w)
)""")
    return ", ".join(parts)


OP13 = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, ints) AS r, * FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  )
), c AS MATERIALIZED (
  SELECT r, i // w4 AS part, i % w4 AS w, ints[i + 1] AS x FROM (SELECT r, ints, len(ints) // 4 AS w4, unnest(range(0, len(ints))) AS i FROM v)
), b0 AS MATERIALIZED (
  SELECT part, r - 1 AS e, w, x FROM c WHERE r <= 256
), {_rounds(4)}, coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 JOIN v USING (r) GROUP BY r, vec_id, label
), books AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, e, w)) AS codebooks_sha256 FROM b4
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, books
"""

ORACLES = {"op1_license_scan": OP1, "op3_mix_sources": OP3, "op5_sharding": OP5, "op7_decontamination": OP7, "op12_conversation_trie": OP12, "op13_vector_codes": OP13}
