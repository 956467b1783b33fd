"""DuckDB SQL for the numbered operators that SQL can express, over the same tables."""

from __future__ import annotations

OP2 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""

OP4 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS bound FROM s),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM w) - coalesce(sum(bound) OVER o, 0))::BIGINT::DOUBLE
          / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER o, 0))::BIGINT::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY bound::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT max(level) AS level FROM l WHERE bound::DOUBLE / weight > level),
t AS (SELECT source, source_size, least(bound::DOUBLE, coalesce(v.level * weight, bound::DOUBLE)) AS target FROM w, v),
p AS (
  SELECT doc_id, size, source_size, target, floor(target + 0.5)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size > 0 THEN (budget // source_size) * size
            + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) ELSE 0 END::BIGINT AS taken
FROM p
"""

OP3 = r"""
WITH d AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
             '<|' || role || '|>' || chr(10) || text || chr(10) AS shown, CASE WHEN role = 'assistant' THEN '1' ELSE '0' END AS trained FROM d),
m AS (SELECT conv_id, max(place) AS last FROM t GROUP BY conv_id),
l AS (SELECT t.* FROM t JOIN m ON t.conv_id = m.conv_id AND place = last),
c AS (
  SELECT own.conv_id AS pair_id, own.place - CASE WHEN own.role = other.role AND own.text = other.text THEN 0 ELSE 1 END AS n_common, other.shown, other.trained
  FROM l own LEFT JOIN l other ON other.conv_id = own.conv_id + 1)
SELECT pair_id, n_common,
       coalesce(string_agg(t.shown, '' ORDER BY place) FILTER (WHERE place <= n_common), '') AS prompt,
       coalesce(string_agg(t.shown, '' ORDER BY place) FILTER (WHERE place > n_common), '') AS chosen,
       CASE WHEN n_common < max(place) THEN coalesce(any_value(c.shown), '') ELSE '' END AS rejected,
       coalesce(string_agg(t.trained, '' ORDER BY place) FILTER (WHERE place > n_common), '') AS chosen_mask,
       CASE WHEN n_common < max(place) THEN coalesce(any_value(c.trained), '') ELSE '' END AS rejected_mask
FROM c JOIN t ON t.conv_id = pair_id GROUP BY pair_id, n_common
"""

OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
         sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS digest
  FROM documents),
h AS (
  SELECT doc_id, text, tokens, len(tokens) AS n,
         ('0x' || substr(digest, 1, 8))::BIGINT % (len(tokens) + 1) AS one, ('0x' || substr(digest, 9, 8))::BIGINT % (len(tokens) + 1) AS two,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR ('0x' || substr(digest, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || substr(digest, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT doc_id, text, n, form, array_to_string(tokens[1:least(one, two)], '') AS prefix,
         array_to_string(tokens[least(one, two) + 1:greatest(one, two)], '') AS middle, array_to_string(tokens[greatest(one, two) + 1:], '') AS suffix
  FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""



OP13 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages),
r AS (SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS first_id FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id NULLS LAST)),
d AS (
  SELECT digest, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(digest, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1), '' ORDER BY i) AS base32
  FROM (SELECT DISTINCT digest FROM p), range(32) g(i) GROUP BY digest)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, base32 AS payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN first_id END AS refers_to
FROM r JOIN d USING (digest)
"""


def _clustering(clusters: int, rounds: int) -> str:
    """Lloyd's rounds, one pair of steps (nearest centroid, means) after another."""
    steps = [f"""WITH e AS (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
      FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, 'null')) AS h, v FROM e ORDER BY h, v LIMIT {clusters}))"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (SELECT row, any_value(vec_id) AS vec_id, any_value(e.v) AS v,
      arg_min(c, (list_sum(list_transform(list_zip(e.v, k.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c)) AS c,
      min(list_sum(list_transform(list_zip(e.v, k.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM e CROSS JOIN c{r} k GROUP BY row)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, generate_series(1, 64) g(i) GROUP BY c, i),
m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY c),
c{r + 1} AS (SELECT k.c, coalesce(m.v, k.v) AS v FROM c{r} k LEFT JOIN m{r} m ON m.c = k.c)""")
    return ",\n".join(steps) + f"""
SELECT vec_id, a.c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(k.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} k ON k.c = a.c"""


ORACLES = {
    "op2_exact_dedup": OP2,
    "op3_preference_format": OP3,
    "op4_source_mixing": OP4,
    "op11_fill_in_middle": OP11,
    "op13_warc_round_trip": OP13,
    "op12_centroid_clustering": _clustering(16, 3),
}
