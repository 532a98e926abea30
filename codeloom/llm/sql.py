"""DuckDB SQL for the queries of this subpackage that SQL can express.

Tokenizers, learned scores, hashes that DuckDB lacks and byte windows are not
expressible, or not in any time; tests hold those queries against brute force.
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

OP1 = f"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
), s AS (
  SELECT n, doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), x AS (SELECT n, unnest(s) AS sh, len(s) AS size FROM s
), p AS (SELECT a.n AS a, b.n AS b FROM x a JOIN x b ON a.sh = b.sh AND a.n <> b.n GROUP BY a.n, b.n, a.size, b.size HAVING 100 * count(*) >= 75 * (a.size + b.size - count(*))
), r AS (SELECT n AS a, n AS b FROM s UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(t.doc_id) AS component_id
FROM r JOIN s ON s.n = r.a JOIN s t ON t.n = r.b GROUP BY s.n, s.doc_id, s.s
"""

OP5 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM p WHERE p.a = v.vec_id) AS n_links, component_id, component_id = v.vec_id AS kept FROM v JOIN c ON c.a = v.vec_id
"""

OP6 = f"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS place FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1]::DOUBLE AS weight, 3 * source_size AS cap FROM s
), f AS (
  SELECT *, coalesce(sum(cap) OVER o, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS left_weight, sum(source_size) OVER () AS budget
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (SELECT *, (budget - capped)::DOUBLE / left_weight AS here FROM f
), t AS (SELECT source, source_size, weight, least(cap::DOUBLE, (SELECT max(here) FROM l WHERE here * weight <= cap) * weight) AS target FROM l
), r AS (
  SELECT d.*, t.source_size, t.target, t.weight, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.size, d.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + d.size / 2.0 AS middle
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source
), q AS (
  SELECT r.n, r.size, sum(r.size) OVER (ORDER BY (k.k * source_size + middle) / weight, place, size, k.k, r.n ROWS UNBOUNDED PRECEDING) AS upto FROM r, (VALUES (0), (1), (2)) k(k) WHERE size > 0
), c AS (SELECT n, count(*) AS copies FROM q WHERE upto <= (SELECT sum(size) FROM d) GROUP BY n)
SELECT doc_id, size, source_size, target, CAST(coalesce(copies, 0) * size AS BIGINT) AS taken FROM r LEFT JOIN c USING (n)
"""


OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, [CAST('0x' || substr(h, 1 + 8 * i, 8) AS BIGINT) FOR i IN range(4)] AS r FROM d
), p AS (SELECT doc_id, t, u, len(u) AS n, least(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS lo, greatest(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u
), c AS (SELECT *, array_to_string(u[1:lo], '') AS a, array_to_string(u[lo + 1:hi], '') AS b, array_to_string(u[hi + 1:], '') AS c FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256 FROM c
"""


def clusters(rounds: int = 10) -> str:
    """Rounds of assignment and means, a table each; a vector has a row for each component."""
    best = "SELECT n, min({'d': d, 'k': k}) AS b FROM (SELECT v.n, c.k, sum((v.x - c.x) * (v.x - c.x)) AS d FROM x v JOIN c%d c USING (i) GROUP BY v.n, c.k) GROUP BY n"
    steps = """
WITH e AS (SELECT row_number() OVER () AS n, vec_id, embedding AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (SELECT n, i, CAST(floor(1024 * CAST(e[i] AS DOUBLE)) AS BIGINT) AS x FROM e, range(1, 65) r(i)
), s AS (SELECT n, row_number() OVER (ORDER BY sha256('3:' || vec_id), n) - 1 AS k FROM e QUALIFY k < 8
), c0 AS MATERIALIZED (SELECT k, i, x FROM s JOIN x USING (n))"""
    for r in range(rounds):
        mean = "CAST((s - ((s % m) + m) % m) // m AS BIGINT)"
        steps += f""", a{r} AS MATERIALIZED ({best % r}
), c{r + 1} AS MATERIALIZED (SELECT c.k, c.i, coalesce({mean}, c.x) AS x FROM c{r} c LEFT JOIN (SELECT a.b.k AS k, i, sum(x) AS s, count(*) AS m FROM a{r} a JOIN x USING (n) GROUP BY a.b.k, i) t USING (k, i))"""
    return steps + f""", a AS MATERIALIZED ({best % rounds}
), h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY k)
SELECT e.vec_id, CAST(a.b.k AS INT) AS cluster, CAST(a.b.d AS BIGINT) AS distance, CAST(sum(a.b.d) OVER (PARTITION BY a.b.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.b.d) OVER () AS BIGINT) AS inertia, h.h AS centroid_sha256
FROM a JOIN e USING (n) JOIN h ON h.k = a.b.k"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": OP1, "op5_embedding_dedup": OP5, "op6_mixing": OP6, "op11_fill_in_middle": OP11, "op13_centroid_clustering": clusters()}
