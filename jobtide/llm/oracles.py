"""SQL counterparts of this subpackage's queries, where SQL can express them."""

ORACLES: dict[str, str] = {}

ORACLES["op11_source_divergence"] = r"""
WITH d AS (
 SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
 SELECT k, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 30),
langs AS (
 SELECT lang, count(term) AS v, coalesce(sum(total), 0) AS n FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counted AS (
 SELECT g.lang, g.source, kept.term, kept.total, coalesce(c.n, 0) AS n FROM groups g JOIN kept ON kept.lang = g.lang
 LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
sums AS (SELECT lang, source, sum(n) AS n FROM counted GROUP BY ALL),
p AS (
 SELECT counted.lang, counted.source, term, counted.n AS c,
  1 + (1000000000 * (counted.n + 5)::HUGEINT) // (sums.n + 5 * v)::HUGEINT AS p,
  1 + (1000000000 * (total + 5)::HUGEINT) // (langs.n + 5 * v)::HUGEINT AS q
 FROM counted JOIN sums USING (lang, source) JOIN langs ON langs.lang = counted.lang),
found AS (
 SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
  coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term
   WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
 UNION ALL
 SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q),
ranked AS (
 SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def _clustering(rounds: int, clusters: int, dimensions: int) -> str:
    """One pair of steps per round: assign every vector, then move the centroids that have some."""
    steps = [
        f"""x AS MATERIALIZED (
 SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
 FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dimensions}),
c0 AS MATERIALIZED (
 SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)) NULLS LAST, x) - 1 AS INTEGER) AS cluster, x AS c FROM x
 QUALIFY cluster < {clusters})"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
 SELECT k, vec_id, x, cluster, d FROM (
  SELECT k, vec_id, x, cluster, list_sum(list_transform(generate_series(1, {dimensions}), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS d FROM x, c{r})
 QUALIFY row_number() OVER (PARTITION BY k ORDER BY d, cluster) = 1)"""
        )
        if r < rounds:
            steps.append(
                f"""m{r} AS MATERIALIZED (
 SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
  SELECT cluster, i, sum(e) AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY ALL)
 GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT c{r}.cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))"""
            )
    return f"""WITH {", ".join(steps)}
SELECT vec_id, cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
 CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (cluster)"""


ORACLES["op13_centroid_clustering"] = _clustering(10, 8, 64)

ORACLES["op4_jaccard_join"] = r"""
WITH RECURSIVE w AS MATERIALIZED (
 SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
 FROM documents),
s AS MATERIALIZED (
 SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
 FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
 SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN s q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY ALL) x
 JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(b) AS component_id FROM reach LEFT JOIN n ON n.doc_id = a GROUP BY a
"""

#: Five bytes of the digest, as a number, are eight letters.
_LETTERS = (
    "array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',"
    " 1 + CAST((list_sum(list_transform(generate_series(1, 10), lambda j: CAST(instr('0123456789abcdef', substr(hex, 10 * (i // 8) + j, 1)) - 1 AS BIGINT)"
    " << CAST(4 * (10 - j) AS INT)))::BIGINT >> CAST(35 - 5 * (i % 8) AS INT)) & 31 AS INT), 1)), '')"
)
ORACLES["op6_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS stored FROM pages)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_LETTERS} AS payload_digest,
 CASE WHEN page_id = stored THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> stored THEN stored END AS refers_to FROM p
"""
