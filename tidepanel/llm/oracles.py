"""SQL twins of the queries that SQL can express; exact joins take the place of the methods."""

ORACLES: dict[str, str] = {}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# components by reachability; both link tables are small where these run
_REACH = """, reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)"""

ORACLES["op1_minhash"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(COALESCE(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, UNNEST(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
-- a pair above the threshold shares one of the rarest shingles of either side
f AS (SELECT s, COUNT(*) AS f FROM s GROUP BY 1),
p AS (SELECT doc_id, s FROM (SELECT s.doc_id, s.s, n.n, ROW_NUMBER() OVER (PARTITION BY s.doc_id ORDER BY f.f, s.s) AS r
    FROM s JOIN f USING (s) JOIN n USING (doc_id)) WHERE r <= n - CEIL(n * 0.8) + 1),
c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p x JOIN p y ON x.s = y.s AND x.doc_id <> y.doc_id),
links AS MATERIALIZED (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND x.s = y.s
    JOIN n nx ON nx.doc_id = a JOIN n ny ON ny.doc_id = b GROUP BY a, b, nx.n, ny.n
    HAVING 100 * COUNT(*) >= 80 * (nx.n + ny.n - COUNT(*)))
{_REACH}
SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, LEAST(d.doc_id, COALESCE(m.m, d.doc_id)) AS component_id,
  d.doc_id <= COALESCE(m.m, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, MIN(b) AS m FROM reach GROUP BY 1) m USING (doc_id)"""

ORACLES["op2_embeddings"] = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id
    AND list_cosine_similarity(x.e, y.e) >= 0.95)
{_REACH}
SELECT v.vec_id, COALESCE(l.n, 0) AS n_links, LEAST(v.vec_id, COALESCE(m.m, v.vec_id)) AS component_id,
  v.vec_id <= COALESCE(m.m, v.vec_id) AS kept
FROM v LEFT JOIN (SELECT a AS vec_id, COUNT(*) AS n FROM links GROUP BY 1) l USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, MIN(b) AS m FROM reach GROUP BY 1) m USING (vec_id)"""

ORACLES["op6_warc"] = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS html, sha1(COALESCE(html, '')) AS hex FROM pages),
d AS (SELECT page_id, strlen(html) AS n, MIN(page_id) OVER (PARTITION BY hex) AS first,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5))::INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1, 1)), '') AS digest FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""


def license_sql(phrases: dict[str, str], templates: dict[str, str], share: int, window: int, step: int) -> str:
    """Twin of the license scan: every block against every template."""
    def listed(words):
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    bases = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, i - 1 AS place FROM (SELECT doc_id, w, UNNEST(range(1, len(w) + 1)) AS i FROM w "
        f"WHERE list_contains(w, '{max(phrase.split(), key=len)}')) WHERE w[i:i + {len(phrase.split()) - 1}] = {listed(phrase.split())}"
        for label, phrase in phrases.items())
    wanted = ", ".join(f"('{label}', {listed(sorted(set(text.split())))})" for label, text in templates.items())
    return rf"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), '{_UPPER}', '{_LOWER}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
base AS ({bases}),
t(label, t) AS (VALUES {wanted}),
blocks AS (SELECT doc_id, w[i + 1:i + {window}] AS b FROM (SELECT doc_id, w, UNNEST(range(0, GREATEST(len(w), 1), {step})) AS i FROM w)),
hits AS (SELECT doc_id, label, MAX(len(list_intersect(t, b)) / len(t)) AS share FROM blocks, t
    WHERE len(list_intersect(t, b)) * 100 >= {share} * len(t) GROUP BY 1, 2)
SELECT w.doc_id, len(w.w) AS n_words, COALESCE(n.n, 0) AS n_base, n.lo AS first_word, n.hi AS last_word,
  COALESCE(n.labels, '') AS base_labels,
  COALESCE((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM hits) x
     WHERE x.doc_id = w.doc_id), '') AS labels,
  CASE WHEN n.n > 0 THEN 1.0 ELSE COALESCE((SELECT MAX(share) FROM hits h WHERE h.doc_id = w.doc_id), 0.0) END::DOUBLE AS score
FROM w LEFT JOIN (SELECT doc_id, COUNT(*) AS n, MIN(place) AS lo, MAX(place) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM base GROUP BY 1) n USING (doc_id)"""


ORACLES["op8_chat"] = """
WITH c AS (SELECT conv_id, turn, COALESCE(text, '') AS text, turn % 6 AS k, regexp_split_to_array(COALESCE(text, ''), '[ \n]')[1] AS head
  FROM conversations WHERE role = 'user'),
calls AS (SELECT conv_id, turn, CASE WHEN k < 2 THEN 'lookup' WHEN k < 4 THEN 'measure' ELSE 'note' END AS name,
  CASE WHEN k < 2 THEN '{"query":' || to_json(head) || ',"words":' || len(string_split(text, ' ')) || '}'
    WHEN k < 4 THEN '{"length":' || length(text) || ',"short":' || CASE WHEN length(text) < 100 THEN 'true' ELSE 'false' END || '}'
    ELSE '{"text":' || to_json(head) || '}' END AS arguments FROM c),
-- turns that are calls of their conversation and need each other by halving
up(conv_id, turn, depth, spot) AS (SELECT * FROM (WITH RECURSIVE r(conv_id, turn, depth, spot) AS (
    SELECT conv_id, turn, 0, turn FROM calls
    UNION ALL SELECT r.conv_id, r.turn, r.depth + 1, p.turn FROM r JOIN (SELECT DISTINCT conv_id, turn FROM calls) p
      ON p.conv_id = r.conv_id AND p.turn = r.spot // 2 AND r.spot // 2 < r.spot) SELECT * FROM r)),
deep AS (SELECT conv_id, turn, MAX(depth) AS depth FROM up GROUP BY 1, 2),
results AS (SELECT conv_id, turn - 1 AS turn, COALESCE(text, '') AS content FROM conversations WHERE role = 'assistant'),
rows AS (SELECT COALESCE(c.conv_id, r.conv_id) AS conv_id, COALESCE(c.turn, r.turn) AS turn, c.name, c.arguments, r.content,
    CASE WHEN c.name IS NULL THEN 'no_call' WHEN r.content IS NULL THEN 'no_result' ELSE 'linked' END AS status
  FROM calls c FULL JOIN results r ON r.conv_id = c.conv_id AND r.turn = c.turn)
SELECT rows.conv_id, CAST(rows.turn AS VARCHAR) AS call_id, name, CAST(CASE WHEN name IS NOT NULL THEN depth END AS INTEGER) AS depth, status,
  CASE WHEN name IS NOT NULL THEN name <> 'note' END AS valid,
  CASE WHEN name = 'note' THEN 'missing:turn' WHEN name IS NOT NULL THEN '' END AS errors, arguments, content
FROM rows LEFT JOIN deep ON deep.conv_id = rows.conv_id AND deep.turn = rows.turn"""


def _cluster_sql(k: int = 8, rounds: int = 10, dimensions: int = 64, scale: int = 1024) -> str:
    """Every vector against every centroid in each round, in whole numbers."""
    far = "list_sum(list_transform(list_zip(v.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, v, k, d FROM (SELECT v.vec_id, v.v, c.k, {far} AS d,
    ROW_NUMBER() OVER (PARTITION BY v.vec_id ORDER BY {far}, c.k) AS r FROM v, c{r} c) WHERE r = 1)""")
        if r < rounds:
            steps.append(f"""
s{r} AS (SELECT k, i, SUM(x) AS s, COUNT(*) AS n FROM (SELECT k, UNNEST(v) AS x, UNNEST(range({dimensions})) AS i FROM a{r}) GROUP BY 1, 2),
m{r} AS (SELECT k, LIST(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{r} GROUP BY 1),
c{r + 1} AS MATERIALIZED (SELECT c.k, COALESCE(m.c, c.c) AS c FROM c{r} c LEFT JOIN m{r} m USING (k))""")
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(FLOOR({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: isfinite(CAST(x AS DOUBLE)))) = {dimensions}),
c0 AS MATERIALIZED (SELECT ROW_NUMBER() OVER (ORDER BY h) - 1 AS k, v AS c FROM (
    SELECT sha256('3:' || vec_id) AS h, v FROM v ORDER BY h LIMIT {k})),{",".join(steps)}
SELECT a.vec_id, a.k::INT AS cluster, a.d AS distance, SUM(a.d) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia,
    SUM(a.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (k)"""


ORACLES["op12_zonemaps"] = _cluster_sql()
