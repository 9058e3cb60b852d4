"""One query for each operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchloom.llm import (
    centroids, codebooks, context_tree, decontaminate, language, line_dedup, mixture, near_dup, passages, secret_scan, token_counts, toxicity, vector_dups)
from matchloom.llm.tables import read

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return decontaminate.contamination(docs, read(spark, sf_dir, "benchmark", "item_id", "text")).drop("row")


DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, l, array_to_string(w[p:p + l - 1], ' ') AS s
  FROM (SELECT item_id, w, least(13, len(w)) AS l, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, l, p, array_to_string(w[p:p + l - 1], ' ') AS s
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l)),
m AS (SELECT doc_id, item_id, p, l FROM dw JOIN iw USING (l, s)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit, cast(coalesce(n_items, 0) AS bigint) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


def source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture(read(spark, sf_dir, "documents", "doc_id", "text", "source"))


MIXTURE = r"""
WITH d AS (SELECT doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS bigint) AS size,
  cast('0x' || substr(md5(cast(doc_id AS varchar)), 1, 15) AS bigint) AS place FROM documents),
s AS (SELECT source, source_size, cast(3 * source_size AS double) AS most, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM (SELECT source, cast(sum(size) AS bigint) AS source_size FROM d GROUP BY source)),
f AS (SELECT *, (cast(sum(source_size) OVER () AS double) - coalesce(sum(most) OVER b, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) * weight > most AS is_full
  FROM s WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN is_full THEN most ELSE weight * (cast(sum(source_size) OVER () AS double)
  - sum(CASE WHEN is_full THEN most ELSE 0.0 END) OVER ()) / sum(CASE WHEN NOT is_full THEN weight END) OVER () END AS target FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN cast(floor(target / source_size) AS bigint) ELSE 0 END AS copies FROM t),
r AS (SELECT d.*, source_size, target, copies, target - copies * source_size AS extra,
  sum(size) OVER (PARTITION BY d.source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(size) OVER (PARTITION BY d.source, place) AS own
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, cast(size * (copies + CASE WHEN upto <= extra OR (upto - own <= extra AND 2 * (extra - (upto - own)) >= own) THEN 1 ELSE 0 END) AS bigint) AS taken
FROM r"""


def line_dedup_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(read(spark, sf_dir, "documents", "doc_id", "text"))


#: Runs of every length: a run of l + 1 lines is repeated only if its first l lines are. g numbers all lines, cls is where the same run begins first.
LINES = f"""
WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents WHERE text IS NOT NULL),
t AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id, p) AS g FROM (SELECT doc_id, unnest(w) AS line, unnest(range(len(w))) AS p FROM d)),
r AS (SELECT 1 AS l, g, cls, length(line) AS chars
  FROM (SELECT g, line, min(g) OVER (PARTITION BY line) AS cls, count(*) OVER (PARTITION BY line) AS n FROM t) WHERE n > 1
  UNION ALL SELECT l, g, cls, chars
  FROM (SELECT r.l + 1 AS l, r.g, min(r.g) OVER (PARTITION BY r.cls, b.line) AS cls, count(*) OVER (PARTITION BY r.cls, b.line) AS n, r.chars + length(b.line) AS chars
    FROM r JOIN t a ON a.g = r.g JOIN t b ON b.g = r.g + r.l AND b.doc_id = a.doc_id) WHERE n > 1),
m AS (SELECT g, max(l) AS l, max(chars) AS chars FROM r WHERE cls <> g GROUP BY g),
x AS (SELECT DISTINCT g + unnest(range(l)) AS g FROM m WHERE chars >= {line_dedup.MIN_CHARS}),
y AS (SELECT doc_id, count(*) AS n, string_agg(cast(p AS varchar), ',' ORDER BY p) AS deleted FROM x JOIN t USING (g) GROUP BY doc_id)
SELECT documents.doc_id, cast(coalesce(len(w), 0) AS bigint) AS n_lines, cast(coalesce(n, 0) AS bigint) AS n_deleted, coalesce(deleted, '') AS deleted
FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN y USING (doc_id)"""


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def minmax_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))


NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  ELSE [array_to_string(w, ' ')] END) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)),
reach AS (SELECT a AS node, a AS r FROM l UNION SELECT l.b, reach.r FROM reach JOIN l ON l.a = reach.node WHERE reach.r < l.b),
m AS (SELECT node, min(r) AS r FROM reach GROUP BY node)
SELECT d.doc_id, cast(coalesce(n.n, 0) AS bigint) AS n_shingles, coalesce(m.r, d.doc_id) AS component_id, coalesce(m.r, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = d.doc_id"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dups.near_vectors(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


VECTORS = """
WITH RECURSIVE e AS (SELECT vec_id, label, cast(embedding AS double[]) AS v FROM embeddings),
u AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM e),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b USING (label)
  WHERE a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.98),
reach AS (SELECT a AS node, a AS r FROM l UNION SELECT l.b, reach.r FROM reach JOIN l ON l.a = reach.node WHERE reach.r < l.b),
m AS (SELECT node, min(r) AS r FROM reach GROUP BY node)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, coalesce(r, vec_id) AS component_id, coalesce(r, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN m ON node = vec_id"""


def token_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents", "doc_id", "text"))


def toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "toxic"))


def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(read(spark, sf_dir, "documents", "doc_id", "text"))


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(read(spark, sf_dir, "documents", "doc_id", "text"))


#: Vectors with finite components as whole numbers; vectors of this table are all of one length.
_WHOLE = """k AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda c: cast(floor(1024 * cast(c AS double)) AS bigint)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)"""


def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compressed(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def _codes_sql() -> str:
    """Every round compares each part with all entries; sums of squares are whole numbers below 2^53 in doubles."""
    out = [f"""WITH {_WHOLE},
p AS MATERIALIZED (SELECT rid, part, cast(x[part * len(x) // 4 + 1:(part + 1) * len(x) // 4] AS double[]) AS v FROM k, range(4) AS t(part)),
b0 AS MATERIALIZED (SELECT part, cast(row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS bigint) AS entry, v
  FROM p JOIN (SELECT min(rid) AS rid, vec_id FROM k GROUP BY vec_id ORDER BY vec_id LIMIT {codebooks.ENTRIES}) USING (rid))"""]
    for r in range(codebooks.ROUNDS + 1):
        out.append(f"""a{r} AS MATERIALIZED (SELECT rid, part, min_by(entry, (d, entry)) AS entry, min(d) AS d, any_value(v) AS v
  FROM (SELECT rid, p.part, entry, p.v, list_dot_product(p.v, p.v) - 2 * list_dot_product(p.v, b.v) + list_dot_product(b.v, b.v) AS d FROM p JOIN b{r} b USING (part)) GROUP BY rid, part)""")
        if r < codebooks.ROUNDS:
            out.append(f"""b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n.v, b.v) AS v FROM b{r} b LEFT JOIN (SELECT part, entry, list(s ORDER BY i) AS v
  FROM (SELECT part, entry, i, floor(sum(c) / count(*)) AS s FROM (SELECT part, entry, unnest(v) AS c, unnest(range(len(v))) AS i FROM a{r}) GROUP BY part, entry, i) GROUP BY part, entry) n USING (part, entry))""")
    last = codebooks.ROUNDS
    out.append(f"""t AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, cast(sum(d) AS bigint) AS error FROM a{last} GROUP BY rid),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda c: cast(cast(c AS bigint) AS varchar)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{last})
SELECT vec_id, code, error, cast(sum(error) OVER (PARTITION BY label) AS bigint) AS label_error, codebooks_sha256 FROM t JOIN k USING (rid), h""")
    return ",\n".join(out[:-1]) + ",\n" + out[-1]


def vector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def _clusters_sql() -> str:
    """Every round compares each vector with all centroids."""
    out = [f"""WITH {_WHOLE},
p AS MATERIALIZED (SELECT rid, vec_id, cast(x AS double[]) AS v FROM k WHERE len(x) = {centroids.WIDTH}),
c0 AS MATERIALIZED (SELECT cast(row_number() OVER (ORDER BY h) - 1 AS integer) AS cluster, v
  FROM (SELECT sha256('{centroids.SEED}:' || vec_id) AS h, any_value(v) AS v FROM p GROUP BY vec_id ORDER BY h LIMIT {centroids.CLUSTERS}))"""]
    for r in range(centroids.ROUNDS + 1):
        out.append(f"""a{r} AS MATERIALIZED (SELECT rid, min_by(cluster, (d, cluster)) AS cluster, min(d) AS d, any_value(v) AS v
  FROM (SELECT rid, cluster, p.v, list_dot_product(p.v, p.v) - 2 * list_dot_product(p.v, c.v) + list_dot_product(c.v, c.v) AS d FROM p, c{r} c) GROUP BY rid)""")
        if r < centroids.ROUNDS:
            out.append(f"""c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT cluster, list(s ORDER BY i) AS v
  FROM (SELECT cluster, i, floor(sum(q) / count(*)) AS s FROM (SELECT cluster, unnest(v) AS q, unnest(range(len(v))) AS i FROM a{r}) GROUP BY cluster, i) GROUP BY cluster) n USING (cluster))""")
    last = centroids.ROUNDS
    out.append(f"""SELECT vec_id, cluster, cast(d AS bigint) AS distance, cast(sum(d) OVER (PARTITION BY cluster) AS bigint) AS cluster_inertia, cast(sum(d) OVER () AS bigint) AS inertia,
  sha256(array_to_string(list_transform(c.v, lambda q: cast(cast(q AS bigint) AS varchar)), ',')) AS centroid_sha256
FROM a{last} JOIN c{last} c USING (cluster) JOIN p USING (rid)""")
    return ",\n".join(out[:-1]) + "\n" + out[-1]


def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.scored(read(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {
    "op1_secret_scan": secret_findings,
    "op2_decontamination": decontamination,
    "op3_toxicity": toxicity_trees,
    "op4_mixture": source_mixture,
    "op5_substring_dedup": substring_dedup,
    "op6_line_dedup": line_dedup_runs,
    "op7_language_id": language_id,
    "op8_minmax_near_dups": minmax_near_dups,
    "op9_token_counts": token_prefixes,
    "op10_vector_near_dups": vectors,
    "op11_vector_codes": vector_codes,
    "op12_centroid_clusters": vector_clusters,
    "op13_text_scores": text_scores,
}

ORACLES = {
    "op2_decontamination": DECONTAMINATION,
    "op4_mixture": MIXTURE,
    "op6_line_dedup": LINES,
    "op8_minmax_near_dups": NEAR,
    "op10_vector_near_dups": VECTORS,
    "op11_vector_codes": _codes_sql(),
    "op12_centroid_clusters": _clusters_sql(),
}
