"""Queries of the operators and of the pipeline, with SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import ann_scan, bpe_count, centroids, exact_topk, jaccard_join, langid, merkle, mixing, packing, paragraphs, quality_mil, simhash, suffix_dedup
from millrace.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.count_tokens(table(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk.search(vectors.filter("vec_id % 20 = 0"), vectors, 20)


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut(table(spark, sf_dir, "documents"))


def op7_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann_scan.search(vectors.filter("vec_id % 50 = 0"), vectors, 5)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.removals(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    found = {name: query for name, query in globals().items() if name.startswith("op") and callable(query)}
    return dict(sorted(found.items(), key=lambda item: int(item[0][2:].split("_")[0])))


#: Scores are exact integers, so SQL gives the same lists.
TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


#: crc32 has no function there: eight steps for each byte, as a table of 256 and a fold over digits.
MERKLE_SQL = """
WITH RECURSIVE bits AS (
  SELECT range AS byte, CAST(range AS UBIGINT) AS r, 0 AS step FROM range(256)
  UNION ALL SELECT byte, xor(r >> 1, (r & 1) * 3988292384), step + 1 FROM bits WHERE step < 8
), steps AS MATERIALIZED (SELECT list(r ORDER BY byte) AS t FROM bits WHERE step = 8),
docs AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
                lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS BIGINT) + 1])), 4294967295) % 7 = 0 AS tampers
  FROM documents, steps
), fields AS (
  SELECT doc_id, lang, n_chars, tampers, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
         coalesce(strlen(text) || ':' || text, '-') AS b
  FROM docs
), leaves AS (
  SELECT doc_id, lang, sha256(a || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || b) AS leaf,
         sha256(a || coalesce(strlen(CAST(CASE WHEN tampers THEN n_chars + 1 ELSE n_chars END AS VARCHAR)) || ':' || CASE WHEN tampers THEN n_chars + 1 ELSE n_chars END, '-') || b) AS tampered
  FROM fields
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), low AS (
  SELECT lang, 0 AS level, i, n, leaf AS h FROM placed
  UNION ALL SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY lang, level, i // 2, n
), subroots AS MATERIALIZED (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 0 AS level, i, n, subroot AS h FROM subroots
  UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY level, i // 2, n
), way AS (
  SELECT p.doc_id, p.leaf, p.i AS place, p.lang, o.level, (p.i >> o.level) % 2 AS side, s.h
  FROM placed p JOIN (SELECT DISTINCT lang, level, n FROM low WHERE n > 1) o ON o.lang IS NOT DISTINCT FROM p.lang
  LEFT JOIN low s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = o.level AND s.i = xor(p.i >> o.level, 1)
  UNION ALL
  SELECT p.doc_id, p.leaf, p.i, p.lang, 100 + o.level, (r.i >> o.level) % 2, s.h
  FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang CROSS JOIN (SELECT DISTINCT level FROM high WHERE n > 1) o
  LEFT JOIN high s ON s.level = o.level AND s.i = xor(r.i >> o.level, 1)
), ways AS (
  SELECT lang, place, list(CASE WHEN h IS NULL THEN '-' WHEN side = 1 THEN 'l' || h ELSE 'r' || h END ORDER BY level) AS steps FROM way GROUP BY lang, place
), found AS (
  SELECT p.doc_id, p.leaf, r.subroot, (SELECT h FROM high WHERE n = 1) AS root, coalesce(w.steps, []) AS steps, p.tampered
  FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang LEFT JOIN ways w ON w.lang IS NOT DISTINCT FROM p.lang AND w.place = p.i
), folded AS (
  SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) AS proof_sha256,
         list_reduce(list_prepend(tampered, steps), lambda h, s: sha256(CASE s[1] WHEN 'l' THEN s[2:] || h WHEN 'r' THEN h || s[2:] ELSE h END)) AS folded_root
  FROM found
)
SELECT *, folded_root = root AS verified FROM folded
"""


#: Pairs that share one of the rarest shingles of each, as many as similar sets must; then links, then what they reach.
JACCARD_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, r, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                    ELSE list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) END AS s
  FROM words
), sizes AS MATERIALIZED (SELECT r, doc_id, len(s) AS n FROM sets),
named AS MATERIALIZED (SELECT r, len(s) AS n, unnest(s) AS g FROM sets),
counted AS (SELECT g, count(*) AS df FROM named GROUP BY g),
ordered AS (SELECT r, n, g, row_number() OVER (PARTITION BY r ORDER BY df, g) AS place FROM named JOIN counted USING (g)),
early AS MATERIALIZED (SELECT r, n, g FROM ordered WHERE place <= n - ceil(n * 9 / 10.0) + 1),
near AS (SELECT DISTINCT a.r AS x, b.r AS y FROM early a JOIN early b ON a.g = b.g AND a.r < b.r AND 10 * b.n >= 9 * a.n AND 10 * a.n >= 9 * b.n),
links AS MATERIALIZED (
  SELECT x, y FROM near JOIN sets a ON a.r = x JOIN sets b ON b.r = y
  WHERE 190 * len(list_intersect(a.s, b.s)) >= 90 * (len(a.s) + len(b.s))
), both_ AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT r, r FROM sets UNION SELECT reach.x, both_.y FROM reach JOIN both_ ON both_.x = reach.y)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id
FROM sizes JOIN (SELECT x, min(d.doc_id) AS component_id FROM reach JOIN sizes d ON d.r = y GROUP BY x) ON x = r
"""


def clustering_sql(k: int = 8, rounds: int = 10) -> str:
    """Every round as three steps: nearest centroids, sums by component, new centroids."""
    ctes = [
        """v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), vec_id) - 1 AS INTEGER) AS k, e AS c FROM v QUALIFY k < {k})",
    ]
    for r in range(rounds + 1):
        square = "CAST(list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, e, k, {square} AS d FROM v, c{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)")
        if r < rounds:
            ctes.append(f"s{r} AS (SELECT k, i, CAST(sum(e[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, generate_series(1, 64) g(i) GROUP BY k, i)")
            ctes.append(f"m{r} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY k)")
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m USING (k))")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, k AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (k)"""


def oracle_sql() -> dict[str, str]:
    """The others rest on hashes, models or byte strings that SQL has no form for, or
    are too slow in it on whole tables; tests hold them against brute force."""
    return {"op3_exact_topk": TOPK_SQL, "op11_merkle_manifest": MERKLE_SQL, "op12_jaccard_join": JACCARD_SQL, "op13_centroid_clustering": clustering_sql()}
