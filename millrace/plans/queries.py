"""Queries of the library's operators over the given tables, each with its SQL.

Documents stand for files: source is the repository, ``doc/<id>.txt`` the path, lang the
language, and embeddings.vec_id is the id of a document's vector.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import session
from millrace.functions import text as t
from millrace.operators import chunking, evaluate, fusion, graph, lexical, lookups, match, store, vector
from millrace.sources import files as source_files
from millrace.sources import language

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The words and vector that the search queries ask for.
WORDS = "the nation of"
VECTOR_OF = 3
WINDOWS = """
lined AS (
  SELECT doc_id, source, lang,
         CASE WHEN ends_with(text, chr(10)) THEN string_split(text[:-2], chr(10)) ELSE string_split(text, chr(10)) END AS lines
  FROM documents WHERE regexp_matches(text, '\\S')
), starts AS (
  SELECT *, len(lines) AS n, unnest(generate_series(1, len(lines), 45)) AS s FROM lined
), cut AS (
  SELECT source AS repo_id, concat('doc/', doc_id, '.txt') AS path, lang AS language, CAST(s AS INTEGER) AS start_line,
         CAST(least(s + 49, n) AS INTEGER) AS end_line, array_to_string(lines[s:least(s + 49, n)], chr(10)) || chr(10) AS content
  FROM starts WHERE s = 1 OR s + 4 < n
), chunks AS (
  SELECT left(sha256(concat_ws(chr(10), repo_id, path, concat(start_line, '-', end_line), sha256(content))), 32) AS chunk_id,
         repo_id, path, language, 'block' AS kind, start_line, end_line, content, sha256(content) AS content_hash
  FROM cut
)"""
TOKENS = "tok AS (SELECT doc_id, source, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS tokens FROM documents)"


def bm25_sql(words: list[str], match: str | None = None) -> str:
    """CTEs that end in ``scored`` (doc_id, source, score)."""
    tf = ", ".join(f"len(list_filter(tokens, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(words))
    n = ", ".join(f"count(*) FILTER (tf{i} > 0) AS n{i}" for i in range(len(words)))
    idf = "CASE WHEN ln((N - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((N - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END"
    part = " + ".join(f"CASE WHEN tf{i} > 0 THEN {idf.format(i=i)} * (tf{i} * 2.2) / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0.0 END" for i in range(len(words)))
    found = match or " OR ".join(f"tf{i} > 0" for i in range(len(words)))
    return f"""{TOKENS}, tf AS (SELECT doc_id, source, tokens, len(tokens) AS dl, {tf} FROM tok),
stats AS (SELECT count(*) AS N, avg(dl) AS avgdl, {n} FROM tf),
scored AS (SELECT doc_id, source, round({part}, 6) AS score FROM tf, stats WHERE {found})"""


COSINE = f"""q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = {VECTOR_OF}),
cos AS (SELECT vec_id, label, round(list_sum(list_transform(list_zip(embedding, qv), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))
  / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(qv, lambda x: CAST(x AS DOUBLE) * x)))), 9) AS score
  FROM embeddings, q)"""


def query(sql: str | None):
    def named(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return named


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.col("source").alias("repo_id"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("lang").alias("language"), F.col("text").alias("content"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_windows(files(spark, sf_dir))


def asked_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == VECTOR_OF).select("embedding").first()[0]


#: Where what a session derives from a table is stored, by the table's files and their times.
_INDEXED: dict[tuple, str] = {}


def stored(spark: SparkSession, table_: DataFrame, kind: str, build: Callable[[str], object]) -> str:
    """The folder of an index of a table, built when it is first asked for, and again when the
    table's files are others."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    times = [path(f).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path(f)).getModificationTime() for f in table_.inputFiles()]
    named = spark.sparkContext.applicationId, kind, *sorted(zip(table_.inputFiles(), times))
    if named not in _INDEXED:
        root = f"{session.shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
        build(root)
        _INDEXED[named] = root
    return _INDEXED[named]


def lexicon(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths of the documents."""
    docs = documents(spark, sf_dir)

    def build(root: str) -> None:
        lexical.by_row(docs, "doc_id", lexical.all_terms("text"), ("repo_id",), places=False).write.parquet(f"{root}/rows")  # texts are cut into terms once
        rows = spark.read.parquet(f"{root}/rows")
        found = lexical.postings_of(rows, "doc_id", ("repo_id",), lexical.repeats(rows, "doc_id")).select("term", "doc_id", "repo_id", "dl", "tf")
        found.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{root}/postings")
        rows.select("doc_id", "repo_id", "dl").write.parquet(f"{root}/lengths")

    root = stored(spark, docs, "lexicon", build)
    schemas = "term string, doc_id long, repo_id string, dl int, tf int", "doc_id long, repo_id string, dl int"
    return tuple(spark.read.schema(s).parquet(f"{root}/{name}") for s, name in zip(schemas, ("postings", "lengths")))


def placed(spark: SparkSession, sf_dir: str) -> match.Lexicon:
    """Postings with positions and a dictionary of the documents: fields text and lang."""
    docs = documents(spark, sf_dir)
    made = lambda root: match.Lexicon(spark, root, "doc_id", ("text", "lang"), ("repo_id",))
    return made(stored(spark, docs, "placed", lambda root: made(root).write(docs, text="text", lang="lang")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("repo_id", F.col("source"))


# Text


@query(f"WITH {TOKENS} SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n_tokens, CAST(len(list_distinct(tokens)) AS INTEGER) AS n_terms FROM tok")
def token_counts(spark, sf_dir):
    tokens = lexical.tokenised(table(spark, sf_dir, "documents"), "text")
    return tokens.select("doc_id", F.size("tokens").alias("n_tokens"), F.size(F.array_distinct("tokens")).alias("n_terms"))


@query(f"WITH {WINDOWS} SELECT repo_id, path, language, kind, start_line, end_line, content FROM chunks")
def chunk_fixed_window(spark, sf_dir):
    return chunks(spark, sf_dir).select("repo_id", "path", "language", "kind", "start_line", "end_line", "content")


@query(f"WITH {WINDOWS} SELECT chunk_id, path, start_line, content_hash FROM chunks")
def chunk_ids(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_id", "path", "start_line", "content_hash")


@query(f"WITH {WINDOWS} SELECT language, count(*) AS n_chunks, count(DISTINCT path) AS n_files, CAST(sum(end_line - start_line + 1) AS BIGINT) AS n_lines, count(*) FILTER (start_line > 1) AS n_later FROM chunks GROUP BY language")
def chunk_stats_by_lang(spark, sf_dir):
    lines = (F.col("end_line") - F.col("start_line") + 1).cast("long")
    return chunks(spark, sf_dir).groupBy("language").agg(F.count("*").alias("n_chunks"), F.countDistinct("path").alias("n_files"), F.sum(lines).alias("n_lines"), F.count_if(F.col("start_line") > 1).alias("n_later"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) FILTER (NOT regexp_matches(line, '\\S')) AS n_blank, count(*) AS n_lines FROM l GROUP BY doc_id")
def blank_filter(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(t.is_blank(F.col("line"))).alias("n_blank"), F.count("*").alias("n_lines"))


@query("SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents WHERE lang = 'de' GROUP BY source")
def language_filter(spark, sf_dir):
    return files_by_language(spark, sf_dir, "de")


def files_by_language(spark, sf_dir, lang):
    docs = table(spark, sf_dir, "documents").filter(F.col("lang") == lang)
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").cast("long").alias("n_chars"))


# Lookups


@query(f"WITH {WINDOWS} SELECT chunk_id, path, start_line, end_line FROM chunks WHERE repo_id = 'src7' AND path = (SELECT path FROM chunks WHERE repo_id = 'src7' ORDER BY start_line DESC, path LIMIT 1) ORDER BY start_line")
def path_lookup_ordered(spark, sf_dir):
    own = chunks(spark, sf_dir)
    path = own.filter("repo_id = 'src7'").orderBy(F.desc("start_line"), "path").select("path").first()[0]
    return lookups.by_path(own, "src7", path).select("chunk_id", "path", "start_line", "end_line")


@query("WITH ids AS (SELECT doc_id AS place, (doc_id * 37) % (SELECT count(*) FROM documents) AS doc_id FROM labels) SELECT place, doc_id, lang, source FROM ids JOIN documents USING (doc_id) ORDER BY place")
def get_many_ordered(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    ids = table(spark, sf_dir, "labels").crossJoin(F.broadcast(docs.agg(F.count("*").alias("n"))))  # one row
    return lookups.get_many(docs, "doc_id", ids.select(F.col("doc_id").alias("place"), ((F.col("doc_id") * 37) % F.col("n")).alias("doc_id"))).select("place", "doc_id", "lang", "source")


@query(f"WITH {WINDOWS} SELECT path, start_line, end_line FROM chunks WHERE start_line <= 60 AND end_line >= 48")
def open_range_overlap(spark, sf_dir):
    return lookups.overlapping(chunks(spark, sf_dir), 48, 60).select("path", "start_line", "end_line")


# Search by text


@query(f"WITH {bm25_sql(['the', 'nation', 'of'])} SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 20")
def bm25_topk(spark, sf_dir):
    return lexical.bm25(lexicon(spark, sf_dir), "doc_id", lexical.query_terms(spark, WORDS), 20)


@query(f"WITH {bm25_sql(['the', 'and'], 'tf0 > 0 AND tf1 > 0')} SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 20")
def bm25_and_topk(spark, sf_dir):
    return lexical.bm25(lexicon(spark, sf_dir), "doc_id", ["the", "and"], 20, every=True)


@query(f"WITH {bm25_sql(['die', 'und'])} SELECT doc_id, score FROM scored WHERE source = 'src3' ORDER BY score DESC, doc_id LIMIT 20")
def bm25_repo_filtered(spark, sf_dir):
    return lexical.bm25(lexicon(spark, sf_dir), "doc_id", ["die", "und"], 20, where=F.col("repo_id") == "src3")


@query(f"WITH {bm25_sql(['and', 'the'], "contains(' ' || array_to_string(tokens, ' ') || ' ', ' and the ')")} SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 20")
def bm25_phrase_scan(spark, sf_dir):
    return lexical.bm25_scan(documents(spark, sf_dir), "doc_id", ("text",), ["and", "the"], 20, match=lexical.has_phrase("and", "the"))


@query(f"WITH {TOKENS}, x AS (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM tok) SELECT term, doc_id, CAST(dl AS INTEGER) AS dl, CAST(count(*) AS INTEGER) AS tf FROM x GROUP BY ALL")
def stored_postings(spark, sf_dir):
    return lexicon(spark, sf_dir)[0].drop("repo_id")


@query(f"WITH {TOKENS}, x AS (SELECT doc_id, unnest(tokens) AS term FROM tok), y AS (SELECT term, doc_id, count(*) AS tf FROM x GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM y GROUP BY term")
def term_df_stats(spark, sf_dir):
    return lexical.term_statistics(table(spark, sf_dir, "documents"), "text")


@query("WITH t AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+'), ' ') || ' ' AS j FROM documents) SELECT doc_id FROM t WHERE contains(j, ' and the ')")
def phrase_match(spark, sf_dir):
    return lexical.tokenised(table(spark, sf_dir, "documents"), "text").filter(lexical.has_phrase("and", "the")).select("doc_id")


@query(f"WITH {TOKENS} SELECT doc_id FROM tok WHERE len(list_filter(tokens, lambda x: starts_with(x, 'thing'))) > 0")
def prefix_match(spark, sf_dir):
    return lexical.tokenised(table(spark, sf_dir, "documents"), "text").filter(lexical.has_prefix("thing")).select("doc_id")


@query(f"WITH {TOKENS} SELECT doc_id FROM tok WHERE list_contains(tokens, 'the') AND NOT list_contains(tokens, 'with')")
def not_match(spark, sf_dir):
    return lexical.tokenised(table(spark, sf_dir, "documents"), "text").filter(lexical.has_all("the") & lexical.has_none("with")).select("doc_id")


@query(f"WITH {TOKENS}, p AS (SELECT doc_id, list_filter(generate_series(1, len(tokens)), lambda i: tokens[i] = 'from') AS a, list_filter(generate_series(1, len(tokens)), lambda i: tokens[i] = 'was') AS b FROM tok), e AS (SELECT doc_id, unnest(a) AS i, b FROM p), f AS (SELECT doc_id, i, unnest(b) AS j FROM e) SELECT DISTINCT doc_id FROM f WHERE abs(i - j) <= 6")
def near_match(spark, sf_dir):
    return lexical.tokenised(table(spark, sf_dir, "documents"), "text").filter(lexical.has_near("from", "was", 5)).select("doc_id")


# Match texts: each leaf is a count of a row's terms, and the condition says which must hold.

FIELD_TOKENS = """tok AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{L}\\p{N}]+') AS x,
  regexp_extract_all(strip_accents(lower(coalesce(lang, ''))), '[\\p{L}\\p{N}]+') AS y FROM documents)"""


def match_sql(leaves: list[str], holds: str, plain: list[str] | None = None) -> str:
    tf = ", ".join(f"{leaf} AS tf{i}, {any_} AS any{i}" for i, (leaf, any_) in enumerate(zip(leaves, plain or leaves)))
    n = ", ".join(f"count(*) FILTER (any{i} > 0) AS n{i}" for i in range(len(leaves)))
    idf = "CASE WHEN ln((N - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((N - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END"
    parts = " + ".join(f"CASE WHEN tf{i} > 0 THEN {idf.format(i=i)} * (tf{i} * 2.2) / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0.0 END" for i in range(len(leaves)))
    return f"WITH {FIELD_TOKENS}, tf AS (SELECT doc_id, len(x) + len(y) AS dl, {tf} FROM tok), stats AS (SELECT count(*) AS N, avg(dl) AS avgdl, {n} FROM tf) SELECT doc_id, round({parts}, 6) AS score FROM tf, stats WHERE {holds}"


def _times(word: str, of: str = "x") -> str:
    return f"len(list_filter({of}, lambda w: w = '{word}'))"


def _phrase(*words: str) -> str:
    return f"len(list_filter(generate_series(1, len(x)), lambda i: {' AND '.join(f"x[i + {i}] = '{w}'" for i, w in enumerate(words))}))"


def _beside(word: str, other: str, most: int) -> str:
    return f"len(list_filter(generate_series(1, len(x)), lambda i: x[i] = '{word}' AND list_contains(x[greatest(1, i - {most + 1}):i + {most + 1}], '{other}')))"


@query(match_sql([_phrase("of", "the"), "len(list_filter(x, lambda w: starts_with(w, 'nation'))) + len(list_filter(y, lambda w: starts_with(w, 'nation')))", f"{_times('and')} + {_times('and', 'y')}", f"{_times('und')} + {_times('und', 'y')}", _times("es", "y")], "(tf0 > 0 OR tf1 > 0) AND (tf2 > 0 OR tf3 > 0) AND NOT tf4 > 0"))
def match_mixed(spark, sf_dir):
    return placed(spark, sf_dir).search('(text : "of the" OR nation*) AND (and OR und) NOT lang:es', None)


@query(match_sql([_phrase("and", "the")], "tf0 > 0"))
def bm25_phrase(spark, sf_dir):
    return placed(spark, sf_dir).search('text : "and the"', None)


@query(match_sql([_beside("from", "was", 5), _beside("was", "from", 5)], "tf0 > 0 AND tf1 > 0", [_times("from"), _times("was")]))
def bm25_near(spark, sf_dir):
    return placed(spark, sf_dir).search("text : NEAR(from was, 5)", None)


@query(match_sql(["len(list_filter(x, lambda w: starts_with(w, 'th'))) + len(list_filter(y, lambda w: starts_with(w, 'th')))"], "tf0 > 0"))
def bm25_prefix(spark, sf_dir):
    return placed(spark, sf_dir).search("th*", None)


@query(match_sql([_times("de", "y"), f"{_times('die')} + {_times('die', 'y')}"], "tf0 > 0 AND tf1 > 0"))
def bm25_fields(spark, sf_dir):
    return placed(spark, sf_dir).search("lang : de die", None)


@query(f"WITH {FIELD_TOKENS}, w AS (SELECT doc_id, unnest(list_concat(x, y)) AS term FROM tok) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM w WHERE starts_with(term, 'th') GROUP BY term")
def term_dictionary(spark, sf_dir):
    return placed(spark, sf_dir).with_prefix("th").select("term", "df", "cf")


#: Every text of benchmark as a question; its vector is that of the same number.
MANY = f"""{TOKENS}, words AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+'))) AS term FROM benchmark),
post AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS h FROM post GROUP BY term), totals AS (SELECT count(*) AS N, avg(len(tokens)) AS avgdl FROM tok),
lexed AS (SELECT item_id AS query_id, doc_id, round(sum(CASE WHEN ln((N - h + 0.5) / (h + 0.5)) > 0 THEN ln((N - h + 0.5) / (h + 0.5)) ELSE 1e-6 END * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM words JOIN post USING (term) JOIN df USING (term), totals GROUP BY ALL),
lex_ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM lexed)"""


def questions(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), t.terms(F.col("text")).alias("words"))
    return rows.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id", "left")


@query(f"WITH {MANY} SELECT query_id, doc_id, score, rank FROM lex_ranked WHERE rank <= 10")
def bm25_many_questions(spark, sf_dir):
    return lexical.bm25_many(lexicon(spark, sf_dir), "doc_id", questions(spark, sf_dir), 10)


@query(
    f"""WITH {MANY}, norm AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS norm FROM embeddings),
near AS (SELECT item_id AS query_id, c.vec_id AS doc_id, round(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / (q.norm * c.norm), 9) AS score
  FROM benchmark JOIN norm q ON q.vec_id = item_id CROSS JOIN norm c),
vec AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS vec_rank FROM near QUALIFY vec_rank <= 16),
lex AS (SELECT query_id, doc_id, rank AS lex_rank FROM lex_ranked WHERE rank <= 16),
both_ AS (SELECT query_id, doc_id, vec_rank, lex_rank, round(coalesce(1.0::DOUBLE / (60 + vec_rank), 0) + coalesce(1.0::DOUBLE / (60 + lex_rank), 0), 9) AS score FROM vec FULL JOIN lex USING (query_id, doc_id))
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_rank NULLS LAST, lex_rank NULLS LAST) AS INTEGER) AS rank FROM both_ QUALIFY rank <= 8"""
)
def hybrid_many_questions(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    found = fusion.hybrid_many(vectors, lexicon(spark, sf_dir), "doc_id", questions(spark, sf_dir), 8, vector_column="embedding")
    return found.select("query_id", "doc_id", "score", "rank")


# Search by vector


@query(f"WITH {COSINE} SELECT vec_id, score FROM cos ORDER BY score DESC, vec_id LIMIT 20")
def cosine_topk_lists(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    made = lambda root: vector.Lists(spark, root, "vec_id")
    root = stored(spark, rows, "lists", lambda root: made(root).write(rows, "embedding", len(asked_vector(spark, sf_dir))))
    return made(root).search(asked_vector(spark, sf_dir), 20)


@query(f"WITH {COSINE} SELECT vec_id, score FROM cos WHERE vec_id % 7 <> 0 AND vec_id % 11 <> 0 ORDER BY score DESC, vec_id LIMIT 20")
def cosine_with_zero_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    zero = F.when(F.col("vec_id") % 7 == 0, F.transform("embedding", lambda x: x * 0)).when(F.col("vec_id") % 11 != 0, F.col("embedding"))
    return vector.cosine_topk(rows.withColumn("embedding", zero), "vec_id", "embedding", asked_vector(spark, sf_dir), 20)


@query(f"WITH {COSINE} SELECT vec_id, score FROM cos ORDER BY score DESC, vec_id LIMIT 20")
def cosine_topk(spark, sf_dir):
    return vector.cosine_topk(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", asked_vector(spark, sf_dir), 20)


@query(f"WITH {COSINE} SELECT vec_id, score FROM cos WHERE label = 4 ORDER BY score DESC, vec_id LIMIT 10")
def cosine_label_filter(spark, sf_dir):
    return vector.cosine_topk(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", asked_vector(spark, sf_dir), 10, F.col("label") == 4)


BATCH = """n AS (SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS norm FROM embeddings),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, a.label AS q_label, b.label AS label,
  round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / (a.norm * b.norm), 9) AS score
  FROM n a JOIN n b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
best AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)"""


@query(f"WITH {BATCH} SELECT query_id, vec_id, score, rank FROM best WHERE rank <= 10")
def cosine_topk_batch(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return vector.cosine_topk_batch(rows, "vec_id", "embedding", rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 10)


@query("WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS norm FROM embeddings), pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / (a.norm * b.norm), 9) AS score FROM n a JOIN n b ON a.vec_id % 10 = 0 AND a.vec_id <> b.vec_id) SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs QUALIFY rank <= 3")
def cosine_topk_tiled(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector.cosine_topk_batch(rows, "vec_id", "embedding", asked, 3, most=16)


# Both


FUSED = f"""lex AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS lex_rank FROM scored QUALIFY lex_rank <= 16),
{COSINE}, vec AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS vec_rank FROM cos QUALIFY vec_rank <= 16),
both_ AS (SELECT id, vec_rank, lex_rank, round(coalesce(1.0::DOUBLE / (60 + vec_rank), 0) + coalesce(1.0::DOUBLE / (60 + lex_rank), 0), 9) AS score FROM vec FULL JOIN lex USING (id)),
fused AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_rank NULLS LAST, lex_rank NULLS LAST) AS rank FROM both_)"""


def _lists(spark, sf_dir):
    near = vector.cosine_topk(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id"), "id", "embedding", asked_vector(spark, sf_dir), 16)
    match = lexical.bm25(tuple(x.withColumnRenamed("doc_id", "id") for x in lexicon(spark, sf_dir)), "id", lexical.query_terms(spark, WORDS), 16)
    return fusion.ranked(near, "id", "vec_rank"), fusion.ranked(match, "id", "lex_rank")


@query(f"WITH {bm25_sql(['the', 'nation', 'of'])}, {FUSED} SELECT id, score, CAST(vec_rank AS INTEGER) AS vec_rank, CAST(lex_rank AS INTEGER) AS lex_rank, CAST(rank AS INTEGER) AS rank FROM fused")
def rrf_fuse(spark, sf_dir):
    return fusion.fuse(*_lists(spark, sf_dir), "id").select("id", "score", "vec_rank", "lex_rank", "rank")


@query(f"WITH {bm25_sql(['the', 'nation', 'of'])}, {FUSED} SELECT doc_id, score, CAST(rank AS INTEGER) AS rank, lang, d.source AS repo_id FROM fused JOIN documents d ON d.doc_id = fused.id WHERE rank <= 8")
def hybrid_retrieve(spark, sf_dir):
    rows = documents(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    found = fusion.hybrid(rows, vectors, "doc_id", ("text",), WORDS, asked_vector(spark, sf_dir), 8, vector_column="embedding", stored=lexicon(spark, sf_dir))
    return found.select("doc_id", "score", "rank", "lang", "repo_id")


@query(f"WITH {bm25_sql(['the', 'nation', 'of'])}, {FUSED} SELECT id, CAST(rank AS INTEGER) AS rank, left(text, 80) AS snippet, sha256(text) AS content_hash FROM fused JOIN documents d ON d.doc_id = fused.id")
def hybrid_hydrate(spark, sf_dir):
    found = fusion.fuse(*_lists(spark, sf_dir), "id").select("id", "rank")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return fusion.hydrated(found, docs, "id").select("id", "rank", F.substring("text", 1, 80).alias("snippet"), t.content_hash(F.col("text")).alias("content_hash"))


# Citations and evaluation


@query(f"WITH {WINDOWS} SELECT path, start_line, end_line, left(content, 800) AS snippet FROM chunks")
def citations_dedup(spark, sf_dir):
    own = chunks(spark, sf_dir).withColumn("symbol", F.lit(None).cast("string")).withColumn("rank", F.col("start_line"))
    again = own.withColumns({"rank": F.col("rank") + 1_000_000, "content": F.lit("a later one of the same lines")})
    return lookups.citations(again.unionByName(own)).select("citation.path", "citation.start_line", "citation.end_line", "citation.snippet")


@query(
    f"WITH {BATCH}, rel AS (SELECT vec_id AS query_id, (SELECT count(*) - 1 FROM embeddings e WHERE e.label = q.label) AS n_rel FROM embeddings q WHERE vec_id % 100 = 0), "
    "hit AS (SELECT query_id, rank, CASE WHEN q_label = label THEN 1 ELSE 0 END AS rel FROM best WHERE rank <= 10), "
    "ideal AS (SELECT i, sum(1 / log2(i + 1)) OVER (ORDER BY i) AS g FROM generate_series(1, 10) t(i)) "
    "SELECT query_id, round(sum(rel) / max(n_rel), 9) AS recall, round(coalesce(max(CASE WHEN rel = 1 THEN 1.0::DOUBLE / rank END), 0), 9) AS mrr, "
    "round(sum(rel / log2(rank + 1)) / max(g), 9) AS ndcg FROM hit JOIN rel USING (query_id) JOIN ideal ON i = least(10, n_rel) GROUP BY query_id"
)
def recall_mrr_ndcg(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    asked = rows.filter("vec_id % 100 = 0").join(rows.groupBy("label").agg((F.count("*") - 1).alias("n_relevant")), "label").select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"), "n_relevant")
    hits = cosine_topk_batch(spark, sf_dir).join(rows, "vec_id").join(asked, "query_id")
    ranked = hits.groupBy("query_id", "n_relevant").agg(F.array_sort(F.collect_list(F.struct("rank", (F.col("label") == F.col("wanted")).alias("hit")))).alias("r"))
    measured = ranked.select("query_id", "n_relevant", F.col("r.hit").alias("hits")).select("query_id", evaluate.of_hits("hits", "n_relevant", 10).alias("m"))
    return measured.select("query_id", *(F.round(f"m.{c}", 9).alias(c) for c in ("recall", "mrr", "ndcg")))


GROUND = f"""{WINDOWS}, cited AS (SELECT item_id, source AS repo_id, concat('doc/', doc_id, '.txt') AS path, 1 + item_id % 3 AS start_line, 1 + item_id % 7 + item_id % 3 AS end_line,
  CASE WHEN item_id % 4 = 0 THEN '' ELSE b.text[1:60] END AS snippet FROM benchmark b JOIN documents d ON d.doc_id % 20 = item_id % 20),
g AS (SELECT item_id, c.repo_id, c.path, bool_or(k.path IS NOT NULL) AS file_exists,
  bool_or(coalesce(k.start_line <= c.start_line AND c.end_line <= k.end_line, false)) AS range_valid,
  bool_or(coalesce(k.start_line <= c.start_line AND c.end_line <= k.end_line AND (snippet = '' OR contains(content, snippet)), false)) AS snippet_matches
  FROM cited c LEFT JOIN chunks k ON k.repo_id = c.repo_id AND k.path = c.path GROUP BY item_id, c.repo_id, c.path)"""


def _grounded(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("b_text"), (F.col("item_id") % 20).alias("m"))
    own = files(spark, sf_dir).select("doc_id", "repo_id", "path", (F.col("doc_id") % 20).alias("m"))
    i = F.col("item_id")
    snippet = F.when(i % 4 == 0, "").otherwise(F.substring("b_text", 1, 60))
    cited = items.join(own, "m").select("item_id", "repo_id", "path", (1 + i % 3).alias("start_line"), (1 + i % 7 + i % 3).alias("end_line"), snippet.alias("snippet"))
    return evaluate.grounded(cited, chunks(spark, sf_dir), "item_id")


@query(f"WITH {GROUND} SELECT item_id, path, file_exists, range_valid, snippet_matches, CAST(len(list_filter([file_exists, range_valid, snippet_matches], lambda x: NOT x)) AS INTEGER) AS n_reasons FROM g")
def grounding_report(spark, sf_dir):
    return _grounded(spark, sf_dir).select("item_id", "path", "file_exists", "range_valid", "snippet_matches", F.size("reasons").alias("n_reasons"))


@query(f"WITH {GROUND} SELECT item_id, count(*) AS total, count(*) FILTER (snippet_matches) AS grounded, round(count(*) FILTER (snippet_matches) / count(*), 9) AS rate FROM g GROUP BY item_id")
def grounding_rate(spark, sf_dir):
    out = _grounded(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("total"), F.count_if("grounded").alias("grounded"))
    return out.withColumn("rate", F.round(evaluate.grounding_rate(F.col("grounded"), F.col("total")), 9))


@query("SELECT doc_id, round((CASE WHEN quality = 1 THEN 1 ELSE 0 END + CASE WHEN toxic = 1 THEN 1 ELSE 0 END) / 3.0::DOUBLE, 9) AS score, quality = 1 AS good, toxic = 1 AS toxic_said FROM labels")
def trait_scores(spark, sf_dir):
    judged = F.concat(F.lit('Verdict: {"per_trait": {"good": '), F.when(F.col("quality") == 1, "true").otherwise("false"), F.lit(', "toxic": "'), F.when(F.col("toxic") == 1, " Yes ").otherwise("no"), F.lit('", "else": true}, "rationale": "r"} done'))
    rows = table(spark, sf_dir, "labels").select("doc_id", judged.alias("judged"), F.array(F.lit("good"), F.lit("toxic"), F.lit("cited")).alias("traits"))
    out = rows.withColumn("r", evaluate.rubric("judged", "traits"))
    return out.select("doc_id", F.round("r.score", 9).alias("score"), F.col("r.per_trait")["good"].alias("good"), F.col("r.per_trait")["toxic"].alias("toxic_said"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95, count(*) AS n FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    at = lambda p: F.round(evaluate.percentile("value", p), 9)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.count("*").alias("n"))


EVENT_CASES = "c AS (SELECT user_id % 5 / 4.0::DOUBLE AS recall, 1.0::DOUBLE / (1 + user_id % 4) AS mrr, value AS latency_ms, value / 1e6 AS cost_usd FROM events)"


@query(f"WITH {EVENT_CASES} SELECT count(*) AS n_cases, round(avg(recall), 9) AS mean_recall, round(avg(mrr), 9) AS mean_mrr, round(quantile_cont(latency_ms, 0.5), 9) AS p50, round(quantile_cont(latency_ms, 0.95), 9) AS p95, round(sum(cost_usd), 6) AS total_cost FROM c")
def eval_aggregates(spark, sf_dir):
    u = F.col("user_id")
    none = F.lit(0.0)
    cases = table(spark, sf_dir, "events").select((u % 5 / 4.0).alias("recall_at_k"), (1.0 / (1 + u % 4)).alias("mrr"), none.alias("ndcg_at_k"), none.alias("grounding_rate"), none.alias("correctness"), F.col("value").alias("latency_ms"), (F.col("value") / 1e6).alias("cost_usd"))
    out = evaluate.aggregates(cases, 10)
    return out.select("n_cases", F.round("mean_recall_at_k", 9).alias("mean_recall"), F.round("mean_mrr", 9).alias("mean_mrr"), F.round("latency_p50_ms", 9).alias("p50"), F.round("latency_p95_ms", 9).alias("p95"), F.round("total_cost_usd", 6).alias("total_cost"))


#: Rates by provider and model, in USD for 1,000 tokens (fixed values).
RATE_CARD = [("local", "default", 0.0, 0.0), ("a", "small", 0.00015, 0.0006), ("a", "large", 0.0025, 0.01), ("b", "default", 0.0008, 0.004), ("b", "large", 0.003, 0.015)]


@query(
    "WITH r(provider, model, p, c) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c}::DOUBLE, {d}::DOUBLE)" for a, b, c, d in RATE_CARD) + "), "
    "u AS (SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'local' ELSE 'none' END AS provider, CASE WHEN event_id % 2 = 0 THEN 'large' ELSE 'small' END AS model, 100 + event_id % 900 AS prompt, event_id % 300 AS completion FROM events) "
    "SELECT u.provider, u.model, count(*) AS n, round(sum(prompt / 1000 * coalesce(x.p, y.p, 0) + completion / 1000 * coalesce(x.c, y.c, 0)), 6) AS cost "
    "FROM u LEFT JOIN r x ON x.provider = u.provider AND x.model = u.model LEFT JOIN r y ON y.provider = u.provider AND y.model = 'default' GROUP BY u.provider, u.model"
)
def cost_by_model_with_default(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id") % 4
    used = table(spark, sf_dir, "events").select(F.when(u == 0, "a").when(u == 1, "b").when(u == 2, "local").otherwise("none").alias("provider"), F.when(e % 2 == 0, "large").otherwise("small").alias("model"), (100 + e % 900).alias("prompt"), (e % 300).alias("completion"))
    rates = spark.createDataFrame(RATE_CARD, "provider string, model string, prompt_per_1k double, completion_per_1k double")
    return evaluate.costs(used, rates).groupBy("provider", "model").agg(F.count("*").alias("n"), F.round(F.sum("cost_usd"), 6).alias("cost"))


# Conversations and events


@query("SELECT conv_id, count(*) AS turns, CAST(coalesce(sum(len(regexp_extract_all(lower(text), '\\S+'))) FILTER (role = 'user'), 0) AS BIGINT) AS prompt, CAST(coalesce(sum(len(regexp_extract_all(lower(text), '\\S+'))) FILTER (role <> 'user'), 0) AS BIGINT) AS completion FROM conversations GROUP BY conv_id")
def conversation_usage(spark, sf_dir):
    words = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    of = lambda c: F.coalesce(F.sum(F.when(c, words)), F.lit(0)).cast("long")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), of(F.col("role") == "user").alias("prompt"), of(F.col("role") != "user").alias("completion"))


@query("SELECT conv_id, sha256(string_agg(b, chr(10) || chr(10) ORDER BY turn, b)) AS context_hash FROM (SELECT conv_id, turn, concat(role, ', lines ', turn + 1, '-', turn + 1, CASE WHEN turn % 2 = 0 THEN ' in s' ELSE '' END, chr(10), text) AS b FROM conversations) GROUP BY conv_id")
def context_render(spark, sf_dir):
    line = F.col("turn") + 1
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("rank"), F.col("role").alias("path"), line.alias("start_line"), line.alias("end_line"), F.when(F.col("turn") % 2 == 0, "s").alias("symbol"), F.col("text").alias("content"))
    return lookups.context(turns, by=("conv_id",)).select("conv_id", t.content_hash(F.col("context")).alias("context_hash"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def props_json_extract(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


# Keeping tables


@query("SELECT doc_id, text, lang FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, upper(lang) AS text, 'new' AS lang FROM documents WHERE doc_id % 3 = 0")
def upsert_latest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    new = docs.filter("doc_id % 3 = 0").select("doc_id", F.upper("lang").alias("text"), F.lit("new").alias("lang"))
    return store.upserted(docs, new, "doc_id")


@query(f"WITH {WINDOWS} SELECT chunk_id, path FROM chunks WHERE repo_id NOT IN ('src1', 'src2')")
def anti_join_new(spark, sf_dir):
    own = chunks(spark, sf_dir)
    return store.not_indexed(own, own.filter(F.col("repo_id").isin("src1", "src2"))).select("chunk_id", "path")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id % 10 <> 1 OR n_chars % 2 = 0")
def incremental_skip(spark, sf_dir):
    known = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.col("source").alias("repo_id"), F.col("doc_id").cast("string").alias("path"), F.lit(1.0).alias("mtime"), F.col("n_chars").cast("long").alias("size"))
    now = known.withColumn("mtime", F.when(F.col("doc_id") % 10 != 1, 2.0).otherwise(1.0)).withColumn("size", F.when(F.col("n_chars") % 2 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return source_files.changed(now, known).select("doc_id", "n_chars")


@query("SELECT source, count(*) AS n FROM documents WHERE source <> 'src5' GROUP BY source")
def delete_repo_counts(spark, sf_dir):
    return store.without_repo(documents(spark, sf_dir), "src5").groupBy("source").agg(F.count("*").alias("n"))


@query(f"WITH {WINDOWS}, n AS (SELECT * FROM chunks WHERE start_line = 1) SELECT chunk_id, path FROM chunks WHERE start_line > 1")
def prune_stale(spark, sf_dir):
    own = chunks(spark, sf_dir)
    return store.stale(own, own.filter("start_line = 1")).select("chunk_id", "path")


# Symbols: the windows of a document stand for definitions; a window of a document with a
# longer one around it is its method.

SYMBOL_CHUNKS = """d AS (SELECT doc_id, source AS repo_id, concat('pkg/', doc_id, '.py') AS path, 1 + CAST(len(string_split(text, chr(10))) AS INTEGER) AS n FROM documents),
sym AS (SELECT repo_id, path, 'class' AS kind, concat('C', doc_id) AS symbol, 1 AS start_line, n AS end_line FROM d
  UNION ALL SELECT repo_id, path, 'class', concat('D', doc_id), 1 + n // 2, n FROM d WHERE n > 4
  UNION ALL SELECT repo_id, path, 'method', concat('m', i), i, i FROM d, generate_series(1, 5) s(i) WHERE i <= n
  UNION ALL SELECT repo_id, path, 'function', concat('f', doc_id % 7), n + 2, n + 3 FROM d)"""


def symbol_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo_id"), F.concat(F.lit("pkg/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), (1 + F.size(F.split("text", "\n", -1))).alias("n"))
    n, text = F.col("n"), F.col("doc_id").cast("string")
    one = lambda kind, name, a, b: F.struct(F.lit(kind).alias("kind"), name.alias("symbol"), a.cast("int").alias("start_line"), b.cast("int").alias("end_line"))
    half = F.floor(n / 2)
    rows = F.concat(
        F.array(one("class", F.concat(F.lit("C"), text), F.lit(1), n), one("function", F.concat(F.lit("f"), (F.col("doc_id") % 7).cast("string")), n + 2, n + 3)),
        F.when(n > 4, F.array(one("class", F.concat(F.lit("D"), text), 1 + half, n))).otherwise(F.array()),
        F.transform(F.filter(F.sequence(F.lit(1), F.lit(5)), lambda i: i <= n), lambda i: one("method", F.concat(F.lit("m"), i.cast("string")), i, i)),
    )
    cut = docs.select("repo_id", "path", F.lit("python").alias("language"), F.inline(rows))
    return cut.withColumn("chunk_id", F.concat_ws("|", "path", "kind", "symbol", "start_line"))


@query(f"WITH {SYMBOL_CHUNKS} SELECT repo_id, path AS src_path, regexp_extract(path, '([^/]+)\\.py$', 1) AS src_name, path AS dst_path, symbol AS dst_name, 'defines' AS kind FROM sym WHERE kind IN ('class', 'function')")
def edges_defines(spark, sf_dir):
    return graph.defines(symbol_chunks(spark, sf_dir))


@query(
    f"WITH {SYMBOL_CHUNKS}, p AS (SELECT m.repo_id, m.path, m.symbol AS method, c.symbol AS class, row_number() OVER (PARTITION BY m.path, m.symbol ORDER BY c.start_line DESC) AS rn "
    "FROM sym m JOIN sym c ON m.path = c.path AND m.kind = 'method' AND c.kind = 'class' AND c.start_line <= m.start_line AND m.end_line <= c.end_line) "
    "SELECT repo_id, path AS src_path, class AS src_name, path AS dst_path, method AS dst_name, 'contained_in' AS kind FROM p WHERE rn = 1"
)
def edges_contained_in(spark, sf_dir):
    return graph.contained_in(symbol_chunks(spark, sf_dir))


CALLS = "calls AS (SELECT DISTINCT concat('pkg/', d.doc_id, '.py') AS src_path, concat('f', d.doc_id % 7) AS src_name, concat('pkg/', l.o_custkey % n, '.py') AS dst_path, concat('f', (l.o_custkey % n) % 7) AS dst_name FROM orders l, (SELECT count(*) AS n FROM documents) JOIN documents d ON d.doc_id = l.o_orderkey % n)"


@query(f"WITH {SYMBOL_CHUNKS}, {CALLS} SELECT DISTINCT s.symbol AS name, s.kind, s.path, CAST(s.start_line AS INTEGER) AS line FROM calls c JOIN sym s ON s.path = c.src_path AND s.symbol = c.src_name WHERE c.dst_name = 'f3'")
def callers_callees(spark, sf_dir):
    path = lambda c: F.concat(F.lit("pkg/"), c.cast("string"), F.lit(".py"))
    name = lambda c: F.concat(F.lit("f"), (c % 7).cast("string"))
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))  # one row
    links = table(spark, sf_dir, "orders").crossJoin(F.broadcast(n)).select((F.col("o_orderkey") % F.col("n")).alias("a"), (F.col("o_custkey") % F.col("n")).alias("b"))
    rows = links.select(path(F.col("a")).alias("src_path"), name(F.col("a")).alias("src_name"), path(F.col("b")).alias("dst_path"), name(F.col("b")).alias("dst_name"), F.lit("calls").alias("kind"))
    return graph.neighbours(graph.symbols_of(symbol_chunks(spark, sf_dir)), graph.edges(rows), "f3", callers=True).select("name", "kind", "path", "line")


@query(f"WITH {SYMBOL_CHUNKS}, s AS (SELECT repo_id, 'pkg/m.py' AS path, symbol AS name, start_line FROM sym UNION ALL SELECT DISTINCT repo_id, 'pkg/m.py', 'm', 0 FROM sym) SELECT repo_id, path, name, CAST(greatest(1, max(start_line)) AS INTEGER) AS line FROM s GROUP BY ALL")
def symbols_by_repo(spark, sf_dir):
    one_path = symbol_chunks(spark, sf_dir).withColumn("path", F.lit("pkg/m.py"))  # the same in every repository
    return graph.nodes(graph.symbols_of(one_path)).select("repo_id", "path", "name", "line")


@query(f"WITH {SYMBOL_CHUNKS}, e AS (SELECT DISTINCT repo_id, path, CASE WHEN kind = 'method' THEN 'gone' ELSE 'f' END AS src, symbol AS dst FROM sym WHERE kind <> 'class') SELECT repo_id, path, name, kind FROM (SELECT repo_id, path, src AS name, 'other' AS kind FROM e UNION SELECT repo_id, path, dst, 'function' FROM e WHERE src = 'f' UNION SELECT repo_id, path, dst, 'other' FROM e WHERE src = 'gone')")
def edge_ends_are_nodes(spark, sf_dir):
    own = symbol_chunks(spark, sf_dir).filter("kind <> 'class'")
    links = own.select("repo_id", F.col("path").alias("src_path"), F.when(F.col("kind") == "method", "gone").otherwise("f").alias("src_name"), F.col("path").alias("dst_path"), F.col("symbol").alias("dst_name"), F.lit("calls").alias("kind"))
    symbols = graph.symbols_of(own.filter("kind = 'function'")).filter("kind = 'function'")
    return graph.nodes(graph.with_ends(symbols, graph.edges(links))).select("repo_id", "path", "name", "kind")


@query(
    "WITH p AS (SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\\.[A-Za-z0-9+]+)$', 1)) AS s, page_id % 6 AS m FROM pages), "
    "q AS (SELECT page_id, CASE m WHEN 0 THEN '.py' WHEN 1 THEN '.HPP' WHEN 2 THEN '.tsx' ELSE s END AS s, m FROM p) "
    "SELECT page_id, CASE WHEN m = 0 THEN 'python' WHEN m = 1 THEN 'cpp' WHEN m = 2 THEN 'tsx' WHEN m = 3 THEN 'python' WHEN m = 4 THEN 'javascript' END AS language FROM q"
)
def language_map(spark, sf_dir):
    m = F.col("page_id") % 6
    path = F.concat(F.lit("site/page"), F.col("page_id").cast("string"), F.when(m == 0, ".py").when(m == 1, ".HPP").when(m == 2, ".tsx").otherwise(""))
    head = F.when(m == 3, "\n#!/usr/bin/env python3.11\n").when(m == 4, "#! /usr/local/bin/node --x\n").otherwise("")
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.concat(head, "html").alias("content"))
    return rows.select("page_id", language.detected(F.col("path"), F.col("content")).alias("language"))


@query(
    "WITH p AS (SELECT DISTINCT rtrim(regexp_extract(url, '^https?://([^?#]*)', 1), '/') AS path FROM pages), q AS (SELECT path, string_split(path, '/') AS s FROM p), "
    "n AS (SELECT path, s[1] AS host, s[2] AS lang, s[3] AS name FROM q) "
    "SELECT 'web' AS repo_id, path FROM n WHERE NOT (host LIKE 'blog.%' AND lang = 'fr') "
    "AND NOT CASE WHEN lang = 'en' AND name LIKE '33_' THEN false WHEN lang = 'en' AND name LIKE '3__' THEN true WHEN name LIKE '%1.html' THEN false ELSE coalesce(name, '') LIKE '%.html' END"
)
def paths_by_rules(spark, sf_dir):
    """Pages as paths; rules of the root, of each blog and of each folder of English pages."""
    path = F.rtrim(F.regexp_extract("url", r"^https?://([^?#]*)", 1), F.lit("/"))
    paths = table(spark, sf_dir, "pages").select(F.lit("web").alias("repo_id"), path.alias("path")).distinct()
    part = lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/")
    one = lambda folder, number, line: F.struct(folder.alias("folder"), F.lit(number).cast("long").alias("number"), F.lit(line).alias("line"))
    root = spark.range(1).select(F.lit("web").alias("repo_id"), F.inline(F.array(one(F.lit(""), 1, "*.html"), one(F.lit(""), 2, "!*1.html"), one(F.lit(""), 3, "# a note"))))
    blogs = paths.filter("path like 'blog.%'").select("repo_id", F.inline(F.array(one(F.concat(part(1), F.lit("/")), 1, "fr/"))))
    english = paths.filter(F.get(F.split("path", "/"), 1) == "en").select("repo_id", F.inline(F.array(one(F.concat(part(2), F.lit("/")), 1, "3??"), one(F.concat(part(2), F.lit("/")), 2, "!33?"))))
    return source_files.unignored(paths, root.unionByName(blogs).unionByName(english).distinct())


# Extensions on event time


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query(
    "WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS number FROM g) "
    "SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, number"
)
def events_session(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = rows.groupBy("user_id", F.session_window("at", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")
