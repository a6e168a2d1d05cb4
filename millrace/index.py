"""An index: tables of chunks, postings, vectors, symbols and edges that are kept in step.

The chunk table is written last. A chunk counts as indexed only by its row there, so an
index run that failed half way is made good by the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.errors import MissingRepository
from millrace.functions import text as t
from millrace.operators import fusion, graph, lexical, match, store
from millrace.providers import Embedder, embedded
from millrace.schema import CHUNKS, EDGES, SYMBOLS, checked_chunks
from millrace.sources import files


#: Fields of the text index, and the columns that they hold.
FIELDS = {"content": "content", "symbol": "symbol"}


class Index:
    def __init__(self, spark: SparkSession, root: str, embed: Embedder):
        self.spark, self.embed, self.root = spark, embed, root
        of = lambda name, schema, **more: store.Table(spark, f"{root}/{name}", schema, **more)
        self.chunks = of("chunks", f"{CHUNKS}, indexed_at timestamp")
        self.vectors = of("vectors", "chunk_id string, repo_id string, path string, language string, kind string, vector array<float>")
        self.postings = of("postings", "term string, chunk_id string, repo_id string, field string, dl int, tf int, positions array<int>", order=("term",))
        self.lengths = of("lengths", "chunk_id string, repo_id string, dl int")
        self.symbols = of("symbols", f"repo_id string, {SYMBOLS}", order=("name",), spread=("path",))
        self.edges = of("edges", f"repo_id string, {EDGES}", spread=("src_path",))

    def _staged(self, rows: DataFrame, path: str) -> tuple[DataFrame, int]:
        """Rows written down, and their number, which the write itself observes."""
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path), seen.get["n"]

    def add(self, chunks: DataFrame, prune: bool = False) -> dict[str, int]:
        """Chunks that are new are embedded, cut into terms and written; symbols of their files
        are made anew. With ``prune`` what a repository no longer has is taken out. The input is
        read once, and where nothing is new or gone, nothing is written."""
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        chunks, n_all = self._staged(checked_chunks(chunks).dropDuplicates(["chunk_id"]), f"{staged}/chunks")
        repos, files_of = chunks.select("repo_id").distinct(), chunks.select("repo_id", "path").distinct()
        known = self.chunks.read().join(repos, "repo_id", "left_semi")
        new, n_new = self._staged(store.not_indexed(chunks, known), f"{staged}/new")
        ids, gone = new.select("repo_id", "chunk_id"), 0
        if prune:
            stale, gone = self._staged(store.stale(known, chunks).select("repo_id", "chunk_id"), f"{staged}/stale")
            ids = ids.union(stale)
        if n_new or gone:
            links, n_edges = self._staged(graph.python_edges(chunks), f"{staged}/links")
            distinct = graph.edges(links).count()
            self.symbols.swap(graph.with_ends(graph.symbols_of(chunks), links), repos if prune else files_of)
            self.edges.swap(links, repos if prune else files_of.withColumnRenamed("path", "src_path"))
            made = embedded(new, self.embed).select("chunk_id", "repo_id", "path", "language", "kind", "vector")
            self.vectors.swap(made, ids)
            self.postings.swap(lexical.placed_postings(new, "chunk_id", FIELDS, keep=("repo_id",)), ids)
            self.lengths.swap(lexical.lengths(new, "chunk_id", *FIELDS.values(), keep=("repo_id",)), ids)
            self.chunks.swap(new.withColumn("indexed_at", F.current_timestamp()), ids)
        else:  # those of these files are stored: chunks count as indexed after them
            own = self.edges.read().join(files_of.withColumnRenamed("path", "src_path"), ["repo_id", "src_path"], "left_semi")
            n_edges, distinct = own.count(), graph.edges(own).count()
        counted = {"chunks_total": n_all, "chunks_embedded": n_new, "chunks_cached": n_all - n_new, "chunks_pruned": gone, "edges": n_edges, "edges_distinct": distinct}
        at = self.spark._jvm.org.apache.hadoop.fs.Path(staged)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return counted

    def delete_repo(self, repo_id: str) -> dict[str, int]:
        """Rows that went from each table; the chunk table, which says what is indexed, is first."""
        return {name: getattr(self, name).delete_repo(repo_id) for name in ("chunks", "lengths", "postings", "vectors", "symbols", "edges")}

    def ingest(self, root: str, repo_id: str, extra_ignores: list[str] | None = None, known: DataFrame | None = None, prune: bool = False) -> dict[str, int]:
        chunks, stats = files.ingest(files.scan(self.spark, root, repo_id, extra_ignores), known)
        return self.add(chunks, prune) | stats.first().asDict()

    def stored(self) -> tuple[DataFrame, DataFrame]:
        """Postings, of all fields taken together, and lengths."""
        return lexical.merged(self.postings.read(), "chunk_id", ("repo_id",)), self.lengths.read()

    def _of_repo(self, filters: dict | None) -> Column | None:
        repo = fusion.repo_of(filters)
        if repo is not None and not self.chunks.count(repo):
            raise MissingRepository("not indexed", {"repo_id": repo})
        return None if repo is None else F.col("repo_id") == repo

    def retrieve(self, question: str, k: int = 10, filters: dict | None = None) -> DataFrame:
        self._of_repo(filters)
        return fusion.hybrid(self.chunks.read(), self.vectors.read(), "chunk_id", tuple(FIELDS.values()), question, self.embed([question])[0], k, filters, stored=self.stored())

    def retrieve_many(self, questions: DataFrame, k: int = 10, filters: dict | None = None) -> DataFrame:
        """Chunks with query_id, score and rank: for each row (query_id, question) what
        ``retrieve`` finds for it, by one job."""
        where = self._of_repo(filters)
        asked = embedded(questions.select("query_id", "question").filter(F.length("question") > 0), self.embed, "question").withColumn("words", t.terms(F.col("question")))
        found = fusion.hybrid_many(self.vectors.read(), self.stored(), "chunk_id", asked, k, where)
        return found.join(self.chunks.read(), "chunk_id").withColumn("source", F.lit("fused"))

    def match(self, text: str, k: int | None = 10, filters: dict | None = None) -> DataFrame:
        """chunk_id and score of the chunks that a match text (terms, phrases, AND, OR, NOT, NEAR,
        fields content and symbol) holds for."""
        tree = match.parse(self.spark, text, tuple(FIELDS))
        return match.search((self.postings.read(), self.lengths.read()), "chunk_id", tree, k, self._of_repo(filters), ("repo_id",))
