"""Symbols and the edges between them as two tables.

A node is a path and a name, of a repository where the tables have a repo_id: what several
repositories call alike stays apart. Rows of one node are ordered by seq, and the last holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.errors import StoreError
from millrace.functions import text as t
from millrace.schema import EDGE_KINDS, EDGES, SYMBOLS

_ENDS = ["src_path", "src_name", "dst_path", "dst_name", "kind"]


def nodes(symbols: DataFrame) -> DataFrame:
    """The last row of each path and name."""
    own = [*_repo(symbols), "path", "name"]
    return symbols.groupBy(*own).agg(F.max_by(F.struct("kind", "line", "parent", "seq"), "seq").alias("s")).select(*own, "s.*")


def _repo(*tables: DataFrame) -> list[str]:
    return ["repo_id"] if all("repo_id" in rows.columns for rows in tables) else []


def with_ends(symbols: DataFrame, links: DataFrame) -> DataFrame:
    """The symbols, and as nodes of no known kind the ends of edges that none of them is."""
    repo = _repo(symbols, links)
    ends = [links.select(*repo, F.col(f"{e}_path").alias("path"), F.col(f"{e}_name").alias("name")) for e in ("src", "dst")]
    bare = ends[0].unionByName(ends[1]).distinct().join(symbols, [*repo, "path", "name"], "left_anti")
    return symbols.unionByName(bare.select("*", F.lit("other").alias("kind"), F.lit(1).alias("line"), F.lit(None).cast("string").alias("parent"), F.lit(-1).cast("long").alias("seq")))


def edges(rows: DataFrame) -> DataFrame:
    """Each edge once; an unknown kind fails when rows are read."""
    kind = F.when(F.col("kind").isin(*EDGE_KINDS), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind of edge: "), "kind")))
    return rows.withColumn("kind", kind).dropDuplicates([*_repo(rows), *_ENDS])


def _python(chunks: DataFrame) -> DataFrame:
    """Chunks with a symbol, of files that have no other language among those."""
    named = chunks.filter(F.col("symbol").isNotNull() & (F.col("symbol") != ""))
    other = named.filter(F.col("language") != "python").select("repo_id", "path").distinct()
    return named.join(other, ["repo_id", "path"], "left_anti")


def _edge(src_path, src_name, dst_path, dst_name, kind: str) -> list:
    return [F.col(src_path).alias("src_path"), src_name.alias("src_name"), F.col(dst_path).alias("dst_path"), F.col(dst_name).alias("dst_name"), F.lit(kind).alias("kind")]


def defines(chunks: DataFrame) -> DataFrame:
    """From a file's module to each of its classes and functions."""
    top = _python(chunks).filter(F.col("kind").isin("class", "function"))
    return top.select("repo_id", *_edge("path", t.stem(F.col("path")), "path", "symbol", "defines"))


def contained_in(chunks: DataFrame) -> DataFrame:
    """From a class to each method inside it; the class that starts last is the nearest.

    The join is by file, so a file's ranges meet in one task and no others do.
    """
    named = _python(chunks)
    method = named.filter("kind = 'method'").select("repo_id", "path", "chunk_id", F.col("symbol").alias("method"), "start_line", "end_line")
    held = named.filter("kind = 'class'").select("repo_id", "path", F.col("symbol").alias("class"), F.col("start_line").alias("c_start"), F.col("end_line").alias("c_end"), F.col("chunk_id").alias("c_id"))
    pairs = method.join(held, ["repo_id", "path"]).filter("c_start <= start_line and end_line <= c_end")
    nearest = pairs.groupBy("repo_id", "path", "chunk_id", "method").agg(F.max_by("class", F.struct("c_start", "c_id")).alias("class"))
    return nearest.select("repo_id", *_edge("path", F.col("class"), "path", "method", "contained_in"))


def python_edges(chunks: DataFrame) -> DataFrame:
    return defines(chunks).unionByName(contained_in(chunks))


def symbols_of(chunks: DataFrame) -> DataFrame:
    """The nodes that the edges of chunks have: definitions and their modules."""
    named = _python(chunks).filter(F.col("kind").isin("class", "function", "method"))
    own = named.select("repo_id", "path", F.col("symbol").alias("name"), "kind", F.col("start_line").alias("line"), F.lit(None).cast("string").alias("parent"), F.col("start_line").cast("long").alias("seq"))
    module = named.filter(F.col("kind").isin("class", "function")).select("repo_id", "path", t.stem(F.col("path")).alias("name")).distinct()
    return module.select("repo_id", "path", "name", F.lit("module").alias("kind"), F.lit(1).alias("line"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("seq")).unionByName(own)


def by_name(symbols: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    found = nodes(symbols).filter(F.col("name") == name)
    return (found if kind is None else found.filter(F.col("kind") == kind)).orderBy("path", "line")


def has_symbol(symbols: DataFrame, path: str, name: str) -> bool:
    return not symbols.filter((F.col("path") == path) & (F.col("name") == name)).isEmpty()


def neighbours(symbols: DataFrame, links: DataFrame, name: str, callers: bool) -> DataFrame:
    """Symbols that call (or that are called by) any symbol of a name, each once, in order."""
    here, there = ("dst", "src") if callers else ("src", "dst")
    repo, known = _repo(symbols, links), nodes(symbols)
    anchors = known.filter(F.col("name") == name).select(*repo, F.col("path").alias(f"{here}_path"), F.col("name").alias(f"{here}_name"))
    ends = links.filter("kind = 'calls'").join(anchors, [*repo, f"{here}_path", f"{here}_name"], "left_semi")
    found = ends.select(*repo, F.col(f"{there}_path").alias("path"), F.col(f"{there}_name").alias("name")).distinct()
    return found.join(known, [*repo, "path", "name"]).select(*repo, "name", "kind", "path", "line", "parent").orderBy(*repo, "path", "name")


def export_json(symbols: DataFrame, links: DataFrame, path: str) -> None:
    """Nodes and edges as gzipped JSON lines."""
    nodes(symbols).drop("repo_id").select(F.to_json(F.struct(F.lit("node").alias("type"), "*")).alias("value")).unionByName(
        edges(links).select(F.to_json(F.struct(F.lit("edge").alias("type"), F.col("src_path"), F.col("src_name"), F.col("dst_path"), F.col("dst_name"), F.col("kind").alias("edge_kind"))).alias("value"))
    ).write.option("compression", "gzip").mode("overwrite").text(path)


def import_json(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """The two tables that ``export_json`` wrote; anything else is refused."""
    try:
        rows = spark.read.text(path)
        rows.limit(1).count()
    except Exception as error:
        raise StoreError("a graph can't be read", {"path": path, "error": str(error)[:300]}) from error
    node = rows.select(F.from_json("value", f"type string, {SYMBOLS}").alias("x")).filter("x.type = 'node'").select("x.*").drop("type")
    edge = rows.select(F.from_json("value", f"type string, {EDGES.replace('kind', 'edge_kind')}").alias("x")).filter("x.type = 'edge'").select("x.*").drop("type").withColumnRenamed("edge_kind", "kind")
    kind, name = F.get_json_object("value", "$.type"), F.coalesce(F.get_json_object("value", "$.name"), F.get_json_object("value", "$.dst_name"))
    if rows.filter(kind.isNull() | ~kind.isin("node", "edge") | name.isNull()).limit(1).count():
        raise StoreError("not a graph", {"path": path})
    return node, edge


NODE = "struct<id: array<string>, node_id: array<string>, name: string, kind: string, path: string, line: int, parent: string>"
LINK = "struct<source: array<string>, target: array<string>, key: string, kind: string>"


def import_node_link(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges of node-link documents (JSON, gzipped or not): arrays of nodes, whose id
    is a path and a name, and of edges or links between ids. Several documents of a folder are
    read in parallel. What can't be read, or has other ids, is refused."""
    try:
        rows = spark.read.schema(f"nodes array<{NODE}>, edges array<{LINK}>, links array<{LINK}>").option("multiLine", True).option("mode", "FAILFAST").json(path)
        found = rows.select(F.inline("nodes"))
        own = F.coalesce("node_id", "id")
        node = found.select(own[0].alias("path"), own[1].alias("name"), "kind", "line", "parent", F.monotonically_increasing_id().alias("seq"), F.size(own).alias("size_"))
        ends = rows.select(F.inline(F.coalesce("edges", "links")))
        edge = ends.select(*(F.col(f"{a}")[i].alias(f"{b}_{c}") for a, b in (("source", "src"), ("target", "dst")) for i, c in enumerate(("path", "name"))), F.coalesce("kind", "key").alias("kind"), (F.size("source") + F.size("target")).alias("size_"))
        wrong = rows.filter(F.col("nodes").isNull() | F.coalesce("edges", "links").isNull()).count()
        wrong += node.filter("size_ <> 2 or name is null or path is null").count() + edge.filter("size_ <> 4").count()
    except Exception as error:
        raise StoreError("a graph can't be read", {"path": path, "error": str(error)[:300]}) from error
    if wrong or not edge.filter(~F.col("kind").isin(*EDGE_KINDS)).isEmpty():
        raise StoreError("not a graph", {"path": path})
    return node.drop("size_"), edges(edge.drop("size_"))
