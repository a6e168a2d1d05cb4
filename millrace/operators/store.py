"""Tables of chunks, postings, vectors and symbols as Parquet, kept by key.

Rows are partitioned by repo_id and a hash: filters on repo_id prune folders, and writes
replace the buckets that they touch when all their rows are written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import StoreError

#: Buckets that a write names one by one; more are found by a join.
MOST_NAMED = 200


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` that ``new`` does not replace, and all of ``new`` (the last of equal
    keys if it has a column seq, else any one)."""
    if "seq" in new.columns:
        new = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), "seq").alias("row_")).select("row_.*")
    else:
        new = new.dropDuplicates([key])
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def without_repo(rows: DataFrame, repo_id: str) -> DataFrame:
    return rows.filter(F.col("repo_id") != repo_id)


def not_indexed(new: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose chunk_id and content_hash are not there yet."""
    return new.join(known.select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_anti")


def stale(known: DataFrame, current: DataFrame) -> DataFrame:
    """Chunks of the repositories of ``current`` that it no longer has."""
    return known.join(current.select("repo_id").distinct(), "repo_id", "left_semi").join(current, "chunk_id", "left_anti")


class Table:
    """A table at a path that any Hadoop file system can hold. Its folders are the buckets of
    repositories: rows are dealt by a hash of ``spread`` (the key, if not given), and a write
    replaces the buckets that it concerns and no others. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "chunk_id", order: tuple[str, ...] = (), spread: tuple[str, ...] = (), buckets: int = 16):
        self.spark, self.path, self.schema, self.key, self.order = spark, path.rstrip("/"), schema, key, order
        self.spread, self.buckets = spread or (key,), buckets
        self.columns = spark.createDataFrame([], schema).columns

    def _folder(self, *names: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.spread), F.lit(self.buckets)).cast("int"))

    def _read(self) -> DataFrame:
        system, at = self._folder()
        if not system.exists(at):
            return self.spark.createDataFrame([], f"{self.schema}, bucket int")
        return self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.path)

    def read(self) -> DataFrame:
        return self._read().drop("bucket")

    def _write(self, rows: DataFrame) -> None:
        """The rows become all rows of the buckets that they are in. With ``order``, files hold
        ranges of it, so that a condition on its columns opens few of them."""
        parts = ["repo_id", "bucket"]
        rows = rows.repartitionByRange(*parts, *self.order).sortWithinPartitions(*parts, *self.order) if self.order else rows.repartition(*parts)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(self.path)

    def swap(self, rows: DataFrame, gone: DataFrame) -> None:
        """Adds rows, in place of those whose repo_id and further columns are in ``gone``. A
        repository needs a name: rows without one fail the write before anything is replaced."""
        refused = F.raise_error(F.lit("a row needs a repo_id"))
        rows = rows.select(*self.columns).withColumn("repo_id", F.when(F.length("repo_id") > 0, F.col("repo_id")).otherwise(refused))
        rows = self._dealt(rows)
        whole = not set(self.spread) <= set(gone.columns)  # without these, all buckets of a repository
        parts = ["repo_id"] if whole else ["repo_id", "bucket"]
        touched = (gone if whole else self._dealt(gone)).select(*parts).union(rows.select(*parts)).distinct()
        held = self._read()
        if (few := touched.limit(MOST_NAMED + 1).collect()) and len(few) <= MOST_NAMED:  # by name, so that other folders are not listed
            held = held.filter(reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (F.col(p).eqNullSafe(row[p]) for p in parts)) for row in few)))
        else:
            held = held.join(touched, parts, "left_semi")
        now = held.join(gone, gone.columns, "left_anti").unionByName(rows)
        left = held.select("repo_id", "bucket").distinct().join(now.select("repo_id", "bucket").distinct(), ["repo_id", "bucket"], "left_anti").collect()
        self._write(now)
        for repo_id, bucket in left:  # buckets without rows
            self._drop(repo_id, f"bucket={bucket}")

    def upsert(self, rows: DataFrame) -> int:
        """Number of rows that the table has got, new or anew."""
        rows = upserted(rows.limit(0), rows, self.key)
        self.swap(rows, rows.select(*dict.fromkeys(("repo_id", *self.spread, self.key))))
        return rows.count()

    def _drop(self, repo_id: str, *names: str) -> None:
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(repo_id)
        system, at = self._folder(f"repo_id={escaped}", *names)
        system.delete(at, True)

    def delete_repo(self, repo_id: str) -> int:
        """Rows that went."""
        if "'" in repo_id:
            raise StoreError("repo_id must not hold a quote", {"repo_id": repo_id})
        n = self.count(repo_id)
        if n:
            self._drop(repo_id)
        return n

    def count(self, repo_id: str | None = None) -> int:
        rows = self.read()
        return (rows if repo_id is None else rows.filter(F.col("repo_id") == repo_id)).count()
