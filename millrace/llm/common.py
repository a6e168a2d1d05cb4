"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of bytes other than ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a task works on at a time, so that its arrays stay in the CPU caches.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id's text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def words_of(text: str = "text") -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


#: Folders made for sessions that name none, by application.
_OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of its own only where none is set and all
    tasks run in the driver's process, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        import tempfile

        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")

        application = spark.sparkContext.applicationId
        if application not in _OWN_FOLDERS:
            _OWN_FOLDERS[application] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        folder = _OWN_FOLDERS[application]
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a table written in the shared folder: it is computed once, and
    neither its shuffle files nor any executor is needed to read it again."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers each that may be sent to every task.
MOST_BROADCAST = 100_000


def join_counted(rows: DataFrame, few: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Joins rows to ``few``, which is written down and counted first: up to ``MOST_BROADCAST``
    of its rows go to the rows, so that a common key is not gathered; with more of them both
    sides are dealt by the key, and Spark splits the partitions of common keys as it runs
    (which it can, as the counted side is a plain table)."""
    few = checkpoint(few)
    return rows.join(F.broadcast(few) if few.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else few, on, how)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nothing refers to any more, which
    it otherwise does when the driver happens to collect its garbage. What one collection
    has let go of is only seen by the next, and files are deleted in the background."""
    import gc
    import time

    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def let_go() -> None:
    """Gives memory that arrays no longer use back to the system: Python workers serve one
    stage after the other, and would keep the most that any of them needed."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # where the C library has it
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python workers in batches of about ``SLICE_BYTES``
    (a longer row alone), unless it names a size of its own. Spark fills batches with up to 64
    MB, which are held by the executor, the pipe's buffer and the worker at once; after buffers
    of that size the C library also keeps as much of each thread's freed memory. A setting of
    the session, as the frames that operators return are run later by whoever asked for them."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, SLICE_BYTES)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and offsets, without a copy of the bytes; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], at - at[0] if len(at) else np.zeros(1, np.int64)


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes; a longer row stands alone."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def pieces(total_bytes: int, each: int, least: int = 8) -> int:
    """How many parts a job of so many bytes is dealt to."""
    return max(least, -(-int(total_bytes) // each))


#: Low bits of a hash that give way to a place.
PLACE_BITS = np.uint64(20)


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each ``n`` neighbours."""
    span = 1
    while span * 2 <= n:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (n - span)], x[n - span :]) if n > span else x


def leftmost(hashed: np.ndarray, n: int) -> np.ndarray:
    """The place of the smallest hash of each ``n`` neighbours, the leftmost on ties. Hashes
    count without their low bits, as many in a text of any length: these hold a place."""
    mask = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    room = (1 << int(PLACE_BITS)) - n + 1  # of longer texts so many windows at a time
    out = np.empty(len(hashed) - n + 1, np.int64)
    for first in range(0, len(out), room):
        own = hashed[first : first + room + n - 1]
        least = _least(own & ~mask | np.arange(len(own), dtype=np.uint64), n)
        out[first : first + room] = (least & mask).astype(np.int64) + first
    return out


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; each is preceded by its length in bytes."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b"".join(len(a).to_bytes(8, "little") + a for a in (x.tobytes() for x in arrays)))


def unpacked(value: bytes, *kinds) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(value), 0, []
    for kind in kinds:
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def planes(x: np.ndarray) -> np.ndarray:
    """The bytes of 64-bit numbers, all first bytes before all second ones; these compress well."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T)


def numbers(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").ravel()


#: Larger doc_ids stand for null ones, which come after all others.
NULL_FROM = (1 << 63) - 1 - (1 << 31)


def tagged(docs: DataFrame, *more: str, bits: int = 30) -> DataFrame:
    """doc_id, text and tag: 0 while ids are unique, else a hash that tells the texts of an id
    apart. Null ids become numbers above ``NULL_FROM``, by another hash of the text."""
    unnamed = F.lit((1 << 63) - 1) - F.pmod(F.xxhash64(F.lit(7), "text"), F.lit(1 << 31))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), unnamed).alias("doc_id"), "text", *more)
    repeated = rows.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0
    return rows.withColumn("tag", F.pmod(F.coalesce(F.xxhash64("text"), F.lit(0)), F.lit(1 << bits)) if repeated else F.lit(0).cast("long"))


def named(doc_id: str = "doc_id") -> Column:
    """The id that a row of ``tagged`` came with."""
    return F.when(F.col(doc_id) <= NULL_FROM, F.col(doc_id))


def join_hubs(rows: DataFrame, few: DataFrame, on: list[str], many: str, most: int = 2000) -> DataFrame:
    """Inner join of rows with ``few`` (a written table of unique keys), whose column ``many``
    says how many rows have the key. The keys of more than a ``most``-th of all these rows,
    which are at most ``most``, go to the rows; the rest are dealt by the key."""
    total = few.agg(F.sum(many)).first()[0] or 0
    hot = F.col(many) > max(256, total // most)
    hubs = F.broadcast(few.filter(hot))
    return rows.join(hubs, on).unionByName(rows.join(F.broadcast(few.filter(hot).select(*on)), on, "left_anti").join(few.filter(~hot), on))


class Sieve:
    """A bitmap of 64-bit names: has() is true for all that are in it, and few others while it
    is not crowded. Its size is bounded, so it can go to every task; a crowded one lets more
    through, and whoever asks must be right with that."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, names: np.ndarray) -> np.ndarray:
        out = np.ones(len(names), bool)
        for turn in range(SIEVE_HASHES):
            at = _sieved(names.view(np.uint64), turn, len(self.words) * 64)
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out

    def lets(self, name: Column) -> Column:
        """has() as a column; only the names go to Python."""

        @F.arrow_udf("boolean")
        def held(names: pa.Array) -> pa.Array:
            return pa.array(self.has(names.to_numpy()))

        return held(name)


#: Bits of each name, and the most bits of a sieve (16 MB).
SIEVE_HASHES, SIEVE_BITS = 2, 1 << 27


def _sieved(names: np.ndarray, turn: int, bits: int) -> np.ndarray:
    x = (names ^ (names >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15 + 2 * turn)
    return (x ^ (x >> np.uint64(32))) & np.uint64(bits - 1)


def sieve(rows: DataFrame, column: str, count: int) -> Sieve:
    """A bitmap of the longs in a column of ``count`` rows. Tasks set bits, words of 64 are
    joined by Spark, and the driver sees these words alone."""
    bits = 1 << min(SIEVE_BITS.bit_length() - 1, max(10, (16 * count).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy().view(np.uint64)
            at = np.unique(np.concatenate([_sieved(names, turn, bits) for turn in range(SIEVE_HASHES)]))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            if len(word):
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(value.view(np.int64))], names=["word", "bits"])

    words = np.zeros(bits // 64, np.uint64)
    found = rows.select(column).mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return Sieve(words)
