"""What tasks of the pipeline's stages are handed and hold at a time."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import quality_mil, simhash, suffix_dedup
from millrace.llm.common import BATCH_BYTES, SLICE_BYTES, small_batches


@pytest.fixture
def unset(spark):
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.unset(BATCH_BYTES)
    yield spark
    if before is None:
        spark.conf.unset(BATCH_BYTES)
    else:
        spark.conf.set(BATCH_BYTES, before)


def most_handed(rows):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["size"])

    return rows.mapInArrow(sizes, "size long").agg(F.max("size")).first()[0]


@pytest.mark.parametrize("stage", ["quality", "simhash", "suffix"])
def test_stages_hand_workers_small_batches(unset, stage):
    docs = unset.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 40).alias("text")).withColumn("n_chars", F.length("text"))
    few = docs.limit(5)
    if stage == "quality":
        quality_mil.keep(few, quality_mil.GatedAttention())
    elif stage == "simhash":
        simhash.keep_one(few)
    else:
        suffix_dedup.cut_documents(few)
    assert most_handed(docs.select("text")) < 2 * SLICE_BYTES


def test_a_size_that_the_session_names_stays(unset):
    unset.conf.set(BATCH_BYTES, "32m")
    small_batches(unset)
    assert unset.conf.get(BATCH_BYTES) == "32m"


def solved(texts, chunks):
    ids = pa.array(np.arange(len(texts)))
    batch = pa.RecordBatch.from_arrays([ids, pa.array(texts), pa.array(np.zeros(len(texts), np.int64))], names=["doc_id", "text", "tag"])
    table = pa.Table.from_batches([*suffix_dedup._deal(1, 50)(batch.slice(i, len(texts) // chunks) for i in range(0, len(texts), len(texts) // chunks))])
    tracemalloc.start()
    found = suffix_dedup._solve(50, 3)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return suffix_dedup._by_document(pa.table({"found": found["found"]})).to_pydict(), peak


def test_a_block_of_common_text_is_solved_in_little_memory(monkeypatch):
    rnd = np.random.default_rng(5)
    own = [bytes(rnd.integers(97, 123, 2000, dtype=np.uint8)).decode() for _ in range(1000)]
    texts = [own[i // 2] if i % 4 == 1 else own[i // 2][:900] + str(i) * 20 + own[i // 2][900:] for i in range(2000)]
    got, peak = solved(texts, 4)
    assert peak < 80e6
    assert set(got["doc_id"]) >= set(range(1, 2000, 2))
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 64 << 20)
    assert solved(texts, 2)[0] == got
