"""Operator 8: mixing sources to target weights, by DataFrame operations only.

The words of a source, its documents in a fixed order, are packed into blocks of
``BLOCK`` words (the last may be shorter). The mix is a row of slots in output shards. For
each shard the number of slots of each source is a multinomial draw with the targets as
odds; a source's slots are numbered through the shards, cut off at what its target asks
for, and what the draws leave short is dealt in extra shards at the end. Slot k of a
source is mapped to a block by a pseudorandom permutation of the source's block numbers,
another one for each pass over the source, and blocks are joined by number. Whole passes
use all blocks; the pass that is left uses full blocks and ends with part of one, so that
a source gives exactly its target, rounded to words, and no word more than twice.

The permutation is a swap-or-not network, so a block number is computed from a slot number
without a sort. Offsets of documents in a source are sums over buckets of documents and
sums within a bucket, and sources are numbered in the same way, so no task holds a source or
all sources, and the driver sees sums alone.

Defined results: null and wordless texts have size 0 and give nothing; a null source is a
source of its own, the last; sources without words have target 0; an empty table gives an
empty result; repeated rows are rows of their own. Other columns are ignored.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import checkpoint, join_counted, pieces, words_of

BLOCK = 256
SHARD_SLOTS = 8192
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 20
ROUNDS = 12
#: Fewest documents whose offsets are summed together; of many documents it is their square root.
BUCKET_ROWS = 256
#: Fewest equal parts of the unit interval by which a draw finds its source; of more sources there are as many as these.
CELLS = 4096


def _permuted(k: Column, n: Column, *key: Column) -> Column:
    """A permutation of 0 to n - 1 that depends on the key: in each round a number and its
    mirror image change places or stay, by a hash of the larger one."""

    def swap(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), *key, r), n) - x, n)
        return F.when(F.xxhash64(F.lit(SEED + 1), *key, r, F.greatest(x, mirror)) % 2 == 0, x).otherwise(mirror)

    return F.aggregate(F.array(*(F.lit(r) for r in range(ROUNDS))), k.cast("long"), swap)


def _before(sources: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the sum of a value over the sources of smaller places: sums over ``part``, ranges
    of places, and sums within a range, so that no task holds all sources."""
    parts = sources.groupBy("part").agg(F.sum(value).alias("all"))
    parts = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("ahead"))
    inside = F.sum(value).over(Window.partitionBy("part").orderBy("place")) - value
    return sources.withColumn(name, inside).join(parts, "part").withColumn(name, F.col(name) + F.col("ahead")).drop("ahead")


def placed_sources(sized: DataFrame) -> DataFrame:
    """part, place, source and source_size: places are numbers in code point order, null last."""
    found = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # numbered in order within the ranges that the sort deals; then by what is ahead of a range
    found = checkpoint(found.orderBy(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id()))
    found = found.withColumn("part", F.shiftright("place", 33))
    return checkpoint(_before(found, F.lit(1).cast("long"), "number").withColumn("place", F.col("number")).drop("number"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds target, the words to take from each source: shares by weight, none above ``most``
    times its size, with the excess reshared until none is above. The driver sees sums only."""
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double"))
    most_of, above, level = F.col("source_size") * float(most), F.lit(False), 0.0
    total, before = float(share) * (weighed.agg(F.sum("source_size")).first()[0] or 0), -1
    while True:
        n, held, rest = weighed.agg(F.count_if(above), F.sum(F.when(above, most_of)), F.sum(F.when(~above, F.col("weight")))).first()
        if n == before or not rest:
            break
        level, before = (total - (held or 0.0)) / rest, n
        above = F.col("weight") * level > most_of
    return weighed.withColumn("target", F.when(above, most_of).otherwise(F.col("weight") * level)).drop("weight")


def size_sources(docs: DataFrame, *keys: Column) -> tuple[DataFrame, DataFrame, int]:
    """Rows (doc_id, text_key, size, further keys and what the source has), the sources, and how many buckets the rows fill."""
    sized = checkpoint(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_key"), words_of().alias("size"), *keys))
    sources = checkpoint(targets(placed_sources(sized)))
    named = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("named")  # a null source is a source
    joined = join_counted(sized.select("*", named).drop("source"), sources.select(named, "place", "source_size", "target"), ["named"]).drop("named")
    return joined, sources, max(1, (n := sized.count()) // max(BUCKET_ROWS, isqrt(n)))


def slots(sources: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix: shard, place (the source's), k (its slot number), block and words taken from it."""
    spark = sources.sparkSession
    words = F.round("target").cast("long")
    sources = sources.filter("source_size > 0 and round(target) > 0").select(
        "part",
        "place",
        F.ceil(F.col("source_size") / block).cast("long").alias("blocks"),
        F.floor(F.col("source_size") / block).cast("long").alias("full"),
        F.floor(words / F.col("source_size")).cast("long").alias("passes"),
        F.pmod(words, "source_size").alias("over"),
    ).withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("over") / block))
    odds = checkpoint(_before(sources, F.col("slots"), "ahead_of"))
    total, n = odds.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count("*")).first()
    n_cells = max(CELLS, n)
    shards = -(-total // shard_slots)
    sources = odds.drop("part", "ahead_of")
    odds = odds.withColumns({"hi": (F.col("ahead_of") + F.col("slots")) / max(1, total), "lo": F.col("ahead_of") / max(1, total)})
    cells = odds.select("place", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * n_cells), F.least(F.floor(F.col("hi") * n_cells), F.lit(n_cells - 1)))).alias("cell"))
    draw = (F.pmod(F.xxhash64(F.lit(SEED + 2), "id"), F.lit(1 << 52)) / float(1 << 52)).alias("u")
    draws = spark.range(total).select(F.floor(F.col("id") / shard_slots).alias("shard"), draw).withColumn("cell", F.floor(F.col("u") * n_cells))
    drawn = checkpoint(draws.join(cells, "cell").filter("u >= lo and u < hi").groupBy("shard", "place").count())
    until = F.sum("count").over(Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    ranges = drawn.withColumn("until", until).join(sources, "place")
    dealt = ranges.select("place", "shard", (F.col("until") - F.col("count")).alias("start"), F.least("until", "slots").alias("end"))
    short = sources.join(drawn.groupBy("place").agg(F.sum("count").alias("got")), "place", "left").select("place", F.coalesce("got", F.lit(0)).alias("start"), F.col("slots").alias("end"))
    extra = short.filter("start < end").select(
        "place", F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(shard_slots).cast("long"))).alias("start"), "end"
    ).select("place", (F.lit(shards) + F.floor(F.col("start") / shard_slots)).alias("shard"), "start", F.least("end", F.col("start") + shard_slots).alias("end"))
    # a source's slots are numbered where its few shards are; they become rows where each shard is
    every = dealt.unionByName(extra).filter("start < end").repartition(pieces(total, 1 << 17), "place", "shard")
    every = every.select("place", "shard", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("k"))
    every = every.join(sources, "place").withColumn("pass", F.floor(F.col("k") / F.col("blocks")).cast("long"))
    whole = F.col("pass") < F.col("passes")
    within = F.when(whole, F.pmod("k", "blocks")).otherwise(F.col("k") - F.col("passes") * F.col("blocks"))
    domain = F.when(whole, F.col("blocks")).otherwise(F.greatest("full", F.lit(1)))
    # past the full blocks of the last pass only the short block is left
    at = F.when(~whole & (F.col("within") >= F.col("full")), F.col("blocks") - 1).otherwise(_permuted(F.col("within"), F.col("domain"), F.col("place"), F.col("pass")))
    taken = F.when(whole, F.lit(block)).otherwise(F.least(F.lit(block), F.col("over") - F.col("within") * block))
    return every.withColumns({"within": within, "domain": domain}).select("shard", "place", "k", at.alias("block"), taken.cast("long").alias("words"))


def located(rows: DataFrame, buckets: int) -> DataFrame:
    """Adds start: where a row's words begin in its source. A ``row_key`` orders rows that repeat an id and a text."""
    order = ["doc_id", "text_key", "size", *(c for c in ["row_key"] if c in rows.columns)]
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(buckets)))
    totals = rows.groupBy("place", "bucket").agg(F.sum("size").alias("n"))
    before = totals.select("place", "bucket", (F.sum("n").over(Window.partitionBy("place").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("place", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return rows.withColumn("inside", inside).join(before, ["place", "bucket"]).withColumn("start", F.col("before") + F.col("inside")).drop("bucket", "inside", "before")


def pieces_taken(rows: DataFrame, sources: DataFrame, buckets: int, block: int = BLOCK) -> DataFrame:
    """For each row and block that it has words in: where (from, to, in words of the row),
    how often the mix takes the whole piece and how many words of it once more."""
    plan = slots(sources, block)
    uses = plan.groupBy("place", "block").agg(F.count_if(F.col("words") == block).alias("times"), F.max(F.when(F.col("words") < block, F.col("words"))).alias("part"))
    own = located(rows.filter("size > 0"), buckets)
    cut = own.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    low, high = F.greatest("start", F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    cut = cut.withColumns({"low": low, "high": high}).join(uses, ["place", "block"], "left")
    part = F.greatest(F.lit(0), F.least(F.col("high"), F.col("block") * block + F.coalesce("part", F.lit(0))) - F.col("low"))
    return cut.select(*own.columns, (F.col("low") - F.col("start")).alias("from"), (F.col("high") - F.col("start")).alias("to"), F.coalesce("times", F.lit(0)).alias("times"), part.cast("long").alias("part"))


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) of each row."""
    rows, sources, buckets = size_sources(docs)
    cut = pieces_taken(rows, sources, buckets, block)
    words = (F.col("to") - F.col("from")) * F.col("times") + F.col("part")
    some = cut.groupBy("place", "start", "doc_id", "size", "source_size", "target").agg(F.sum(words).cast("long").alias("taken"))
    none = rows.filter("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return some.select(none.columns).unionByName(none)


def _row_key(docs: DataFrame) -> Column:
    """A hash of all columns, with which of them are null; maps are hashed in their written form."""
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    return F.xxhash64(*plain, *(c.isNull() for c in plain))


def mixed_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that the mix takes words of, with the words it takes as text.

    A row's pieces follow each other in their order, a first time and, where they are taken
    twice, a second time; words keep the white space before them. Rows that are equal in
    all columns are one row here, whose pieces are joined; rows that repeat an id and a text
    in different sources stay apart, each with what its source gives. n_chars follows the new text.
    """
    row_key = _row_key(docs).alias("row_key")
    rows, sources, buckets = size_sources(docs, row_key)
    cut = pieces_taken(rows, sources, buckets, block)
    once = F.when(F.col("times") > 0, F.col("to") - F.col("from")).otherwise(F.col("part"))
    again = F.when(F.col("times") > 1, F.col("to") - F.col("from")).when(F.col("times") == 1, F.col("part")).otherwise(F.lit(0))
    span = F.struct("start", "from", once.alias("once"), again.alias("again"))
    plan = cut.withColumns({"once": once, "again": again}).filter("once > 0").groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_list(span)).alias("spans"), F.max("size").alias("size"))
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    keyed = docs.select("doc_id", "text", row_key, rest.alias("whole_row")).dropDuplicates(["doc_id", "row_key"])
    word = F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    joined = keyed.join(plan.withColumnRenamed("doc_id", "id").withColumnRenamed("row_key", "key"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row_key") == F.col("key")))

    def taken(which: str) -> Column:
        apart = lambda s: F.when((s["from"] == 0) & (s[which] > 0), " ").otherwise("")  # noqa: E731  a text's first word has no white space before it
        return F.transform("spans", lambda s: F.concat(apart(s), F.array_join(F.slice("words", (s["from"] + 1).cast("int"), s[which].cast("int")), "")))

    whole = (F.size("spans") > 0) & F.forall("spans", lambda s: s["again"] == 0) & (F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["once"]) == F.col("size"))
    text = F.when(whole, F.col("text")).otherwise(F.trim(F.array_join(F.concat(taken("once"), taken("again")), "")))
    made = joined.withColumn("words", F.when(~whole, word)).withColumn("text", text)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return made.select(*(new[c].alias(c) if c in new else F.col(f"whole_row.`{c}`").alias(c) for c in docs.columns))
