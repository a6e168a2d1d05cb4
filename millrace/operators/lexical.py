"""Full-text search by BM25.

Asked often, a table is indexed once: ``postings`` and ``lengths`` are stored, and ``bm25``
reads the postings of the asked terms and nothing of the texts. ``bm25_scan`` asks a table
that has no index, by one pass for the statistics and one for the scores. Statistics are
those of the whole table; filters on rows come after them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.errors import RetrieveError, StoreError
from millrace.functions import text as t

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6


def query_terms(spark, query: str) -> list[str]:
    """A query's terms, each once, in order; the same folding as for documents."""
    found = spark.range(1).select(t.terms(F.lit(query)).alias("x")).first()[0]
    return list(dict.fromkeys(found))


def tokenised(rows: DataFrame, *columns: str) -> DataFrame:
    """Adds tokens: the terms of all given columns, nulls as none."""
    parts = [t.terms(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    return rows.withColumn("tokens", parts[0] if len(parts) == 1 else F.concat(*parts))


def lengths(rows: DataFrame, key: str, *columns: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, what else is kept, and dl (number of tokens) of every row."""
    return tokenised(rows, *columns).select(key, *keep, F.size("tokens").alias("dl"))


#: Tokens that are grouped at once; a row with more is grouped alone.
SLICE = 1 << 18


def _row_postings(part: pa.RecordBatch, heads: int, names: list[str], places: bool) -> pa.RecordBatch:
    """The first columns of rows, dl, and found: the postings of their lists of tokens, which follow."""
    lists = [part.column(heads + i) for i in range(len(names))]
    sizes = [x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
    tokens = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
    code = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.concatenate([np.repeat(np.arange(len(part)), n) for n in sizes])
    at = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in sizes])
    field = np.repeat(np.arange(len(names)), [n.sum() for n in sizes])
    term_of_row = row * max(1, len(tokens.dictionary)) + code
    group = term_of_row * len(names) + field
    order = np.argsort(group, kind="stable")  # positions stay in order
    begins = np.flatnonzero(np.diff(group[order], prepend=-1))
    lead = order[begins]
    ends = np.append(begins, len(order))
    columns = {
        "term": tokens.dictionary.take(pa.array(code[lead])), "field": pa.array(names).take(pa.array(field[lead])), "tf": pa.array(np.diff(ends).astype(np.int32)),
        "first": pa.array(np.diff(term_of_row[lead], prepend=-1) != 0),
    }
    if places:
        columns["positions"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at[order].astype(np.int32)))
    found = pa.StructArray.from_arrays(list(columns.values()), list(columns))
    of_row = pa.array(np.searchsorted(row[lead], np.arange(len(part) + 1)).astype(np.int32))
    head = {part.schema.names[i]: part.column(i) for i in range(heads)}
    return pa.RecordBatch.from_pydict(head | {"dl": pa.array(sum(sizes).astype(np.int32)), "found": pa.ListArray.from_arrays(of_row, found)})


def by_row(rows: DataFrame, key: str, fields: dict[str, Column], keep: tuple[str, ...] = (), places: bool = True) -> DataFrame:
    """key, what else is kept, dl and found: one row for each row, with its postings (term, field,
    tf, first: whether it is the row's first one of the term, and positions) as an array.

    ``fields`` are lists of tokens. A row's postings come from its own tokens, so they are grouped
    where the row is read, some rows at once, and no token is shuffled or kept by an aggregate."""
    names, heads = list(fields), 1 + len(keep)
    one = "term: string, field: string, tf: int, first: boolean" + (", positions: array<int>" if places else "")
    shape = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, *keep)), "dl int", f"found array<struct<{one}>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                n = sum(batch.column(heads + i).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(names)))
                starts = [*np.unique(np.cumsum(n) // SLICE, return_index=True)[1].tolist(), len(batch)]
                for start, end in zip(starts, starts[1:]):
                    yield _row_postings(batch.slice(start, end - start), heads, names, places)

    tokens = (c.alias(f"tokens{i}") for i, c in enumerate(fields.values()))
    return rows.select(key, *keep, *tokens).mapInArrow(run, shape)


def field_terms(fields: dict[str, str]) -> dict[str, Column]:
    """The terms of the column of each field, nulls as none."""
    return {name: t.terms(F.coalesce(F.col(column), F.lit(""))) for name, column in fields.items()}


def all_terms(*columns: str) -> dict[str, Column]:
    """The terms of several columns as one field without a name."""
    parts = list(field_terms({c: c for c in columns}).values())
    return {"": parts[0] if len(parts) == 1 else F.concat(*parts)}


def repeats(rows: DataFrame, key: str) -> bool:
    """Whether a key names more than one row."""
    return not rows.groupBy(key).count().filter("count > 1").isEmpty()


def postings_of(rows: DataFrame, key: str, keep: tuple[str, ...] = (), repeated: bool = True) -> DataFrame:
    """term, key, what else is kept, dl and tf of every posting of ``by_row`` with one field. Where
    keys may be repeated, postings of one key and dl are taken together."""
    found = rows.select(key, *keep, "dl", F.inline("found")).select("term", key, *keep, "dl", "tf")
    return merged(found, key, keep) if repeated else found


def placed_of(rows: DataFrame, key: str, keep: tuple[str, ...] = (), repeated: bool = True) -> DataFrame:
    """As ``postings_of`` for several fields, with field, tf, positions and first."""
    found = rows.select(key, *keep, "dl", F.inline("found"))
    if repeated:
        grouped = found.groupBy("term", key, *keep, "field", "dl").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"), F.bool_or("first").alias("first"))
        found = grouped.withColumn("tf", F.size("positions"))
    return found.select("term", key, *keep, "field", "dl", "tf", "positions", "first")


def postings(rows: DataFrame, key: str, *columns: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """term, key, what else is kept, dl and tf of every term of every row."""
    return postings_of(by_row(rows, key, all_terms(*columns), keep, places=False), key, keep)


def placed_postings(rows: DataFrame, key: str, fields: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """term, key, what else is kept, field, dl (tokens of all fields), tf and positions (from 0,
    ascending) of every term of every field; ``fields`` names the column of each."""
    return placed_of(by_row(rows, key, field_terms(fields), keep), key, keep).drop("first")


def merged(placed: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Postings of all fields taken together, as ``postings`` gives them; a condition on terms
    is applied before."""
    return placed.groupBy("term", key, *keep, "dl").agg(F.sum("tf").cast("int").alias("tf"))


def term_statistics(rows: DataFrame, *columns: str) -> DataFrame:
    """term, df (rows that have it) and cf (times it occurs). Rows are counted by the first of
    a term's places in each, so that only terms are shuffled, and these after partial sums."""
    of = lambda tokens, first: F.transform(tokens, lambda w: F.struct(w.alias("term"), F.lit(first).alias("first")))
    marked = tokenised(rows, *columns).select(F.inline(F.concat(of("tokens", 0), of(F.array_distinct("tokens"), 1))))
    return marked.groupBy("term").agg(F.sum("first").cast("long").alias("df"), F.count_if(F.col("first") == 0).alias("cf"))


# Ways to match, as conditions on the column tokens.


def has_all(*words: str) -> Column:
    return reduce(lambda a, b: a & b, (F.array_contains("tokens", w) for w in words))


def has_any(*words: str) -> Column:
    return F.arrays_overlap("tokens", F.array(*(F.lit(w) for w in words)))


def has_none(*words: str) -> Column:
    return ~has_any(*words)


def has_prefix(prefix: str) -> Column:
    return F.exists("tokens", lambda w: w.startswith(prefix))


def has_phrase(*words: str) -> Column:
    """The words stand next to each other in this order."""
    return F.exists(_places(words[0]), lambda at: reduce(lambda a, b: a & b, (F.get("tokens", at + i) == w for i, w in enumerate(words[1:], 1)), F.lit(True)))


def has_near(first: str, second: str, between: int = 10) -> Column:
    """Both words occur with at most so many tokens between them, in either order."""
    return F.exists(_places(first), lambda at: F.exists(_places(second), lambda to: (at != to) & (F.abs(at - to) <= between + 1)))


def _places(word: str) -> Column:
    """Where a word stands among the tokens, from 0."""
    every = F.transform("tokens", lambda w, i: F.when(w == word, i))
    return F.filter(every, lambda i: i.isNotNull())


def _checked(words: list[str], k: int | None) -> None:
    if k is not None and k < 1:
        raise RetrieveError("k must be at least 1", {"k": k})
    if not words:
        raise StoreError("a query needs a term")


def weight(n: Column) -> Column:
    """What a term that n rows have counts, beside the column N."""
    idf = F.log((F.col("N") - n + 0.5) / (n + 0.5))
    return F.when(idf > 0, idf).otherwise(LEAST_IDF)


def part(n: Column, tf: Column) -> Column:
    """What a term adds to a row's score, beside the columns N, avgdl and dl."""
    return weight(n) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def bm25(stored: tuple[DataFrame, DataFrame], key: str, words: list[str], k: int | None = 10, where: Column | None = None, every: bool = False, places: int = 6) -> DataFrame:
    """The k best rows of a table whose postings and lengths are ``stored``: key, and score
    rounded to ``places`` so that ties are ties everywhere. Found is a row with any of the
    words, or with ``every`` one; ``where`` may ask for columns that the postings keep."""
    _checked(words, k)
    words = list(dict.fromkeys(words))
    asked = stored[0].filter(F.col("term").isin(*words))
    df = asked.groupBy("term").agg(F.count("*").alias("n_rows"))
    totals = stored[1].agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"))
    hits = asked if where is None else asked.filter(where)
    weighed = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(totals))  # a row for each word, one row
    found = weighed.groupBy(key).agg(F.round(F.sum(part(F.col("n_rows"), F.col("tf"))), places).alias("score"), F.count("*").alias("n_words"))
    ranked = (found.filter(F.col("n_words") == len(words)) if every else found).select(key, "score").orderBy(F.desc("score"), key)
    return ranked if k is None else ranked.limit(k)


#: Parts that a common term's postings are dealt to, what scores may be off by, and terms of
#: questions that are sent to where the postings are.
SALTS, SLACK, MOST_SENT = 8, 2e-6, 100_000


def bm25_many(stored: tuple[DataFrame, DataFrame], key: str, asked: DataFrame, k: int = 10, where: Column | None = None, places: int = 6) -> DataFrame:
    """query_id, key, score and rank: for each row (query_id, words) of ``asked`` the k best
    rows with any of its words, as ``bm25`` finds them one query after the other.

    All questions are one table of terms that meets the postings where they are; too large a
    table, dealt by term and a part of the keys, so no term's postings are one task's. Common
    terms are not asked of all rows: a question's rare terms give its k-th score at least; terms
    whose most parts add up to less cannot make a row enter. What the others add up to gives a
    higher k-th score, and only rows that can still reach it are looked up for the terms left.
    """
    if k < 1:
        raise RetrieveError("k must be at least 1", {"k": k})
    totals = F.broadcast(stored[1].agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl")))  # one row
    terms = asked.select("query_id", F.explode(F.array_distinct("words")).alias("term"))
    few = terms.limit(MOST_SENT + 1).count() <= MOST_SENT
    sent = F.broadcast if few else lambda rows: rows
    held = stored[0].join(sent(terms.select("term").distinct()), "term", "left_semi").crossJoin(totals)
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    counted = held.groupBy("term", "N").agg(F.count("*").alias("n_rows"), F.max(gain).alias("most"))
    counted = counted.select("term", "n_rows", weight(F.col("n_rows")).alias("weight"), (weight(F.col("n_rows")) * F.col("most")).alias("bound"), (F.col("n_rows") <= F.col("N") / 100).alias("rare"))
    weighed = terms.join(counted, "term")
    hits = (held if where is None else held.filter(where)).select("term", key, gain.alias("gain"))

    def added(some: DataFrame) -> DataFrame:
        """query_id, key and what these terms of a question add to it."""
        if few:
            found = hits.join(F.broadcast(some), "term")
        else:
            salted = some.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            found = hits.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"])
        found = found.select("query_id", key, (F.col("weight") * F.col("gain")).alias("part"))
        return found.repartition("query_id", key).groupBy("query_id", key).agg(F.sum("part").alias("part"))  # no partial sums: files hold ranges of terms

    by_query = Window.partitionBy("query_id")
    placed = weighed.withColumn("place", F.row_number().over(by_query.orderBy("n_rows", "term")))
    first = added(placed.filter("rare or place = 1").select("query_id", "term", "weight"))

    def least_of(found: DataFrame) -> DataFrame:
        """query_id and its k-th part; 0 where fewer rows have one."""
        best = found.select("query_id", "part").withColumn("place", F.row_number().over(by_query.orderBy(F.desc("part")))).filter(F.col("place") <= k)
        return best.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("part")).otherwise(0.0).alias("least"))

    known = weighed.join(least_of(first), "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    summed = F.sum("bound").over(by_query.orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0))
    known = known.withColumn("helps", summed >= F.col("least") - SLACK)
    idle = known.filter("not helps").select("query_id", "term", "weight")
    rest = known.groupBy("query_id").agg(F.sum(F.when(F.col("helps"), 0.0).otherwise(F.col("bound"))).alias("rest"))
    found = added(known.filter("helps").select("query_id", "term", "weight"))
    limits = least_of(found).join(rest, "query_id")
    found = found.join(sent(limits), "query_id").filter(F.col("part") + F.col("rest") >= F.col("least") - SLACK).select("query_id", key, "part")
    wanted = found.drop("part").join(sent(idle), "query_id")
    common = hits.join(sent(idle.select("term").distinct()), "term", "left_semi")
    more = wanted.join(common, ["term", key]).select("query_id", key, (F.col("weight") * F.col("gain")).alias("part"))
    scored = found.unionByName(more).groupBy("query_id", key).agg(F.round(F.sum("part"), places).alias("score"))
    return scored.withColumn("rank", F.row_number().over(by_query.orderBy(F.desc("score"), key))).filter(F.col("rank") <= k)


def bm25_scan(rows: DataFrame, key: str, columns: tuple[str, ...], words: list[str], k: int | None = 10, where: Column | None = None, match: Column | None = None, places: int = 6) -> DataFrame:
    """As ``bm25``, for a table without an index. ``match`` (default: any of the words) is a
    condition on the column tokens that says which rows count as found."""
    _checked(words, k)
    tokens = tokenised(rows, *columns)
    times = lambda word: F.size(F.filter("tokens", lambda w: w == word))
    counts = [times(word).alias(f"tf{i}") for i, word in enumerate(words)]
    kept = [c for c in rows.columns if c != "tokens"]
    counted = tokens.select(*kept, F.size("tokens").alias("dl"), *counts, *([] if match is None else [match.alias("matches")]))
    totals = counted.agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"n{i}") for i in range(len(words))))
    scored = counted.crossJoin(F.broadcast(totals))  # one row
    one = lambda i: F.when(F.col(f"tf{i}") > 0, part(F.col(f"n{i}"), F.col(f"tf{i}"))).otherwise(0.0)
    score = F.round(reduce(lambda a, b: a + b, map(one, range(len(words)))), places).alias("score")
    found = scored.filter(reduce(lambda a, b: a | b, (F.col(f"tf{i}") > 0 for i in range(len(words)))) if match is None else F.col("matches"))
    if where is not None:
        found = found.filter(where)
    ranked = found.select(key, score).orderBy(F.desc("score"), key)
    return ranked if k is None else ranked.limit(k)
