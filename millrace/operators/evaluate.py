"""Measures of answers: ranking, grounding, rubrics, cost, and their aggregates.

All work on one row for each case, so a run of any size is one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.errors import EvalError

REASONS = ("file not indexed", "no chunk holds the line range", "snippet not found in the cited lines")


def _first_k(retrieved: str, k: int) -> Column:
    if k < 1:
        raise EvalError("k must be at least 1", {"k": k})
    return F.slice(F.array_distinct(retrieved), 1, k)


def recall_at_k(retrieved: str, expected: str, k: int) -> Column:
    """Share of the expected items among the first k different ones; 1 if none is expected."""
    want = F.array_distinct(expected)
    hits = F.size(F.array_intersect(_first_k(retrieved, k), want))
    return F.when(F.size(want) == 0, 1.0).otherwise(hits / F.size(want))


def mrr(retrieved: str, expected: str) -> Column:
    """1 over the place of the first expected item among all different ones; 0 without one."""
    own = F.array_distinct(retrieved)
    places = F.filter(F.transform(own, lambda x, i: F.when(F.array_contains(expected, x), i + 1)), lambda p: p.isNotNull())
    return F.when(F.size(places) > 0, 1.0 / F.get(places, 0)).otherwise(0.0)


def ndcg_at_k(retrieved: str, expected: str, k: int) -> Column:
    """Gain of expected items at 1 / log2(place + 1), over that of a perfect list; 0 if none is expected."""
    own, want = _first_k(retrieved, k), F.size(F.array_distinct(expected))
    add = lambda s, x: s + x
    gained = F.aggregate(F.transform(own, lambda x, i: F.when(F.array_contains(expected, x), 1.0 / F.log2(i + 2.0)).otherwise(0.0)), F.lit(0.0), add)
    best = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(want, F.lit(k)))), lambda i: 1.0 / F.log2(i + 1.0)), F.lit(0.0), add)
    return F.when(want == 0, 0.0).otherwise(gained / best)


def of_hits(hits: str, relevant: str, k: int) -> Column:
    """recall, mrr and ndcg of the different items of a ranking, given for each of the first k
    whether it is relevant, and how many relevant items there are; no list of these is needed."""
    own, n = F.slice(hits, 1, k), F.col(relevant)
    add = lambda s, x: s + x
    found = F.aggregate(F.transform(own, lambda h: h.cast("int").cast("double")), F.lit(0.0), add)
    place = F.array_position(own, True)
    gained = F.aggregate(F.transform(own, lambda h, i: F.when(h, 1.0 / F.log2(i + 2.0)).otherwise(0.0)), F.lit(0.0), add)
    best = F.aggregate(F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.least(n, F.lit(k)))), lambda i: 1.0 / F.log2(i + 1.0)), F.lit(0.0), add)
    return F.struct(
        F.when(n == 0, 1.0).otherwise(found / n).alias("recall"),
        F.when(place > 0, 1.0 / place).otherwise(0.0).alias("mrr"),
        F.when(n == 0, 0.0).otherwise(gained / best).alias("ndcg"),
    )


def grounded(cited: DataFrame, chunks: DataFrame, *case: str) -> DataFrame:
    """Checks citations (repo_id, path, start_line, end_line, snippet and the columns ``case``).

    A citation holds if its file is indexed, some chunk of it holds its lines, and one of
    those holds its snippet (an empty one is always held). Adds three booleans, and the
    reasons why it does not hold, in this order.
    """
    own = ["repo_id", "path", "start_line", "end_line", "snippet", *case]
    held = chunks.select("repo_id", "path", F.col("start_line").alias("c_start"), F.col("end_line").alias("c_end"), "content")
    pairs = cited.join(held, ["repo_id", "path"], "left")
    inside = (F.col("c_start") <= F.col("start_line")) & (F.col("end_line") <= F.col("c_end"))
    says = (F.col("snippet") == "") | F.col("content").contains(F.col("snippet"))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    out = pairs.groupBy(*own).agg(some(F.col("c_start").isNotNull()).alias("file_exists"), some(inside).alias("range_valid"), some(inside & says).alias("snippet_matches"))
    whys = F.array(*(F.when(~F.col(c), F.lit(r)) for c, r in zip(("file_exists", "range_valid", "snippet_matches"), REASONS)))
    return out.withColumn("grounded", F.col("snippet_matches")).withColumn("reasons", F.array_compact(whys))


def grounding_rate(grounded_count: Column, total: Column) -> Column:
    """1 where there is nothing to ground."""
    return F.when(total == 0, 1.0).otherwise(grounded_count / total)


#: What a judge's malformed text comes out as (fixed value).
MALFORMED = "judge returned malformed output"


def _true(value: Column) -> Column:
    """The words for yes, numbers other than zero (quoted or not), and lists and objects that hold something."""
    said = F.lower(F.trim(value))
    number = said.rlike(r"^-?[0-9.]*[1-9][0-9.]*(e[+-]?[0-9]+)?$")
    return F.coalesce(said.isin("true", "yes") | number | said.rlike(r"^[\[{]\s*[^\s\]}]"), F.lit(False))


def percentile(column: str, p: float) -> Column:
    """Linear between ranks; 0 without rows."""
    return F.coalesce(F.percentile(column, p), F.lit(0.0))


def rubric(content: str, traits: str) -> Column:
    """A judge's JSON (or the outermost braces of its text) as score, per_trait and rationale.

    The score is the number of different traits that hold by the number of listed ones. A
    trait that it leaves out is false, others that it names are dropped. Malformed text scores 0. Without traits the score is 1, whatever the text is.
    """
    shape = "struct<per_trait: map<string,string>, rationale: string>"
    whole = F.from_json(F.col(content), shape)
    cut = F.from_json(F.regexp_extract(content, r"(?s)\{.*\}", 0), shape)
    parsed = F.when(whole["per_trait"].isNotNull(), whole).otherwise(cut)
    values = F.transform(F.array_distinct(traits), lambda name: _true(F.try_element_at(parsed["per_trait"], name)))
    score = F.aggregate(values, F.lit(0.0), lambda s, v: s + v.cast("double")) / F.size(traits)
    broken = parsed["per_trait"].isNull()
    none = F.from_json(F.lit("{}"), "map<string,boolean>")
    return F.struct(
        F.when(F.size(traits) == 0, 1.0).when(broken, 0.0).otherwise(score).alias("score"),
        F.when((F.size(traits) == 0) | broken, none).otherwise(F.map_from_arrays(F.array_distinct(traits), F.transform(F.array_distinct(traits), lambda name: _true(F.try_element_at(parsed["per_trait"], name))))).alias("per_trait"),
        F.when(F.size(traits) == 0, "").when(broken, MALFORMED).otherwise(F.coalesce(parsed["rationale"], F.lit(""))).alias("rationale"),
    )


def costs(used: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds cost_usd to rows of provider, model, prompt and completion: the model's rate,
    else its provider's ``default``, else 0."""
    own = rates.select("provider", "model", F.col("prompt_per_1k").alias("p"), F.col("completion_per_1k").alias("c"))
    other = rates.filter("model = 'default'").select("provider", F.col("prompt_per_1k").alias("dp"), F.col("completion_per_1k").alias("dc"))
    joined = used.join(own, ["provider", "model"], "left").join(other, "provider", "left")
    rate = lambda a, b: F.coalesce(a, b, F.lit(0.0))
    cost = F.col("prompt") / 1000 * rate("p", "dp") + F.col("completion") / 1000 * rate("c", "dc")
    return joined.withColumn("cost_usd", cost).drop("p", "c", "dp", "dc")


def aggregates(cases: DataFrame, k: int) -> DataFrame:
    """One row of means, percentiles (linear between ranks) and sums; all 0 without cases."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return cases.agg(
        F.count("*").alias("n_cases"), F.lit(k).alias("k"), mean("recall_at_k").alias("mean_recall_at_k"), mean("mrr").alias("mean_mrr"), mean("ndcg_at_k").alias("mean_ndcg_at_k"),
        mean("grounding_rate").alias("mean_grounding_rate"), mean("correctness").alias("mean_correctness"), percentile("latency_ms", 0.5).alias("latency_p50_ms"), percentile("latency_ms", 0.95).alias("latency_p95_ms"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost_usd"), mean("cost_usd").alias("mean_cost_usd"),
    )


def evaluate(answers: DataFrame, cases: DataFrame, chunks: DataFrame, rates: DataFrame, provider: str, model: str, k: int) -> DataFrame:
    """A row of measures for each case, from its answer (ANSWERS, with the judge's text in
    judged), its expectations (CASES) and the indexed chunks."""
    joined = cases.join(answers, "case_id").withColumn("retrieved", F.col("citations.path"))
    cited = joined.select("case_id", "repo_id", F.explode("citations").alias("c")).select("case_id", "repo_id", "c.path", "c.start_line", "c.end_line", "c.snippet").distinct()
    ground = grounded(cited, chunks, "case_id").groupBy("case_id").agg(F.count("*").alias("total"), F.count_if("grounded").alias("grounded"))
    measured = joined.join(ground, "case_id", "left").select(
        "case_id", recall_at_k("retrieved", "expected_files", k).alias("recall_at_k"), mrr("retrieved", "expected_files").alias("mrr"), ndcg_at_k("retrieved", "expected_files", k).alias("ndcg_at_k"),
        F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("grounded", F.lit(0)).alias("grounded"), rubric("judged", "expected_answer_traits")["score"].alias("correctness"), "latency_ms",
        F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.col("token_usage.prompt").alias("prompt"), F.col("token_usage.completion").alias("completion"),
    )
    return costs(measured.withColumn("grounding_rate", grounding_rate(F.col("grounded"), F.col("total"))), rates)


def report(cases: DataFrame, summary: DataFrame, run_id: str, out_dir: str) -> tuple[str, str]:
    """Writes a run as JSON and as Markdown tables; returns the two paths."""
    import json
    from pathlib import Path

    total = summary.first().asDict()
    rows = [r.asDict(recursive=True) for r in cases.orderBy("case_id").collect()]
    folder = Path(out_dir)
    folder.mkdir(parents=True, exist_ok=True)
    as_json, as_text = folder / f"{run_id}.json", folder / f"{run_id}.md"
    as_json.write_text(json.dumps({"run_id": run_id, "k": total["k"], "aggregates": total, "cases": rows}, indent=2))
    shown = lambda name, v: str(v) if isinstance(v, int) else f"{v:.6f}" if "cost" in name else f"{v:.4f}"
    table = lambda head, body: ["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *("| " + " | ".join(r) + " |" for r in body)]
    columns = ["case_id", "recall_at_k", "mrr", "ndcg_at_k", "grounding_rate", "correctness", "latency_ms", "cost_usd"]
    body = [f"# Evaluation {run_id}", "", "## Aggregates", "", *table(["metric", "value"], [[n, shown(n, v)] for n, v in total.items()]), "", "## Cases", ""]
    body += table(columns, [[r["case_id"], *(shown(c, r[c]) for c in columns[1:])] for r in rows])
    as_text.write_text("\n".join(body) + "\n")
    return str(as_json), str(as_text)
