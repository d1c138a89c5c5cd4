"""Metrics of retrieval, classification and tool use."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least score of each gate.
GATES = {"tool_selection": 0.50, "nli_macro_f1": 0.40, "terminology": 0.60}


def pair_f1(expected: Column, actual: Column) -> Column:
    """F1 of two arrays of key=value texts; both empty is 1, one empty or nothing shared is 0."""
    shared = F.size(F.array_intersect(expected, actual))
    f1 = 2.0 * shared / (F.size(F.array_distinct(expected)) + F.size(F.array_distinct(actual)))
    return F.when((F.size(expected) == 0) & (F.size(actual) == 0), 1.0).when(shared == 0, 0.0).otherwise(f1)


def pass_at_k(trials: Column) -> Column:
    return F.exists(trials, lambda t: t)


def pass_all_k(trials: Column) -> Column:
    """True also without trials."""
    return F.forall(trials, lambda t: t)


def chain_complete(expected: Column, actual: Column) -> Column:
    return F.size(F.array_except(expected, actual)) == 0


def classification(pairs: DataFrame, classes: list[str]) -> DataFrame:
    """Per class tp, precision, recall and F1 (0 on empty denominators); pairs: truth, pred."""
    names = pairs.sparkSession.createDataFrame([(c,) for c in classes], "label string")
    truth = pairs.groupBy("truth", "pred").agg(F.count("*").alias("n"))  # a few rows
    spread = truth.crossJoin(F.broadcast(names))
    t, p = F.col("truth") == F.col("label"), F.col("pred") == F.col("label")
    sums = spread.groupBy("label").agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(x) for c, x in ((t & p, "tp"), (p, "predicted"), (t, "actual"))])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = sums.withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("actual")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro(pairs: DataFrame, classes: list[str]) -> DataFrame:
    """accuracy and macro_f1; predictions outside the classes are errors only."""
    accuracy = pairs.agg(F.coalesce(F.avg((F.col("truth") == F.col("pred")).cast("double")), F.lit(0.0)).alias("accuracy"))
    return accuracy.crossJoin(classification(pairs, classes).agg(F.avg("f1").alias("macro_f1")))


def ranked_metrics(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Precision, recall, F1 at k, reciprocal rank and hit at 1 by query.

    results: query_id, doc_id, position from 1; relevant: query_id, doc_id.
    """
    good = relevant.distinct().withColumn("good", F.lit(1))
    found = results.join(good, ["query_id", "doc_id"], "left")
    total = relevant.groupBy("query_id").agg(F.count_distinct("doc_id").alias("relevant"))
    per = found.groupBy("query_id").agg(
        F.sum(F.when(F.col("position") <= k, F.coalesce("good", F.lit(0))).otherwise(0)).alias("hits"),
        F.count_if(F.col("position") <= k).alias("shown"),
        F.min(F.when(F.col("good") == 1, F.col("position"))).alias("first"),
    )
    rows = total.join(per, "query_id", "left")
    hits = F.coalesce("hits", F.lit(0))
    p, r = F.coalesce(F.try_divide(hits, F.col("shown")), F.lit(0.0)), F.coalesce(F.try_divide(hits, F.col("relevant")), F.lit(0.0))
    rows = rows.withColumn("p", p).withColumn("r", r)
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    return rows.select(
        "query_id", F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(f1, 4).alias("f1"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 4).alias("reciprocal_rank"), F.coalesce((F.col("first") == 1).cast("int"), F.lit(0)).alias("hit_at_1"),
    )


def gate(scores: dict[str, Column]) -> Column:
    """All three scores are there and reach their limit."""
    ok = F.lit(True)
    for name, least in GATES.items():
        ok = ok & F.coalesce(scores[name] >= least, F.lit(False))
    return ok


def failed_gates(scores: dict[str, Column], grounding: Column) -> Column:
    """Names of the metrics below their limits, in order."""
    tests = [(name, scores[name] < least) for name, least in GATES.items()] + [("grounding", grounding < 0.6)]
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests]))


def tool_metrics(calls: DataFrame) -> DataFrame:
    """Requests, errors and average latency by tool; calls: tool, error, latency."""
    return calls.groupBy("tool").agg(
        F.count("*").alias("requests"), F.count_if("error").alias("errors"), F.round(F.coalesce(F.try_divide(F.sum("latency"), F.count("*")), F.lit(0.0)), 1).alias("avg_latency")
    )


def metrics_summary(calls: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: requests, errors, cache hits and misses, and the hit rate in percent (0 without lookups); cache: hit."""
    totals = calls.agg(F.count("*").alias("total_requests"), F.count_if("error").alias("total_errors"))
    lookups = cache.agg(F.count_if("hit").alias("cache_hits"), F.count_if(~F.col("hit")).alias("cache_misses"))
    rate = F.try_divide(F.col("cache_hits") * 100, F.col("cache_hits") + F.col("cache_misses"))
    return totals.crossJoin(lookups).withColumn("cache_hit_rate", F.round(F.coalesce(rate, F.lit(0.0)), 1))


def chat_slot(chat: Callable[[str], str | None]) -> Callable:
    """A chat model as an Arrow UDF: prompt in, answer or null out; errors give null."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        def one(prompt):
            try:
                return chat(prompt) if prompt is not None else None
            except (OSError, ValueError, RuntimeError):
                return None

        return prompts.map(one)

    return run


def variant_scores(cases: DataFrame, variants: DataFrame, chat, parse=None) -> DataFrame:
    """By prompt variant: cases, answers that came, and the share of right ones.

    cases: text, expected; variants: variant, template, of which {} is the text; chat: a column function of the prompt.
    """
    parse = parse or parse_label
    prompt = F.replace(F.col("template"), F.lit("{}"), F.col("text"))
    asked = cases.crossJoin(F.broadcast(variants)).withColumn("answer", chat(prompt))  # variants are a handful of prompts
    right = F.coalesce(parse(F.col("answer")) == F.col("expected"), F.lit(False))
    return asked.groupBy("variant").agg(F.count("*").alias("cases"), F.count("answer").alias("answers"), F.round(F.avg(right.cast("double")), 4).alias("accuracy"))


def parse_label(answer: Column, labels: tuple[str, ...] = ("entailment", "contradiction", "neutral")) -> Column:
    """First label that the answer holds, else unknown."""
    low, out = F.lower(F.trim(answer)), None
    for x in labels:
        out = F.when(F.contains(low, F.lit(x)), x) if out is None else out.when(F.contains(low, F.lit(x)), x)
    return out.otherwise("unknown")


def parse_letter(answer: Column) -> Column:
    return F.regexp_extract(F.upper(answer), "[ABC]", 0)


def shuffled_options(options: Column, seed: int) -> Column:
    """Options in an order fixed by the seed."""
    keyed = F.transform(options, lambda o: F.struct(F.sha2(F.concat(F.lit(str(seed)), o), 256).alias("k"), o.alias("o")))
    return F.transform(F.array_sort(keyed), lambda x: x["o"])


def tool_call(message: Column) -> Column:
    """Struct of name and arguments (JSON text) of the first tool call; unreadable arguments are {}."""
    call = "$.tool_calls[0].function"
    raw = F.get_json_object(message, f"{call}.arguments")
    fine = F.try_parse_json(raw).isNotNull()
    return F.struct(F.get_json_object(message, f"{call}.name").alias("name"), F.when(fine, raw).otherwise("{}").alias("arguments"))


def case_scores(trials: DataFrame) -> DataFrame:
    """trials: case_id, category, selected, params_f1 -> one row a case."""
    return trials.groupBy("case_id", "category").agg(
        F.max(F.col("selected").cast("int")).alias("pass_at_k"), F.min(F.col("selected").cast("int")).alias("pass_all_k"), F.round(F.avg("params_f1"), 4).alias("params_f1")
    )


def end_to_end(rows: DataFrame) -> DataFrame:
    """Means over rows without error, chain rate over multi-tool rows, latency over all."""
    fine = ~F.col("error")
    return rows.agg(
        F.round(F.coalesce(F.avg(F.when(fine, F.col("grounding"))), F.lit(0.0)), 4).alias("grounding"),
        F.round(F.coalesce(F.avg(F.when(fine & F.col("multi_tool"), F.col("chain").cast("double"))), F.lit(0.0)), 4).alias("chain_rate"),
        F.round(F.coalesce(F.avg("latency"), F.lit(0.0)), 4).alias("latency"),
    )


def first_of(rows: DataFrame, key: str, order: list) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("rn = 1").drop("rn")
