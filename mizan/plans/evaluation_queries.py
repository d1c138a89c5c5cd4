"""Evaluation queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mizan.functions import markup
from mizan.operators import evaluation
from mizan.plans.registry import query
from mizan.sources.tables import read

_PAIRS = "p AS (SELECT CAST(quality AS VARCHAR) AS truth, CASE WHEN doc_id % 9 = 0 THEN 'odd' WHEN doc_id % 4 = 0 THEN CAST(toxic AS VARCHAR) ELSE CAST(quality AS VARCHAR) END AS pred FROM labels)"
_CLASSES = (
    "c(label) AS (VALUES ('0'), ('1'), ('absent')), k AS (SELECT label, count(*) FILTER (WHERE truth = label AND pred = label) AS tp, count(*) FILTER (WHERE pred = label) AS predicted, count(*) FILTER (WHERE truth = label) AS actual FROM p, c GROUP BY 1), "
    "r AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0.0) AS precision, coalesce(tp / nullif(actual, 0), 0.0) AS recall FROM k), "
    "m AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM r)"
)


def _pairs(spark, sf_dir):
    x = read(spark, sf_dir, "labels")
    pred = F.when(F.col("doc_id") % 9 == 0, "odd").when(F.col("doc_id") % 4 == 0, F.col("toxic").cast("string")).otherwise(F.col("quality").cast("string"))
    return x.select(F.col("quality").cast("string").alias("truth"), pred.alias("pred"))


@query(f"WITH {_PAIRS}, {_CLASSES} SELECT label, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m")
def nli_metrics(spark, sf_dir):
    m = evaluation.classification(_pairs(spark, sf_dir), ["0", "1", "absent"])
    return m.select("label", "tp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {_PAIRS}, {_CLASSES} SELECT (SELECT round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 6) FROM p) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM m")
def nli_macro(spark, sf_dir):
    return evaluation.macro(_pairs(spark, sf_dir), ["0", "1", "absent"]).select(F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


_RANKED = (
    "r AS (SELECT user_id % 40 AS query_id, user_id AS doc_id, row_number() OVER (PARTITION BY user_id % 40 ORDER BY sum(value) DESC, user_id) AS position FROM events GROUP BY user_id), "
    "g AS (SELECT DISTINCT user_id % 40 AS query_id, user_id AS doc_id FROM events WHERE event_type = 'purchase' AND value > 50)"
)


def _ranked(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    r = e.groupBy("user_id").agg(F.sum("value").alias("v")).select((F.col("user_id") % 40).alias("query_id"), F.col("user_id").alias("doc_id"), "v")
    r = r.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("v"), "doc_id"))).drop("v")
    return r, e.where("event_type = 'purchase' AND value > 50").select((F.col("user_id") % 40).alias("query_id"), F.col("user_id").alias("doc_id")).distinct()


@query(
    f"WITH {_RANKED}, t AS (SELECT query_id, count(DISTINCT doc_id) AS n FROM g GROUP BY 1), f AS (SELECT r.query_id, count(g.doc_id) FILTER (WHERE position <= 3) AS hits, count(*) FILTER (WHERE position <= 3) AS shown, min(position) FILTER (WHERE g.doc_id IS NOT NULL) AS first FROM r LEFT JOIN g USING (query_id, doc_id) GROUP BY 1), "
    "x AS (SELECT t.query_id, coalesce(hits / nullif(shown, 0), 0.0) AS p, coalesce(hits / nullif(n, 0), 0.0) AS q, first FROM t LEFT JOIN f USING (query_id)) "
    "SELECT query_id, round(p, 4) AS precision, round(q, 4) AS recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0.0), 4) AS f1, round(coalesce(1.0 / first, 0.0), 4) AS reciprocal_rank, CAST(coalesce(first = 1, false) AS INT) AS hit_at_1 FROM x"
)
def retrieval_metrics(spark, sf_dir):
    return evaluation.ranked_metrics(*_ranked(spark, sf_dir), 3)


@query(
    f"WITH {_RANKED}, f AS (SELECT g.query_id, min(position) AS first FROM g JOIN r USING (query_id, doc_id) GROUP BY 1) SELECT round(avg(round(1.0 / first, 4)), 4) AS mrr, round(avg(CASE WHEN first = 1 THEN 1.0 ELSE 0.0 END), 4) AS hit_at_1 FROM f"
)
def retrieval_means(spark, sf_dir):
    m = evaluation.ranked_metrics(*_ranked(spark, sf_dir), 3)
    return m.agg(F.round(F.avg("reciprocal_rank"), 4).alias("mrr"), F.round(F.avg("hit_at_1"), 4).alias("hit_at_1"))


_MAPS = "x AS (SELECT event_id, list_distinct(list_value('k=' || (event_id % 5), 'v=' || (event_id % 3))) AS e, list_distinct(list_value('k=' || (event_id % 4), 'v=' || (event_id % 3), 'z=1')) AS a0 FROM events), y AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN [] ELSE e END AS e, CASE WHEN event_id % 7 = 0 THEN [] ELSE a0 END AS a FROM x)"


@query(f"WITH {_MAPS} SELECT event_id, round(CASE WHEN len(e) = 0 AND len(a) = 0 THEN 1.0 WHEN len(list_intersect(e, a)) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(e, a)) / (len(e) + len(a)) END, 6) AS f1 FROM y")
def param_f1(spark, sf_dir):
    i, empty = F.col("event_id"), F.array().cast("array<string>")
    pair = lambda k, n: F.concat(F.lit(f"{k}="), (i % n).cast("string"))
    expected = F.when(i % 11 == 0, empty).otherwise(F.array(pair("k", 5), pair("v", 3)))
    actual = F.when(i % 7 == 0, empty).otherwise(F.array(pair("k", 4), pair("v", 3), F.lit("z=1")))
    return read(spark, sf_dir, "events").select("event_id", F.round(evaluation.pair_f1(expected, actual), 6).alias("f1"))


_TRIALS = "t AS (SELECT user_id AS case_id, list(value > 60 ORDER BY event_id) FILTER (WHERE event_type = 'click') AS x FROM events GROUP BY 1)"


@query(f"WITH {_TRIALS} SELECT case_id, coalesce(list_contains(x, true), false) AS any_pass, NOT coalesce(list_contains(x, false), false) AS all_pass FROM t")
def pass_at_k(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    t = e.groupBy(F.col("user_id").alias("case_id")).agg(F.collect_list(F.when(F.col("event_type") == "click", F.col("value") > 60)).alias("x"))
    return t.select("case_id", evaluation.pass_at_k(F.col("x")).alias("any_pass"), evaluation.pass_all_k(F.col("x")).alias("all_pass"))


@query("SELECT user_id AS case_id, event_type AS category, max(CAST(value > 50 AS INT)) AS pass_at_k, min(CAST(value > 50 AS INT)) AS pass_all_k, round(avg((event_id % 3) / 2.0), 4) AS params_f1 FROM events GROUP BY 1, 2")
def case_evaluation(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return evaluation.case_scores(e.select(F.col("user_id").alias("case_id"), F.col("event_type").alias("category"), (F.col("value") > 50).alias("selected"), (F.col("event_id") % 3 / 2.0).alias("params_f1")))


@query(
    "WITH x AS (SELECT value / 100 AS g, event_type = 'error' AS error, user_id % 2 = 0 AS multi, event_id % 3 <> 0 AS chain, CAST(event_id % 17 AS DOUBLE) AS latency FROM events) "
    "SELECT round(avg(g) FILTER (WHERE NOT error), 4) AS grounding, round(avg(CAST(chain AS DOUBLE)) FILTER (WHERE NOT error AND multi), 4) AS chain_rate, round(avg(latency), 4) AS latency FROM x"
)
def end_to_end_metrics(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return evaluation.end_to_end(
        e.select((F.col("value") / 100).alias("grounding"), (F.col("event_type") == "error").alias("error"), (F.col("user_id") % 2 == 0).alias("multi_tool"), (F.col("event_id") % 3 != 0).alias("chain"), (F.col("event_id") % 17).cast("double").alias("latency"))
    )


_SCORES = "m AS (SELECT CAST(user_id AS VARCHAR) AS model, avg(value) / 100 AS t, min(value) / 10 AS n, max(value) / 120 AS m, avg(value) / 80 AS g FROM events GROUP BY 1 UNION ALL SELECT * FROM (VALUES ('a', 0.5::DOUBLE, 0.4::DOUBLE, 0.6::DOUBLE, 0.9::DOUBLE), ('b', 0.9, 0.39, 0.6, 0.5), ('c', 0.1, 0.9, NULL, 0.6)) t(model, t, n, m, g))"


@query(
    f"WITH {_SCORES} SELECT model, coalesce(t >= 0.5 AND n >= 0.4 AND m >= 0.6, false) AS passed, list_filter([CASE WHEN t < 0.5 THEN 'tool_selection' END, CASE WHEN n < 0.4 THEN 'nli_macro_f1' END, CASE WHEN m < 0.6 THEN 'terminology' END, CASE WHEN g < 0.6 THEN 'grounding' END], lambda x: x IS NOT NULL) AS failures FROM m"
)
def threshold_gate(spark, sf_dir):
    d = spark.createDataFrame([("a", 0.5, 0.4, 0.6, 0.9), ("b", 0.9, 0.39, 0.6, 0.5), ("c", 0.1, 0.9, None, 0.6)], "model string, t double, n double, m double, g double")
    v = F.col("value")
    d = d.union(read(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("model")).agg((F.avg(v) / 100).alias("t"), (F.min(v) / 10).alias("n"), (F.max(v) / 120).alias("m"), (F.avg(v) / 80).alias("g")))
    scores = {"tool_selection": F.col("t"), "nli_macro_f1": F.col("n"), "terminology": F.col("m")}
    return d.select("model", evaluation.gate(scores).alias("passed"), evaluation.failed_gates(scores, F.col("g")).alias("failures"))


_FACTS = [("Oran %12,5 ve 1.234.567,89 TL, tarih 31.12.2024", "1.234.567,89 ve 31.12.2024"), ("rakam yok", "cevap"), ("rakam yok", "  "), ("12 ve 12", "12"), ("45 gün", "")]


@query(
    "WITH r AS (SELECT doc_id AS id, text AS source, substring(text, 1, 2000) AS answer FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-1 - i}, '{s}', '{a}')" for i, (s, a) in enumerate(_FACTS)) + ") t(id, source, answer)), "
    "n AS (SELECT *, regexp_extract_all(source, '(\\d+[.,\\d]*\\d+)', 1) AS numbers, regexp_extract_all(source, '(\\d{2}\\.\\d{2}\\.\\d{4})', 1) AS dates, list_transform(regexp_extract_all(source, '(%\\s*[\\d.,]+|[\\d.,]+\\s*%)', 1), lambda p: regexp_extract(p, '[\\d.,]+', 0)) AS shares FROM r), "
    "u AS (SELECT *, list_filter(list_concat(dates, shares), lambda f: f <> '' AND NOT list_contains(numbers, f)) AS more FROM n), "
    "f AS (SELECT id, answer, list_concat(numbers, list_filter(more, lambda x, i: list_position(more, x) = i)) AS facts FROM u) "
    "SELECT id, facts, CASE WHEN answer = '' THEN 0.0 WHEN len(facts) = 0 THEN CASE WHEN trim(answer) = '' THEN 0.0 ELSE 1.0 END ELSE round(len(list_filter(facts, lambda x: contains(answer, x))) / len(facts), 6) END::DOUBLE AS score FROM f"
)
def grounding_score(spark, sf_dir):
    d = spark.createDataFrame([(-1 - i, *x) for i, x in enumerate(_FACTS)], "id long, source string, answer string")
    d = d.union(read(spark, sf_dir, "documents").select("doc_id", "text", F.substring("text", 1, 2000)))
    return d.select("id", markup.facts(F.col("source")).alias("facts"), F.round(markup.grounding(F.col("source"), F.col("answer")), 6).alias("score"))


@query("SELECT conv_id, count(DISTINCT role) FILTER (WHERE role IN ('user', 'assistant')) = 2 AS complete FROM conversations GROUP BY 1")
def chain_complete(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return c.select("conv_id", evaluation.chain_complete(F.array(F.lit("user"), F.lit("assistant")), F.col("roles")).alias("complete"))


@query("SELECT event_type AS tool, count(*) AS requests, count(*) FILTER (WHERE value < 10) AS errors, round(sum(value) / count(*), 1) AS avg_latency FROM events GROUP BY 1")
def tool_metrics(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return evaluation.tool_metrics(e.select(F.col("event_type").alias("tool"), (F.col("value") < 10).alias("error"), F.col("value").alias("latency")))


@query("WITH c AS (SELECT value < 10 AS error, user_id % 3 = 0 AS hit FROM events) SELECT count(*) AS total_requests, count(*) FILTER (WHERE error) AS total_errors, count(*) FILTER (WHERE hit) AS cache_hits, count(*) FILTER (WHERE NOT hit) AS cache_misses, round(count(*) FILTER (WHERE hit) * 100.0 / count(*), 1) AS cache_hit_rate FROM c")
def metrics_summary(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return evaluation.metrics_summary(e.select((F.col("value") < 10).alias("error")), e.select((F.col("user_id") % 3 == 0).alias("hit")))


_LABEL = "CASE WHEN contains(lower(trim(text)), 'entailment') THEN 'entailment' WHEN contains(lower(trim(text)), 'contradiction') THEN 'contradiction' WHEN contains(lower(trim(text)), 'neutral') THEN 'neutral' ELSE 'unknown' END"


@query(f"SELECT conv_id, turn, {_LABEL} AS label, regexp_extract(upper(text), '[ABC]', 0) AS letter FROM conversations")
def parse_conversation_answers(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", evaluation.parse_label(F.col("text")).alias("label"), evaluation.parse_letter(F.col("text")).alias("letter"))


@query(
    "SELECT conv_id, turn, CASE WHEN turn % 3 < 2 THEN 'ara' || turn END AS name, CASE WHEN turn % 3 = 0 THEN '{\"q\":' || conv_id || '}' ELSE '{}' END AS arguments FROM conversations"
)
def tool_call_extraction(spark, sf_dir):
    """Messages with a tool call, with one whose arguments can't be read, and without one."""
    c, turn = read(spark, sf_dir, "conversations"), F.col("turn") % 3
    arguments = F.when(turn == 0, F.format_string('{"q":%d}', F.col("conv_id"))).otherwise("{bozuk")
    call = F.struct(F.concat(F.lit("ara"), F.col("turn").cast("string")).alias("name"), arguments.alias("arguments"))
    message = F.when(turn < 2, F.to_json(F.struct(F.array(F.struct(call.alias("function"))).alias("tool_calls")))).otherwise('{"content":"yok"}')
    return c.select("conv_id", "turn", evaluation.tool_call(message).alias("c")).select("conv_id", "turn", "c.*")


@query("SELECT item_id, list_transform(list_sort(list_transform(['a ' || item_id, 'b ' || item_id, 'c ' || item_id], lambda o: struct_pack(k := sha256('7' || o), o := o))), lambda s: s.o) AS options FROM benchmark")
def shuffled_options(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    return b.select("item_id", evaluation.shuffled_options(F.array(*[F.concat(F.lit(f"{c} "), F.col("item_id").cast("string")) for c in "abc"]), 7).alias("options"))
