"""Series, digest and monitoring queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mizan.functions import text
from mizan.operators import search, series
from mizan.plans.registry import query
from mizan.sources.tables import PLACE, WEEKLY, read, table_order, weekly

_TREND = (
    f"WITH {WEEKLY}, r AS (SELECT *, lag(value) OVER w AS before, lag(date) OVER w AS before_date, row_number() OVER (PARTITION BY metric_id ORDER BY pos DESC) AS back FROM series WINDOW w AS (PARTITION BY metric_id ORDER BY pos)), "
    "t AS (SELECT metric_id, count(*) AS data_points, max(value) FILTER (WHERE back = 1) AS current, max(date) FILTER (WHERE back = 1) AS current_date, max(before) FILTER (WHERE back = 1) AS previous, "
    "max(before_date) FILTER (WHERE back = 1) AS previous_date, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, arg_min(date, struct_pack(v := value, p := pos)) AS min_date, "
    "arg_min(date, struct_pack(v := -value, p := pos)) AS max_date, count(*) FILTER (WHERE back <= 3 AND value > before) AS rises FROM r GROUP BY 1) "
)
_DIRECTION = "CASE WHEN data_points >= 4 THEN CASE WHEN rises >= 2 THEN 'yükseliş' WHEN rises = 0 THEN 'düşüş' ELSE 'yatay' END ELSE CASE WHEN current > previous THEN 'yükseliş' WHEN current < previous THEN 'düşüş' ELSE 'yatay' END END"


@query(
    _TREND + "SELECT metric_id, data_points, current, current_date, previous, previous_date, avg, min, max, min_date, max_date, round(current - previous, 6) AS wow_change, "
    f"round(CASE WHEN previous <> 0 THEN (current - previous) / previous * 100 ELSE 0.0 END, 6) AS wow_pct, {_DIRECTION} AS trend_direction FROM t WHERE data_points >= 2"
)
def trend_by_metric(spark, sf_dir):
    out = series.trend(weekly(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("avg", "wow_change", "wow_pct")})


@query(
    _TREND + f"SELECT metric_id, metric_id || ': Son haftada %' || format('{{:.2f}}', abs((current - previous) / previous * 100)) || ' ' || CASE WHEN current > previous THEN 'arttı' WHEN current < previous THEN 'azaldı' ELSE 'değişmedi' END || "
    f"'. Son ' || data_points || ' haftalık trend: ' || {_DIRECTION} || '. Mevcut değer: ' || format('{{:,.2f}}', current) || ', ortalama: ' || format('{{:,.2f}}', avg) || '.' AS narrative FROM t WHERE data_points >= 2"
)
def trend_narrative(spark, sf_dir):
    t = series.trend(weekly(spark, sf_dir))
    return t.select("metric_id", series.narrative(F.col("metric_id"), F.col("wow_change"), F.col("wow_pct"), F.col("data_points"), F.col("trend_direction"), F.col("current"), F.col("avg")).alias("narrative"))


@query(
    f"WITH {WEEKLY}, w(ord, metric_id) AS (VALUES (0, 'view'), (1, 'absent'), (2, 'click'), (3, 'error')), r AS (SELECT *, row_number() OVER (PARTITION BY metric_id ORDER BY pos DESC) AS back FROM series), "
    "l AS (SELECT metric_id, max(value) FILTER (WHERE back = 1) AS current, coalesce(max(value) FILTER (WHERE back = 2), 0.0) AS previous FROM r WHERE back <= 2 GROUP BY 1) "
    "SELECT ord, metric_id, current, previous, CASE WHEN current IS NOT NULL THEN round(CASE WHEN previous <> 0 THEN (current - previous) / previous * 100 ELSE 0.0 END, 6) END AS wow_pct, CASE WHEN current IS NULL THEN 'no data' END AS error FROM w LEFT JOIN l USING (metric_id)"
)
def compare_metrics(spark, sf_dir):
    out = series.compare(weekly(spark, sf_dir), ["view", "absent", "click", "error", "purchase"])
    return out.select("ord", "metric_id", "current", "previous", F.round("wow_pct", 6).alias("wow_pct"), "error")


@query(f"WITH {WEEKLY} SELECT metric_id, arg_max(date, pos) AS date, arg_max(value, pos) AS value FROM series GROUP BY 1")
def snapshot_latest(spark, sf_dir):
    return series.latest(weekly(spark, sf_dir))


@query(f"WITH {WEEKLY} SELECT metric_id, date, value, pos FROM (SELECT *, row_number() OVER (PARTITION BY metric_id ORDER BY pos DESC) AS b FROM series) WHERE b <= 10")
def last_ten(spark, sf_dir):
    return series.last_points(weekly(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


_WIRE = [(1, '{"Baslik":"Krediler","XEkseni":["01.03.2024","08.03.2024","15.03.2024"],"YEkseni":["10.5","x","12"]}'), (2, '{"Baslik":"Mevduat","XEkseni":["01.03.2024"],"YEkseni":["7"]}')]


@query(f"WITH {WEEKLY} SELECT * FROM (VALUES ('1', 'Krediler', 0, '01.03.2024', 10.5::DOUBLE), ('1', 'Krediler', 1, '08.03.2024', 0.0), ('1', 'Krediler', 2, '15.03.2024', 12.0), ('2', 'Mevduat', 0, '01.03.2024', 7.0)) t(metric_id, title, pos, date, value) UNION ALL SELECT metric_id, 'Seri ' || metric_id, CAST(pos AS INT), date, value FROM series")
def series_wire_format(spark, sf_dir):
    points = F.array_sort(F.collect_list(F.struct("pos", "date", F.col("value").cast("string").alias("value"))))
    own = weekly(spark, sf_dir).groupBy("metric_id").agg(points.alias("p"))
    wire = F.to_json(F.struct(F.concat(F.lit("Seri "), "metric_id").alias("Baslik"), F.col("p.date").alias("XEkseni"), F.col("p.value").alias("YEkseni")))
    return series.from_wire(own.select("metric_id", wire.alias("payload")).union(spark.createDataFrame([(str(i), w) for i, w in _WIRE], "metric_id string, payload string")))



@query(
    "WITH m AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, l_returnflag AS name, sum(l_extendedprice) FILTER (WHERE l_linestatus = 'O') AS tp, sum(l_extendedprice) FILTER (WHERE l_linestatus = 'F') AS yp, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1, 2) "
    "SELECT month, name, format('{:,}', CAST(round(tp) AS BIGINT)) AS tp, format('{:,}', CAST(round(yp) AS BIGINT)) AS yp, format('{:,}', CAST(round(total) AS BIGINT)) AS total FROM m"
)
def monthly_table(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("l_returnflag").alias("name"), "l_linestatus", "l_extendedprice", *table_order())
    m = series.grouped_in_order(li, ["month", "name"], PLACE).agg(
        F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice"))).alias("tp"), F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice"))).alias("yp"), F.sum("l_extendedprice").alias("total")
    )
    return m.select("month", "name", *[text.format_number(F.round(c)).alias(c) for c in ("tp", "yp", "total")])


_ORDERS = "o AS (SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS decision_date, o_orderpriority AS category, o_orderdate FROM orders)"
_RECENT = f"WITH {_ORDERS}, r AS (SELECT * FROM o WHERE floor(epoch(TIMESTAMP '2001-08-01 12:00:00' - date_trunc('day', o_orderdate)) / 86400) BETWEEN 0 AND 30)"


def _recent(spark, sf_dir, period="month"):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy").alias("decision_date"), F.col("o_orderpriority").alias("category"))
    return o.where(search.in_trailing_days(F.col("decision_date"), "2001-08-01 12:00:00", series.PERIODS.get(period, 30)))


@query(f"{_RECENT} SELECT o_orderkey, decision_date, category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY date_trunc('day', o_orderdate) DESC, o_orderkey) AS rn FROM r) WHERE rn <= 5")
def regulatory_digest(spark, sf_dir):
    found = series.first_per_group(_recent(spark, sf_dir), "category", [F.desc(text.parse_date(F.col("decision_date"))), "o_orderkey"], 5)
    return found.select("o_orderkey", "decision_date", "category")


@query(f"{_RECENT} SELECT category, count(*) AS n, min(o_orderkey) AS first FROM r GROUP BY 1 ORDER BY n DESC, first LIMIT 3")
def digest_top_categories(spark, sf_dir):
    return series.top_categories(_recent(spark, sf_dir).withColumn("pos", F.col("o_orderkey")))


@query("WITH k AS (SELECT url FROM pages WHERE url LIKE 'https%'), c AS (SELECT page_id, CASE WHEN url LIKE '%#top' THEN '' ELSE url END AS url FROM pages) SELECT page_id, url FROM c WHERE url <> '' AND url NOT IN (SELECT url FROM k)")
def update_detection(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    current = p.select("page_id", F.when(F.col("url").endswith("#top"), "").otherwise(F.col("url")).alias("url"))
    return series.new_items(p.where("url LIKE 'https%'").select("url"), current)


@query("WITH k AS (SELECT url FROM pages WHERE url LIKE 'https%'), n AS (SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM k) ORDER BY url LIMIT 10) SELECT url FROM k UNION SELECT url FROM n")
def update_baseline(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("url", "page_id")
    return series.baseline(p.where("url LIKE 'https%'"), p, only_first=10)


@query(
    "WITH e AS (SELECT user_id, event_id, value > 90 AS success FROM events), r AS (SELECT *, sum(CAST(success AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e), "
    "s AS (SELECT *, sum(CAST(NOT success AS INT)) OVER (PARTITION BY user_id, run ORDER BY event_id) AS streak FROM r) SELECT user_id, event_id, CAST(streak AS BIGINT) AS streak, streak >= 10 AS open FROM s"
)
def circuit_breaker(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") > 90).alias("success"))
    return series.consecutive_failures(e, "user_id", "event_id", "success").select("user_id", "event_id", "streak", "open")


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def daily_windows(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = e.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return out.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("day"), "n", "value")


@query("WITH i AS (SELECT s_suppkey, s_name AS name, n_name AS type, r_name AS subcategory, CASE WHEN s_acctbal >= 0 THEN 'Aktif' ELSE 'İptal Edilmiş' END AS status FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT s_suppkey, name, type, subcategory FROM i WHERE status = 'Aktif' AND (contains(lower(translate(name, 'İIŞÇÜÖĞ', 'iışçüöğ')), lower(translate('NA', 'İIŞÇÜÖĞ', 'iışçüöğ'))) OR contains(lower(translate(type, 'İIŞÇÜÖĞ', 'iışçüöğ')), lower(translate('NA', 'İIŞÇÜÖĞ', 'iışçüöğ'))))")
def institution_search(spark, sf_dir):
    return search.institutions(_institutions(spark, sf_dir), "NA").select("s_suppkey", "name", "type", "subcategory")


def _institutions(spark, sf_dir):
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    status = F.when(F.col("s_acctbal") >= 0, "Aktif").otherwise("İptal Edilmiş")
    return joined.select("s_suppkey", F.col("s_name").alias("name"), F.col("n_name").alias("type"), F.col("r_name").alias("subcategory"), status.alias("status"))


@query("SELECT s_suppkey, n_name AS type FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE contains(lower(n_name), 'no such type') OR NOT EXISTS (SELECT 1 FROM nation WHERE contains(lower(n_name), 'no such type'))")
def type_fallback(spark, sf_dir):
    return search.of_type_or_all(_institutions(spark, sf_dir).select("s_suppkey", "type"), "type", "no such type")


@query(
    "WITH m AS (SELECT event_type, lower(translate(event_type, 'İIŞÇÜÖĞ', 'iışçüöğ')) AS x FROM events), c AS (SELECT event_type, CASE WHEN contains(x, 'pur') THEN 'buy' WHEN contains(x, 'i') THEN 'see' ELSE 'other' END AS category FROM m) SELECT event_type, category, count(*) AS n FROM c GROUP BY 1, 2"
)
def keyword_category_map(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.groupBy("event_type", search.first_contained(F.col("event_type"), {"pur": "buy", "i": "see"}, "other").alias("category")).agg(F.count("*").alias("n"))
