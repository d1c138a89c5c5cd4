"""Indicator series: trends, comparisons, snapshots, digests and new items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

#: Names of the directions, days of the periods.
UP, DOWN, FLAT = "yükseliş", "düşüş", "yatay"
PERIODS = {"day": 1, "week": 7, "month": 30, "quarter": 90}


def from_wire(rows: DataFrame, column: str = "payload") -> DataFrame:
    """Series with parallel axes in JSON to rows (metric_id, title, pos, date, value); bad values are 0."""
    wire = "struct<Baslik: string, XEkseni: array<string>, YEkseni: array<string>>"
    parsed = rows.select("metric_id", F.from_json(column, wire).alias("w"))
    points = F.arrays_zip(F.col("w.XEkseni").alias("date"), F.col("w.YEkseni").alias("value"))
    out = parsed.select("metric_id", F.col("w.Baslik").alias("title"), F.posexplode(points).alias("pos", "p"))
    return out.select("metric_id", "title", "pos", "p.date", F.coalesce(F.expr("try_cast(p.value AS double)"), F.lit(0.0)).alias("value"))


def trend(series: DataFrame, key: str = "metric_id") -> DataFrame:
    """Last and previous value, change, average, extremes and direction of each series of two points or more.

    series: key, pos, date, value. Four points or more: two rises or more among
    the last four are up, none is down (also on a plateau), else flat; fewer:
    the sign of the last change.
    """
    own = Window.partitionBy(key).orderBy("pos")
    rows = series.withColumn("before", F.lag("value").over(own)).withColumn("before_date", F.lag("date").over(own))
    rows = rows.withColumn("back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("pos"))))
    rises = F.sum(F.when((F.col("back") <= 3) & (F.col("value") > F.col("before")), 1).otherwise(0))
    out = rows.groupBy(key).agg(
        F.count("*").alias("data_points"),
        *[F.max(F.when(F.col("back") == 1, F.col(c))).alias(n) for c, n in (("value", "current"), ("date", "current_date"), ("before", "previous"), ("before_date", "previous_date"))],
        F.avg("value").alias("avg"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.min_by("date", F.struct("value", "pos")).alias("min_date"),
        F.min_by("date", F.struct(-F.col("value"), "pos")).alias("max_date"),
        rises.alias("rises"),
    )
    change = F.col("current") - F.col("previous")
    out = out.where("data_points >= 2").withColumn("wow_change", change)
    out = out.withColumn("wow_pct", F.when(F.col("previous") != 0, change / F.col("previous") * 100).otherwise(0.0))
    by_four = F.when(F.col("rises") >= 2, UP).when(F.col("rises") == 0, DOWN).otherwise(FLAT)
    by_sign = F.when(change > 0, UP).when(change < 0, DOWN).otherwise(FLAT)
    return out.withColumn("trend_direction", F.when(F.col("data_points") >= 4, by_four).otherwise(by_sign)).drop("rises")


def narrative(title: Column, change: Column, pct: Column, points: Column, direction: Column, current: Column, avg: Column) -> Column:
    """The trend in a sentence."""
    moved = F.when(change > 0, "arttı").when(change < 0, "azaldı").otherwise("değişmedi")
    return F.concat(
        title, F.lit(": Son haftada %"), F.format_string("%.2f", F.abs(pct)), F.lit(" "), moved, F.lit(". Son "), points.cast("string"), F.lit(" haftalık trend: "), direction,
        F.lit(". Mevcut değer: "), F.format_number(current, 2), F.lit(", ortalama: "), F.format_number(avg, 2), F.lit("."),
    )


def compare(series: DataFrame, metric_ids: list[str], most: int = 4) -> DataFrame:
    """Current and previous value of the first `most` metrics, in the order asked; one point has previous 0.

    Metrics without a row have an error.
    """
    wanted = series.sparkSession.createDataFrame([(i, m) for i, m in enumerate(metric_ids[:most])], "ord int, metric_id string")
    rows = series.withColumn("back", F.row_number().over(Window.partitionBy("metric_id").orderBy(F.desc("pos")))).where("back <= 2")
    last = rows.groupBy("metric_id").agg(F.max(F.when(F.col("back") == 1, F.col("value"))).alias("current"), F.coalesce(F.max(F.when(F.col("back") == 2, F.col("value"))), F.lit(0.0)).alias("previous"))
    out = wanted.join(last, "metric_id", "left")
    pct = F.when(F.col("previous") != 0, (F.col("current") - F.col("previous")) / F.col("previous") * 100).otherwise(0.0)
    return out.withColumn("wow_pct", F.when(F.col("current").isNotNull(), pct)).withColumn("error", F.when(F.col("current").isNull(), "no data"))


def latest(series: DataFrame, key: str = "metric_id") -> DataFrame:
    return series.groupBy(key).agg(F.max_by("date", "pos").alias("date"), F.max_by("value", "pos").alias("value"))


def last_points(series: DataFrame, n: int = 10, key: str = "metric_id") -> DataFrame:
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("pos")))
    return series.withColumn("back", back).where(F.col("back") <= n).drop("back")


def first_per_group(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rn") <= n)


def grouped_in_order(rows: DataFrame, keys: list[str], order: list[str]) -> GroupedData:
    """Groups whose rows are added up in order, however the table is split: in partial sums of doubles the last bits change with the splits. All rows are shuffled; a group is one task's stream."""
    return rows.repartition(*keys).sortWithinPartitions(*order).groupBy(*keys)


def top_categories(rows: DataFrame, n: int = 3) -> DataFrame:
    """Most frequent categories, ties by first appearance; rows: category, pos."""
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.min("pos").alias("first")).orderBy(F.desc("n"), "first").limit(n)


def new_items(seen: DataFrame, current: DataFrame, key: str = "url") -> DataFrame:
    """Items whose key isn't known; null and empty keys are never new."""
    return current.where(F.coalesce(key, F.lit("")) != "").join(seen.select(key), key, "left_anti")


def baseline(seen: DataFrame, current: DataFrame, key: str = "url", only_first: int | None = None) -> DataFrame:
    """Keys known from now on; with only_first, just that many of the new ones are remembered."""
    new = new_items(seen, current, key).select(key).distinct()
    if only_first is not None:
        new = new.orderBy(key).limit(only_first)
    return seen.select(key).unionByName(new).distinct()


def consecutive_failures(events: DataFrame, key: str, order: str, success: str, threshold: int = 10) -> DataFrame:
    """Adds the failures in a row up to each event, and whether the breaker is open after it."""
    own = Window.partitionBy(key).orderBy(order)
    run = events.withColumn("run", F.sum(F.col(success).cast("int")).over(own))
    streak = F.sum((~F.col(success)).cast("int")).over(Window.partitionBy(key, "run").orderBy(order))
    return run.withColumn("streak", streak).withColumn("open", F.col("streak") >= threshold).drop("run")
