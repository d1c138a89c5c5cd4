"""Checks of parameters: functions that raise, and the same rules as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Currencies of the two bulletins, and the columns of a series.
WEEKLY_CURRENCIES, MONTHLY_CURRENCIES, COLUMNS = ("TRY", "USD"), ("TL", "USD"), ("1", "2", "3")


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def metric_id(value: str) -> str:
    _need(re.fullmatch(r"\d+\.\d+\.\d+", value or "") is not None, f"not a metric: {value!r}")
    return value


def table_number(value: int) -> int:
    _need(1 <= value <= 17, f"no such table: {value}")
    return value


def month(value: int) -> int:
    _need(1 <= value <= 12, f"no such month: {value}")
    return value


def year(value: int) -> int:
    _need(2000 <= value <= 2100, f"year out of range: {value}")
    return value


def currency(value: str, monthly: bool) -> str:
    allowed = MONTHLY_CURRENCIES if monthly else WEEKLY_CURRENCIES
    _need(value in allowed, f"no such currency: {value!r}")
    return value


def series_column(value: str) -> str:
    _need(value in COLUMNS, f"no such column: {value!r}")
    return value


def page(number: int, size: int) -> tuple[int, int]:
    _need(number >= 1 and 1 <= size <= 50, f"page {number} of {size}")
    return number, size


def valid_row(metric: Column, table: Column, month_: Column, year_: Column) -> Column:
    ok = metric.rlike(r"^\d+\.\d+\.\d+$") & table.between(1, 17) & month_.between(1, 12) & year_.between(2000, 2100)
    return F.coalesce(ok, F.lit(False))
