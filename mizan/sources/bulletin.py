"""Weekly and monthly figures by request: token and default date from the page, then one form for each request."""

from __future__ import annotations

import re
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from mizan.operators.pages import DEFAULT_DATE, TOKEN_FIELD
from mizan.sources.web import fetch

# Paths of the pages and of their services, and the code of the whole sector.
WEEKLY_PAGE, WEEKLY_SERVICE = "/bultenhaftalik", "/BultenHaftalik/tr/Home/KiyaslamaJsonGetir"
MONTHLY_PAGE, MONTHLY_SERVICE = "/BultenAylik", "/BultenAylik/tr/Home/BasitRaporGetir"
SECTOR = "10001"


def settings(html: str) -> tuple[str, str]:
    """Request token and default date of a page, empty where there is none."""
    field = re.search(rf"(?is)<input\b[^>]*\bname=[\"']{TOKEN_FIELD}[\"'][^>]*>", html)
    token = re.search(r"(?is)\bvalue=[\"']([^\"']*)", field[0]) if field else None
    date = re.search(DEFAULT_DATE, html)
    return token[1] if token else "", date[1] if date else ""


def weekly_form(row: dict, date: str) -> dict[str, str]:
    """row: metric_id, currency, days, date, column; an empty date is the page's."""
    return {"dil": "tr", "tarih": row["date"] or date, "id": row["metric_id"], "parabirimi": row["currency"], "sutun": row["column"], "tarafKodu": SECTOR, "gun": str(row["days"])}


def monthly_form(row: dict, date: str) -> dict[str, str]:
    """row: table_no, year, month, currency, party (empty: the sector)."""
    return {"tabloNo": str(row["table_no"]), "yil": str(row["year"]), "ay": str(row["month"]), "paraBirimi": row["currency"], "taraf[0]": row["party"] or SECTOR}


def send(url: str, form: dict[str, str], referer: str, opener=urllib.request.urlopen) -> bytes:
    headers = {"X-Requested-With": "XMLHttpRequest", "Content-Type": "application/x-www-form-urlencoded; charset=UTF-8", "Referer": referer}
    return fetch(urllib.request.Request(url, urllib.parse.urlencode(form).encode(), headers), opener=opener)


def _read(requests: DataFrame, base: str, page: str, service: str, form: Callable[[dict, str], dict], opener) -> DataFrame:
    """requests with payload or error; a task reads the page once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, problem = ("", ""), None
        try:
            found = settings(fetch(base + page, opener=opener).decode("utf-8", "replace"))
        except (OSError, ValueError) as error:
            problem = f"{type(error).__name__}: {error}"
        token, date = found
        for batch in batches:
            payloads, errors = [], []
            for row in batch.to_dict("records"):
                try:
                    if problem:
                        raise ValueError(problem)
                    fields = form(row, date) | ({TOKEN_FIELD: token} if token else {})
                    payloads.append(send(base + service, fields, base + page, opener).decode("utf-8", "replace"))
                    errors.append(None)
                except (OSError, ValueError) as error:
                    payloads.append(None)
                    errors.append(problem or f"{type(error).__name__}: {error}")
            yield batch.assign(payload=payloads, error=errors)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return requests.mapInPandas(run, f"{schema}, payload string, error string")


def read_weekly(requests: DataFrame, base: str, opener=urllib.request.urlopen) -> DataFrame:
    """requests (metric_id, currency, days, date, column) with the payload that series.from_wire reads, or an error."""
    return _read(requests, base, WEEKLY_PAGE, WEEKLY_SERVICE, weekly_form, opener)


def read_monthly(requests: DataFrame, base: str, opener=urllib.request.urlopen) -> DataFrame:
    """requests (table_no, year, month, currency, party) with the payload that pages.monthly_rows reads, or an error."""
    return _read(requests, base, MONTHLY_PAGE, MONTHLY_SERVICE, monthly_form, opener)
