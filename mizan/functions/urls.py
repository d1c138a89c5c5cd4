"""Identifiers and addresses of legislation pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOST = "mevzuat.gov.tr"
BASE = "https://www.mevzuat.gov.tr"

# Path segment and name of each legislation type code.
TYPE_SEGMENTS = {"1": "kanun", "2": "kanunhukmundekararname", "4": "cumhurbaskanligikararnamesi", "5": "tuzuk", "7": "yonetmelik", "9": "teblig", "11": "cumhurbaskanligikararnamesi"}
TYPE_NAMES = {"1": "Kanun", "2": "KanunHukmundeKararname", "4": "CumhurbaskanligiKararnamesi", "5": "Tuzuk", "7": "Yonetmelik", "9": "Teblig", "11": "CumhurbaskanligiKararnamesi"}


def _parameter(url: Column, name: str) -> Column:
    """A query parameter, null if absent or empty; also of addresses that parse_url rejects."""
    found = F.regexp_extract(url, rf"[?&]{name}=([^&#]+)", 1)
    return F.when(found != "", found)


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def external_id(url: Column) -> Column:
    """mevzuat_ and the number, or the last part of a code of three or more parts; else null."""
    code = F.split(_parameter(url, "MevzuatKod"), r"\.")
    last = F.when(F.size(code) >= 3, F.element_at(code, -1))
    return F.when(F.contains(host(url), F.lit(HOST)), F.concat(F.lit("mevzuat_"), F.coalesce(_parameter(url, "MevzuatNo"), last)))


def parameters(url: Column) -> Column:
    """Struct of number, type and part: defaults '', 7 and 5; a three-part code fills a missing number."""
    number = _parameter(url, "MevzuatNo")
    code = F.split(_parameter(url, "MevzuatKod"), r"\.")
    by_code = number.isNull() & (F.size(code) >= 3)
    kind, part = F.coalesce(_parameter(url, "MevzuatTur"), F.lit("7")), F.coalesce(_parameter(url, "MevzuatTertip"), F.lit("5"))
    return F.struct(
        F.when(by_code, F.element_at(code, -1)).otherwise(F.coalesce(number, F.lit(""))).alias("number"),
        F.when(by_code, F.get(code, F.lit(0))).otherwise(kind).alias("type"),
        F.when(by_code, F.get(code, F.lit(1))).otherwise(part).alias("part"),
    )


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def pdf_url(number: Column, kind: Column, part: Column) -> Column:
    return F.concat(F.lit(f"{BASE}/MevzuatMetin/"), _lookup(TYPE_SEGMENTS, kind), F.lit("/"), kind, F.lit("."), part, F.lit("."), number, F.lit(".pdf"))


def generated_pdf_url(number: Column, kind: Column, part: Column) -> Column:
    return F.concat(F.lit(f"{BASE}/File/GeneratePdf?mevzuatNo="), number, F.lit("&mevzuatTur="), _lookup(TYPE_NAMES, kind), F.lit("&mevzuatTertip="), part)


def doc_url(number: Column, kind: Column, part: Column) -> Column:
    segment = F.coalesce(_lookup(TYPE_SEGMENTS, kind), F.lit("yonetmelik"))
    return F.concat(F.lit(f"{BASE}/MevzuatMetin/"), segment, F.lit("/"), kind, F.lit("."), part, F.lit("."), number, F.lit(".doc"))


def resolve(document_id: Column, source_url: Column, template: str) -> Column:
    """Digits: the template with the id; a prefixed id: the PDF named by its source; else the template."""
    p = parameters(F.coalesce(source_url, F.lit("")))
    number = F.regexp_replace(document_id, "^mevzuat_", "")
    prefixed = document_id.startswith("mevzuat_")
    found = pdf_url(F.when(p["number"] != "", p["number"]).otherwise(number), p["type"], p["part"])
    before, after = template.split("{}")
    plain = F.concat(F.lit(before), document_id, F.lit(after))
    return F.when(prefixed, F.coalesce(found, plain)).otherwise(plain)
