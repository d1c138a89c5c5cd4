"""Weekly and monthly requests against a service of the test's own."""

import io
import json
import urllib.error
import urllib.parse

from mizan.operators import pages, series
from mizan.sources import bulletin

PAGE = """<form><input type="hidden" name="__RequestVerificationToken" value="t0k"/></form><script>var x = {"tarih": '27.03.2026'};</script>"""


def service(page=PAGE):
    """The pages as they are; a form is answered with what it asked. Made here, so that tasks get it by value."""

    def opener(request):
        if isinstance(request, str):
            return io.BytesIO(page.encode())
        form = dict(urllib.parse.parse_qsl(request.data.decode()))
        if form.get("id") == "bad":
            raise urllib.error.HTTPError(request.full_url, 404, "yok", None, None)
        if "id" in form:
            return io.BytesIO(json.dumps({"Baslik": form["id"], "XEkseni": [form["tarih"], form["__RequestVerificationToken"]], "YEkseni": [int(form["gun"]), form["sutun"]]}).encode())
        return io.BytesIO(json.dumps({"Json": {"data": {"rows": [{"cell": ["g", "1", form["taraf[0]"], "b", form["yil"], form["ay"], "-"]}]}}}).encode())

    return opener


def test_weekly_requests(spark):
    asked = spark.createDataFrame([("1.0.1", "TRY", 90, "", "1"), ("1.0.2", "USD", 7, "01.02.2024", "3"), ("bad", "TRY", 1, "", "1")], "metric_id string, currency string, days int, date string, `column` string")
    got = bulletin.read_weekly(asked.coalesce(1), "https://host", service())
    assert [r.error.split(":")[0] for r in got.where("error IS NOT NULL").collect()] == ["HTTPError"]
    rows = series.from_wire(got.where("error IS NULL")).collect()
    assert sorted((r.metric_id, r.pos, r.date, r.value) for r in rows) == [("1.0.1", 0, "27.03.2026", 90.0), ("1.0.1", 1, "t0k", 1.0), ("1.0.2", 0, "01.02.2024", 7.0), ("1.0.2", 1, "t0k", 3.0)]


def test_monthly_requests(spark):
    asked = spark.createDataFrame([(1, 2025, 12, "TL", ""), (2, 2024, 1, "USD", "7")], "table_no int, year int, month int, currency string, party string")
    rows = pages.monthly_rows(bulletin.read_monthly(asked, "https://host", service())).collect()
    assert sorted((r.name, r.tp, r.yp, r.total) for r in rows) == [("10001", "2,025", "12", "-"), ("7", "2,024", "1", "-")]


def test_a_page_that_is_not_there(spark):
    def closed(request):
        raise urllib.error.HTTPError("https://host", 404, "yok", None, None)

    asked = spark.createDataFrame([(1, 2025, 12, "TL", "")], "table_no int, year int, month int, currency string, party string")
    assert bulletin.read_monthly(asked, "https://host", closed).first().error.startswith("HTTPError")
    assert bulletin.settings("<p>") == ("", "")
