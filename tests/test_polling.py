"""Pages polled as a stream, and phases with a deadline."""

import time

from mizan.plans.maintenance import start_up
from mizan.sources.web import ListPageStream
from mizan.streaming import jobs


def page(*numbers):
    return "".join(f'<a href="/Duyuru/Detay/{n}"><span class="gorunenTarih">01.02.2024</span><span class="text">Duyuru {n}</span></a>' for n in numbers)


def test_announcements_come_once(spark, tmp_path):
    spark.dataSource.register(ListPageStream)
    said = []

    def run(fails=False):
        polled = spark.readStream.format("list_page_stream").option("template", f"file://{tmp_path}/page-{{}}.html").option("ids", "49,50").option("archive", str(tmp_path / "archive")).option("retries", "1").load()

        def one(batch, _):
            said.append(sorted((r.page_id, r.url, r.title, r.baseline) for r in batch.collect()))
            if fails:
                raise RuntimeError("lost")

        query = jobs.new_announcements(polled, "https://host").writeStream.foreachBatch(one).option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start()
        try:
            query.awaitTermination(120)
        except Exception as error:
            assert fails, error
        return said[-1] if said else []

    row = lambda i, n, baseline: (i, f"https://host/Duyuru/Detay/{n}", f"Duyuru {n}", baseline)
    (tmp_path / "page-49.html").write_text(page(2, 1))
    assert run() == [row(49, 1, True), row(49, 2, True)]
    (tmp_path / "page-49.html").write_text(page(3, 2, 1))
    (tmp_path / "page-50.html").write_text(page(20))
    assert run(fails=True) == [row(49, 3, False), row(50, 20, True)]
    (tmp_path / "page-49.html").write_text(page(12, 4, 3))  # the page has moved on when the batch runs again
    assert run() == [row(49, 3, False), row(50, 20, True)]
    (tmp_path / "page-50.html").unlink()  # can't be fetched: nothing is new, nothing is forgotten
    said.clear()
    assert run() == [row(49, 12, False), row(49, 4, False)]
    (tmp_path / "page-50.html").write_text(page(20, 2))
    said.clear()
    assert run() == [row(50, 2, False)]


def test_a_phase_that_never_ends_is_cancelled(spark):
    began = time.monotonic()

    def never():
        spark.range(0, 20_000, 1, 5000).selectExpr("java_method('java.lang.Thread', 'sleep', 200L) AS x").write.format("noop").mode("overwrite").save()

    counted = []
    out = start_up([("first", lambda: spark.range(5).count()), ("endless", never), ("wrong", lambda: 1 / 0), ("last", lambda: counted.append(spark.range(7).count()))], timeout=45, spark=spark)
    assert [n for n, _ in out] == ["first", "endless", "wrong", "last"]
    assert [s.split(":")[0] for _, s in out] == ["done", "timed out", "failed", "done"] and counted == [7]
    assert time.monotonic() - began < 50
