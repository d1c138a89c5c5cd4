"""The circuit breaker with its clock."""

import time

import pytest

from mizan.streaming import breaker

SCHEMA = "tool string, seq int, success boolean"


@pytest.fixture
def feed(spark, tmp_path):
    """Adds results and runs the stream once on one checkpoint; returns what it says."""

    def run(rows, pause_ms=60_000, idle_ms=3_600_000):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = breaker.circuit_breaker(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), pause_ms=pause_ms, idle_ms=idle_ms)
        said = []
        query = out.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda d, _: said.extend(d.collect())).trigger(once=True).start()
        assert query.awaitTermination(120)
        return {r.tool: (r.streak, r.open, r.phase) for r in said}

    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, breaker.PROVIDER)
    yield run
    spark.conf.set(name, old)


def failures(tool, first, last):
    return [(tool, i, False) for i in range(first, last)]


def test_opens_at_ten_failures_and_closes_on_success(feed):
    assert feed(failures("t", 0, 9) + [("s", 0, True)]) == {"t": (9, False, "closed"), "s": (0, False, "closed")}
    assert feed(failures("t", 9, 10)) == {"t": (10, True, "open")}
    assert feed(failures("t", 10, 12)) == {"t": (12, True, "open")}
    assert feed([("t", 12, True), ("t", 13, False)]) == {"t": (1, False, "closed")}
    # out of order within a batch, and late: a failure before the last success counts for nothing
    assert feed([("t", 16, False), ("t", 14, False), ("t", 15, True), ("t", 11, False)]) == {"t": (1, False, "closed")}
    assert feed([("t", 13, True)]) == {"t": (1, False, "closed")}


def test_tries_again_after_a_pause_and_forgets(feed):
    assert feed(failures("t", 0, 10), pause_ms=1500)["t"] == (10, True, "open")
    time.sleep(2)
    assert feed([("other", 0, True)], pause_ms=1500)["t"] == (10, False, "trial")
    assert feed(failures("t", 10, 11), pause_ms=1500)["t"] == (11, True, "open")  # the trial failed
    time.sleep(2)
    assert feed([("other", 1, True)], pause_ms=1500)["t"] == (11, False, "trial")
    assert feed([("t", 11, True)], pause_ms=1500, idle_ms=1500)["t"] == (0, False, "closed")
    time.sleep(2)
    assert feed([("other", 2, True)], idle_ms=1500)["t"] == (0, False, "closed")  # forgotten
    assert feed([("t", 3, False)], idle_ms=1500)["t"] == (1, False, "closed")  # so an order before the old success counts
