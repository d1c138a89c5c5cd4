"""Operators on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from mizan.functions import markup
from mizan.functions.directory import institutions
from mizan.functions.markdown import to_markdown
from mizan.operators import evaluation, reports, search, series, store
from mizan.plans.cache import ResultCache, catalog_status, health
from mizan.sources import seeds, snapshots, validation, web
from mizan.streaming import jobs


def cover_density(tokens, terms):
    """Minimal intervals that hold all terms, by two pointers."""
    hits = [(p, t) for p, t in enumerate(tokens) if t in terms]
    total, last, before = 0.0, {}, -1
    for k, (p, t) in enumerate(hits):
        last[t] = (p, k)
        if len(last) == len(terms):
            b, kb = min(last.values())
            if b > before:
                total += 0.1 / (1 + (p - b) - (k - kb))
                before = b
    return total


@pytest.mark.parametrize("inside", [search.INSIDE_TERMS, 0])
def test_cover_density_is_that_of_two_pointers(spark, monkeypatch, inside):
    monkeypatch.setattr(search, "INSIDE_TERMS", inside)
    rng = random.Random(5)
    docs = [(i, [rng.choice("abcde") for _ in range(rng.randrange(1, 30))]) for i in range(120)]
    asked = [(0, "a"), (1, "a b"), (2, "a b c")]
    found = search.fts(spark.createDataFrame(docs, "id int, tokens array<string>"), spark.createDataFrame(asked, "query_id int, query string"), "id", limit=1000, threshold=None).collect()
    got = {(r.query_id, r.id): r["rank"] for r in found}
    for q, words in asked:
        for i, tokens in docs:
            full = all(w in tokens for w in words.split())
            assert ((q, i) in got) == full
            if full:
                assert got[q, i] == pytest.approx(cover_density(tokens, words.split()))


def test_trend(spark):
    values = [10000, 10050, 10100, 10200, 10150, 10300, 10400, 10500]
    rows = [("m", i, f"d{i}", float(v)) for i, v in enumerate(values)] + [("flat", i, f"d{i}", 5.0) for i in range(4)] + [("one", 0, "d0", 1.0)]
    got = {r.metric_id: r for r in series.trend(spark.createDataFrame(rows, "metric_id string, pos int, date string, value double")).collect()}
    assert set(got) == {"m", "flat"}
    assert (got["m"].current, got["m"].previous, got["m"].min_date, got["m"].max_date) == (10500, 10400, "d0", "d7")
    assert got["m"].trend_direction == series.UP and got["flat"].trend_direction == series.DOWN and got["flat"].wow_pct == 0


@pytest.mark.parametrize(("n", "open_"), [(9, False), (10, True), (11, True)])
def test_breaker_opens_at_the_threshold(spark, n, open_):
    events = [("t", i, False) for i in range(n)] + [("t", n, True)]
    rows = series.consecutive_failures(spark.createDataFrame(events, "tool string, seq int, ok boolean"), "tool", "seq", "ok").orderBy("seq").collect()
    assert rows[n - 1].open is open_ and rows[n].streak == 0 and not rows[n].open


def test_keyword_search_filters_and_pages(spark):
    rows = [("1", "Kredi Yönetmeliği", "Yönetmelik", "01.03.2024", "1"), ("2", "Kredi Tebliği", "Tebliğ", "", ""), ("3", "Faiz Genelgesi", "Genelge", "05.01.2023", "7")]
    c = spark.createDataFrame(rows, "document_id string, title string, category string, decision_date string, decision_number string")
    assert [r.document_id for r in search.keyword_search(c, "KREDİ").collect()] == ["1", "2"]
    assert [r.document_id for r in search.keyword_search(c, "kredi", first="1.1.2024").collect()] == ["1"]
    assert [r.document_id for r in search.keyword_search(c, "kredi", first="bozuk").collect()] == ["1", "2"]
    assert search.keyword_search(c, "").count() == 0
    page = search.keyword_search(c, "kredi", page=2, size=1).collect()
    assert [(r.document_id, r.total_results) for r in page] == [("2", 2)]


def test_gap_is_of_binary_doubles():
    assert not 0.90 - 0.82 <= search.GAP


def test_text_only_hits_have_no_relevance(spark):
    v = spark.createDataFrame([(0, 1, 0.9, 1)], "query_id int, doc_id int, relevance double, position int")
    t = spark.createDataFrame([(0, 2, 0.3, 1)], "query_id int, doc_id int, rank double, position int")
    got = {r.doc_id: r for r in search.fuse(v, t).collect()}
    assert got[2].relevance == 0 and got[1].rrf_score == got[2].rrf_score == round(1 / 61, 6)


def test_upsert_keeps_the_blob(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "y")], "document_id string, blob string")
    new = spark.createDataFrame([("a", None), ("c", "z")], "document_id string, blob string")
    assert sorted(map(tuple, store.upsert(old, new, keep_if_null=("blob",)).collect())) == [("a", "x"), ("b", "y"), ("c", "z")]


def test_trials_without_any(spark):
    d = spark.createDataFrame([([],), ([True, False],)], "x array<boolean>")
    assert [tuple(r) for r in d.select(evaluation.pass_at_k(F.col("x")), evaluation.pass_all_k(F.col("x"))).collect()] == [(False, True), (True, False)]


def test_classes_absent_from_the_data(spark):
    p = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "zzz")], "truth string, pred string")
    m = evaluation.macro(p, ["a", "b", "c"]).first()
    assert m.accuracy == pytest.approx(1 / 3) and m.macro_f1 == pytest.approx((2 / 3) / 3)


def test_markdown():
    html = "<body><script>'</p>'</script><h2>Baş <b>lık</b></h2><p>BİRİNCİ BÖLÜM</p><p>a<br>b <a href='/x'>bağ</a></p><ul><li>bir<li>iki</ul></body>"
    assert to_markdown(html) == "## Baş **lık**\n\n## BİRİNCİ BÖLÜM\n\na b [bağ](/x)\n\n- bir\n\n- iki"
    assert to_markdown(None) == to_markdown("  ") == ""


def test_tables():
    table = "<table><tr><th colspan=2>A</th></tr><tr><td rowspan=2>x</td><td>1|2</td></tr><tr><td>3</td></tr></table>"
    assert to_markdown(table) == "| A |  |\n|---|---|\n| x | 1\\|2 |\n| x | 3 |"
    cell = "uzun hücre metni " * 15
    assert to_markdown(f"<table><tr><td>{cell}</td><td><b>{cell}</b></td></tr></table>").count("uzun") == 15


def test_tab_panes():
    html = "<div class='tab-pane' id='faaliyette'><li class='row'><div class='baslikContainer'>1. Açık A.Ş.</div><div class='webAdresiContainer'><a href='http://x'>w</a></div></li></div><div class='tab-pane' id='kapanan'><li class='row'><div class='baslikContainer'>Kapalı</div></li></div>"
    assert [(i["name"], i["status"], i["website"]) for i in institutions(html, "Faktoring")] == [("Açık A.Ş.", "Aktif", "http://x"), ("Kapalı", "İptal Edilmiş", "")]


def test_anomalies_that_driver_rows_lack(spark):
    rows = ["�", "<IMG src=x>", "<td >", "..........", "kelimeBirleşik", "FORMÜL", "ç" * 200]
    d = spark.createDataFrame([(r,) for r in rows], "x string")
    names = ["replacement_char", "leaked_img_tag", "leaked_html_block", "long_dot_run", "camelcase_concat", "formula_ref_without_formula"]
    flags = markup.anomalies(F.col("x"))
    got = d.select(*[flags[n].alias(n) for n in names]).collect()
    assert [[r[n] for n in names].index(True) for r in got[:6]] == list(range(6))


def test_cache():
    c = ResultCache(2, 10)
    c.set("a", 1, 0), c.set("b", 2, 0)
    assert c.get("a", 1) == 1
    c.set("c", 3, 1)
    assert c.get("b", 1) is None and c.get("a", 9.9) == 1 and c.get("a", 10) is None
    assert catalog_status(3, 0.0, 3600.0)["valid"] is False and catalog_status(3, 0.0, 3599.0)["valid"]
    assert health(True, True, 3725) == {"status": "DEGRADED", "uptime": "1h 2m 5s"}


def test_validation():
    validation.metric_id("1.0.1")
    for bad in (lambda: validation.metric_id("1.0"), lambda: validation.month(13), lambda: validation.currency("TL", False), lambda: validation.page(0, 5)):
        with pytest.raises(ValueError):
            bad()


def test_fetch_retries_server_errors_only():
    import urllib.error

    calls = []

    def failing(code):
        def opener(url):
            calls.append(url)
            raise urllib.error.HTTPError(url, code, "x", {}, None)

        return opener

    for code, times in ((404, 1), (503, 3), (429, 3)):
        calls.clear()
        with pytest.raises(urllib.error.HTTPError):
            web.fetch("http://x", 3, failing(code), lambda s: None)
        assert len(calls) == times


def test_list_pages_source_keeps_errors(spark):
    spark.dataSource.register(web.ListPages)
    d = spark.read.format("list_pages").option("template", "http://127.0.0.1:9/{}").option("ids", "1,2").option("retries", "1").load()
    rows = d.collect()
    assert sorted(r.page_id for r in rows) == [1, 2] and all(r.content is None and r.error for r in rows)


def test_seeds_and_snapshots(spark, tmp_path):
    d = spark.createDataFrame([("a", "t", b"x")], "document_id string, title string, pdf_blob binary")
    seeds.export_seed({"documents": d}, str(tmp_path / "seed"))
    back = seeds.import_seed(spark, str(tmp_path / "seed"), "documents", seeds.DOCUMENTS)
    assert back.select("document_id", "title").collect() == [("a", "t")] and "pdf_blob" not in back.columns
    path = str(tmp_path / "table")
    assert snapshots.current(spark, path) is None
    assert snapshots.commit(d, path) == 1 and snapshots.commit(d.union(d), path) == 2
    assert snapshots.current(spark, path).count() == 2
    seeds.comparison_report(d.drop("pdf_blob"), str(tmp_path / "report"))


def _stream(spark, df, folder, parts=1):
    for i in range(parts):
        df.write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).parquet(str(folder))


def _collect(spark, stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name).collect()


def test_streams(spark, tmp_path, small):
    items = spark.createDataFrame([("u1",), ("u1",), (None,), ("",), ("u2",)], "url string")
    assert sorted(r.url for r in _collect(spark, jobs.new_items(_stream(spark, items, tmp_path / "i", 2)), "items", "append")) == ["u1", "u2"]
    calls = spark.createDataFrame([("a", True, 1.0), ("a", False, 2.0)], "tool string, error boolean, latency double")
    assert [tuple(r) for r in _collect(spark, jobs.tool_metrics(_stream(spark, calls, tmp_path / "c")), "calls", "complete")] == [("a", 2, 1, 3.0)]
    events = spark.read.parquet(f"{small}/events.parquet")
    windows = _collect(spark, jobs.windows(_stream(spark, events, tmp_path / "e"), "ts", "1 day"), "windows", "complete")
    assert sum(r.n for r in windows) == events.count()


def test_ingest_archives_changes(spark, tmp_path):
    schema = "document_id string, title string, category string, markdown_content string"
    folder, source = str(tmp_path / "store"), str(tmp_path / "in")
    for content in ("eski metin", "eski metin", "yeni metin"):
        spark.createDataFrame([("a", "t", "c", content)], schema).write.mode("append").parquet(source)
        q = jobs.ingest(spark.readStream.schema(schema).parquet(source), folder, str(tmp_path / "ck"), 1.0)
        assert q.awaitTermination(180)
    assert snapshots.current(spark, f"{folder}/documents").select("markdown_content").collect() == [("yeni metin",)]
    assert [(r.version, r.markdown_content) for r in snapshots.current(spark, f"{folder}/versions").collect()] == [(1, "eski metin")]
    assert snapshots.current(spark, f"{folder}/chunks").count() == 1


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    rng = random.Random(12)
    vectors = [[float(rng.randrange(-2, 3)) for _ in range(3)] for _ in range(400)]
    rows = [(i // 2, i % 2, "c", v) for i, v in enumerate(vectors)] + [(900, 0, "c", None), (901, 0, "c", [1.0])]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_index long, category string, embedding array<float>").repartition(6)
    asked = spark.createDataFrame([(k, vectors[50 * k]) for k in range(8) if any(vectors[50 * k])] + [(99, None)] + [(100 + k, vectors[k]) for k in range(30) if any(vectors[k])], "query_id int, embedding array<float>")
    want = set()
    for k, q in ((r.query_id, r.embedding) for r in asked.collect() if r.embedding):
        norm = lambda v: sum(x * x for x in v) ** 0.5
        near = sorted((round(1 - sum(x * y for x, y in zip(v, q, strict=True)) / (norm(v) * norm(q)), 12) + 0.0, d, c) for d, c, _, v in rows[:400] if any(v))
        want |= {(k, d, c) for _, d, c in near[:20]}
    assert {(r.query_id, r.doc_id, r.chunk_index) for r in search.nearest(chunks, asked, 20, search.cosine_distances).collect()} == want


def test_places_and_those_apart(spark):
    d = spark.createDataFrame([("a.b a.b" + " " * 50 + "a.b", "a.b"), ("yok", "x"), ("", "x")], "x string, part string")
    places = reports.places_of(F.col("x"), F.col("part"))
    assert [(r.p, r.q) for r in d.select(places.alias("p"), reports.apart(places).alias("q")).collect()] == [([0, 4, 57], [0, 57]), ([], []), ([], [])]


def test_a_replayed_change_is_archived_once(spark, tmp_path, monkeypatch):
    schema = "document_id string, title string, category string, markdown_content string"
    folder, source, ck = str(tmp_path / "store"), str(tmp_path / "in"), str(tmp_path / "ck")

    def run(*rows):
        spark.createDataFrame([(i, "t", "c", x) for i, x in rows], schema).write.mode("append").parquet(source)
        return jobs.ingest(spark.readStream.schema(schema).parquet(source), folder, ck, 1.0)

    assert run(("a", "bir"), ("b", "iki")).awaitTermination(180)
    held = snapshots.Store(spark, folder)
    publish, before = snapshots.Store._publish, held.state()

    def breaks(self, state):
        raise OSError("lost")

    monkeypatch.setattr(snapshots.Store, "_publish", breaks)  # all tables are written, and then nothing says so
    with pytest.raises(Exception, match="lost"):
        run(("a", "üç")).awaitTermination(180)
    assert held.state() == before and held.read("versions") is None

    def publishes_and_breaks(self, state):
        assert publish(self, state)
        raise OSError("after")

    monkeypatch.setattr(snapshots.Store, "_publish", publishes_and_breaks)
    with pytest.raises(Exception, match="after"):
        run(("b", "iki")).awaitTermination(180)
    monkeypatch.setattr(snapshots.Store, "_publish", publish)
    assert held.state().number == before.number + 1
    assert run(("b", "iki")).awaitTermination(180)  # the batch that was committed isn't added again
    assert sorted((r.document_id, r.markdown_content) for r in held.read("documents").collect()) == [("a", "üç"), ("b", "iki")]
    assert [(r.document_id, r.version, r.markdown_content) for r in held.read("versions").collect()] == [("a", 1, "bir")]
    assert run(("a", "bir")).awaitTermination(180) and run(("a", "üç")).awaitTermination(180)
    assert sorted((r.version, r.markdown_content) for r in held.read("versions").collect()) == [(1, "bir"), (2, "üç"), (3, "bir")]
    folders = {f for f in held.state().tables["documents"].values() if f}
    assert len(folders) == 2 and len({f.split("/")[1] for f in folders}) == 2  # b's part is that of an older commit


ROWS = "document_id string, n int"


def test_two_writers_lose_nothing(spark, tmp_path):
    held = snapshots.Store(spark, f"file://{tmp_path}/s")
    part = {k: spark.createDataFrame([(k,)], "k string").select(snapshots.part_of("k")).first()[0] for k in "abcdef"}
    a, b = "a", next(k for k in "bcdef" if part[k] != part["a"])

    def adding(key, table, before=lambda: None):
        def change(state):
            old = held.read(table, ROWS, [part[key]], state)
            before()
            return {table: snapshots.Change(old.union(spark.createDataFrame([(key, old.count())], ROWS)), "document_id", (part[key],)), "other": snapshots.Change(old.limit(0), "document_id", (part[key],))}

        return change

    once = []

    def other_writer(key):
        def run():
            if not once:
                once.append(held.update(adding(key, "t")).number)

        return run

    # another part: this writer's state is the later one, and has both
    assert held.update(adding(a, "t", other_writer(b))).number == 2 and once == [1]
    assert sorted(r.document_id for r in held.read("t").collect()) == sorted([a, b])
    # the same part: the change is made again from the other's state
    once.clear()
    assert held.update(adding(a, "t", other_writer(a))).number == 4 and once == [3]
    assert sorted(r.n for r in held.read("t").where(F.col("document_id") == a).collect()) == [0, 1, 2]
    base = held.state()
    held.update(adding(a, "t"))
    with pytest.raises(snapshots.Conflict):
        held.commit(base, adding(a, "t")(base))
    # an entry that is there is never replaced, on either kind of file system
    for scheme in ("file", "other"):
        assert not _published(held, base, scheme)
    assert held.state().number == 5 and held.read("t", state=base).count() == 4


def _published(held, state, scheme):
    fs, _ = snapshots.file_system(held.spark, held.folder)

    class Named:
        def __getattr__(self, name):
            return (lambda: scheme) if name == "getScheme" else getattr(fs, name)

    file_system, snapshots.file_system = snapshots.file_system, lambda spark, path: (Named(), file_system(spark, path)[1])
    try:
        return held._publish(state)
    finally:
        snapshots.file_system = file_system


def test_old_states_expire(spark, tmp_path):
    held = snapshots.Store(spark, f"file://{tmp_path}/s")
    for i in range(4):
        held.update(lambda _, i=i: {"t": snapshots.Change(spark.createDataFrame([("a", i)], ROWS), "document_id", tuple(range(snapshots.PARTS))), "u": snapshots.Change(spark.range(i))})
    assert held.expire(keep=2, idle=3600) == 0 and held.expire(keep=2, idle=-1) == 4
    assert [r.n for r in held.read("t").collect()] == [3] and [r.n for r in held.read("t", state=held.state(3)).collect()] == [2]
    assert held.read("u").count() == 3 and held._numbers() == [3, 4]


def best_fragment(tokens, terms):
    """Every minimal interval with all terms, stretched or cut, by two pointers."""
    hits = [(p, t) for p, t in enumerate(tokens) if t in terms]
    last, before, found = {}, -1, []
    for p, t in hits:
        last[t] = p
        if len(last) == len(terms) and (b := min(last.values())) > before:
            before = b
            if p - b + 1 > 40:
                s, e = b, b + 40
            elif p - b + 1 >= 20:
                s, e = b, p + 1
            elif b + 20 <= len(tokens):
                s, e = b, b + 20
            else:
                s, e = max(0, len(tokens) - 20), len(tokens)
            found.append((-sum(s <= q < e for q, _ in hits), s, e))
    return min(found)[1:] if found else (0, 20)


def test_headlines_show_the_best_fragment(spark):
    rng = random.Random(8)
    docs = [(i, [rng.choice("abcd" + "xyz" * rng.randrange(1, 9)) for _ in range(rng.randrange(0, 160))]) for i in range(80)] + [(100, ["x"] * 30 + ["a"] + ["y"] * 60 + ["b"]), (101, ["a"]), (102, [])]
    asked = {0: ["a"], 1: ["a", "b"], 2: ["a", "b", "c"], 3: ["q"], 4: []}
    found = spark.createDataFrame([(q, i, t) for i, t in docs for q in asked], "query_id int, key int, tokens array<string>")
    terms = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "query_id int, term string")
    got = {(r.query_id, r.key): r.snippet for r in search.headlines(found, terms).collect()}
    for i, tokens in docs:
        for q, ts in asked.items():
            s, e = best_fragment(tokens, set(ts)) if ts else (0, 20)
            assert got[q, i] == " ".join(f">>>{t}<<<" if t in ts else t for t in tokens[s:e]), (q, i)


def test_headlines_gather_no_query_in_one_task(spark):
    found = spark.createDataFrame([(0, i, ["a", "x", "b"]) for i in range(9)], "query_id int, key int, tokens array<string>")
    shown = search.headlines(found, spark.createDataFrame([(0, "a"), (0, "b")], "query_id int, term string"))
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("SortMergeJoin", "ShuffledHashJoin", "Window", "NestedLoop"))
    assert {r.snippet for r in shown.collect()} == {">>>a<<< x >>>b<<<"}


def test_matches_meet_queries_by_one_term(spark):
    rng = random.Random(9)
    docs = [(i, [rng.choice("abcdef") for _ in range(rng.randrange(0, 6))]) for i in range(60)]
    asked = [(0, "a"), (1, "b a b"), (2, "f e d"), (3, "zz a"), (4, "a")]
    d = spark.createDataFrame(docs, "id int, tokens array<string>")
    for more in ([], [(5, ""), (6, " .")]):
        found = search.fts_matches(d, spark.createDataFrame(asked + more, "query_id int, query string"), "id")
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.query_id, r.id) for r in found.collect()) == sorted((q, i) for i, t in docs for q, w in asked + more if all(x in t for x in w.replace(".", "").split()))
    ranked = search.fts(d, spark.createDataFrame(asked, "query_id int, query string"), "id", threshold=None)
    assert not any(x in ranked._jdf.queryExecution().executedPlan().toString() for x in ("NestedLoop", "Cartesian"))
