"""List page and HTML queries: driver pages and injected fragments."""

from __future__ import annotations

from pyspark.sql import functions as F

from mizan.functions import directory, markdown
from mizan.operators import pages, reading
from mizan.plans.registry import query
from mizan.sources.tables import DOCS, dealt, documents, read

_INNER = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(i, '(?s)<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '[\\s\\x{A0}]+', ' ', 'g'))"
_ANCHORS = (
    "a AS (SELECT page_id, unnest(range(len(h))) AS pos, trim(unnest(h)) AS href, unnest(inn) AS i FROM (SELECT page_id, "
    "regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref=[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref=[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a>', 2) AS inn FROM pages)), "
    f"anchors AS (SELECT page_id, pos, href, {_INNER} AS text FROM a)"
)


@query(f"WITH {_ANCHORS}, f AS (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY pos) AS rn FROM anchors WHERE text <> '') SELECT page_id, pos, href, text FROM f WHERE rn = 1")
def extract_links(spark, sf_dir):
    from mizan.operators.evaluation import first_of

    found = pages.anchors(read(spark, sf_dir, "pages")).where("text <> ''").withColumn("pos", F.col("pos").cast("long"))
    return first_of(found.withColumn("k", F.struct("page_id", "href")), "k", ["pos"]).drop("k")


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<h1[^>]*>([^<]*)</h1>', 1)) AS heading, CAST(len(regexp_extract_all(html, '(?i)<p[ >]')) AS INT) AS paragraphs FROM pages")
def html_headings(spark, sf_dir):
    return pages.headings(read(spark, sf_dir, "pages"))


@query()
def html_to_markdown(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", markdown.html_to_markdown("html").alias("markdown"))


#: Pages made of parts have ids from here on.
_MADE = 1_000_000


def _with_pages(spark, sf_dir, fragments, made):
    """The driver's pages, the fragments under negative ids, and a page for every part; made: its html as a format of SQL's columns."""
    own = read(spark, sf_dir, "pages").select(F.col("page_id").cast("int").alias("page_id"), "html")
    # one row group may hold all parts; their pages are dear to read
    parts = dealt(read(spark, sf_dir, "part")).select((F.col("p_partkey") + _MADE).cast("int").alias("page_id"), F.expr(made).alias("html"))
    return own.union(spark.createDataFrame([(-1 - i, html) for i, html in enumerate(fragments)], "page_id int, html string")).union(parts)


_LIST = [
    (56, '<a href="/Mevzuat/DokumanGetir/12">(07.03.2024 - 10823) Karar bir</a><a href="/Mevzuat/DokumanGetir/13">Tarihsiz karar</a><a href="/Mevzuat/DokumanGetir/14"></a>'),
    (49, '<a href="/Mevzuat/DokumanGetir/5">Kanun</a><a href="/Mevzuat/DokumanGetir/5">Tekrar</a><a href="https://www.mevzuat.gov.tr/mevzuat?MevzuatNo=5411">Dış</a><a href="/Mevzuat/Detay/9">Ayrıntı</a><a href="mailto:x">Posta</a>'),
    (99, '<a href="/Mevzuat/DokumanGetir/6">Başka</a>'),
]


@query("SELECT * FROM (VALUES ('12', 'Karar bir', '07.03.2024', '10823', 'https://host/Mevzuat/DokumanGetir/12'), ('13', 'Tarihsiz karar', '', '', 'https://host/Mevzuat/DokumanGetir/13')) t(document_id, title, decision_date, decision_number, source_url) UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_name, CASE WHEN p_partkey % 2 = 0 THEN '07.03.2024' ELSE '' END, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END, 'https://host/Mevzuat/DokumanGetir/' || p_partkey FROM part")
def decision_pages(spark, sf_dir):
    p = _with_pages(spark, sf_dir, [_LIST[0][1]], "'<p><a href=\"/Mevzuat/DokumanGetir/' || p_partkey || '\">' || IF(p_partkey % 2 = 0, '(07.03.2024 - ' || p_size || ') ', '') || p_name || '</a><a href=\"/Mevzuat/DokumanGetir/0\"> </a>'")
    return pages.decisions(pages.anchors(p), "Karar", "https://host/Mevzuat/DokumanGetir/{}").select("document_id", "title", "decision_date", "decision_number", "source_url")


@query("SELECT * FROM (VALUES (-1, '5', 'Kanun', 'Kanun', 'https://host/Mevzuat/DokumanGetir/5'), (-1, 'mevzuat_5411', 'Dış', 'Kanun', 'https://www.mevzuat.gov.tr/mevzuat?MevzuatNo=5411'), (-2, '6', 'Başka', 'Sayfa -2', 'https://host/Mevzuat/DokumanGetir/6')) t(page_id, document_id, title, category, source_url) UNION ALL SELECT CAST(p_partkey + 1000000 AS INT), CAST(p_partkey AS VARCHAR), p_name, 'Sayfa ' || (p_partkey + 1000000), 'https://host/Mevzuat/DokumanGetir/' || p_partkey FROM part UNION ALL SELECT CAST(p_partkey + 1000000 AS INT), 'mevzuat_' || p_partkey, p_brand, 'Sayfa ' || (p_partkey + 1000000), 'https://www.mevzuat.gov.tr/mevzuat?MevzuatNo=' || p_partkey FROM part")
def flat_pages(spark, sf_dir):
    link = "'<a href=\"/Mevzuat/DokumanGetir/' || p_partkey || '\">' || {} || '</a>'"
    made = " || ".join([link.format("p_name"), link.format("'Tekrar'"), "'<a href=\"https://www.mevzuat.gov.tr/mevzuat?MevzuatNo=' || p_partkey || '\">' || p_brand || '</a><a href=\"/Mevzuat/Detay/1\">Ayrıntı</a>'"])
    p = _with_pages(spark, sf_dir, [html for _, html in _LIST[1:]], made)
    return pages.flat_pages(p, "https://host", {-1: "Kanun"}).select("page_id", "document_id", "title", "category", "source_url")


_CARDS = '<div class="card"><h5>Tebliğler (2)</h5><div class="card-body"><ul><li><a href="/Mevzuat/DokumanGetir/1">Bir</a><li><a href="/Mevzuat/DokumanGetir/2">İki</a></ul></div></div><div class="card"><h5>Diğer</h5><div class="collapse"><a href="/Mevzuat/DokumanGetir/3">Üç</a></div></div>'


@query("SELECT * FROM (VALUES ('1', 'Bir', 'Tebliğ'), ('2', 'İki', 'Tebliğ'), ('3', 'Üç', 'Diğer')) t(document_id, title, category) UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_name, p_brand FROM part UNION ALL SELECT CAST(p_partkey + 5000 AS VARCHAR), p_type, 'Tebliğ' FROM part")
def accordion_pages(spark, sf_dir):
    card = "'<div class=\"card\"><h5>' || {} || ' (' || p_size || ')</h5><div class=\"card-body\"><ul><li><a href=\"/Mevzuat/DokumanGetir/' || {} || '\">' || {} || '</a></ul></div></div>'"
    p = _with_pages(spark, sf_dir, [_CARDS], card.format("p_brand", "p_partkey", "p_name") + " || " + card.format("'Tebliğler'", "(p_partkey + 5000)", "p_type"))
    return pages.accordion_pages(p, "https://host", {"Tebliğler": "Tebliğ"}).select("document_id", "title", "category")


_BANKS = '<div class="card"><h5>Mevduat Bankaları (2)</h5><div class="card-body"><ul><li>1. Birinci Banka A.Ş. <a href="https://b.example">web</a> Detay</li><li>2. Yeni Dijital Banka</li></ul></div></div><div class="card"><h5>TMSF Bankaları</h5><div class="card-body"><li>Eski Banka</li></div></div>'


@query("SELECT * FROM (VALUES ('Birinci Banka A.Ş.', 'https://b.example', 'Mevduat Bankaları', 'Aktif', false), ('Yeni', '', 'Mevduat Bankaları', 'Aktif', true), ('Eski Banka', '', 'TMSF Bankaları', 'İptal Edilmiş', false)) t(name, website, subcategory, status, digital) UNION ALL SELECT p_name, 'https://b' || p_partkey || '.example', p_type, 'Aktif', false FROM part")
def institution_pages(spark, sf_dir):
    made = "'<div class=\"card\"><h5>' || p_type || ' (1)</h5><div class=\"card-body\"><ul><li>' || p_size || '. ' || p_name || ' <a href=\"https://b' || p_partkey || '.example\">web</a> Detay</li></ul></div></div>'"
    p = _with_pages(spark, sf_dir, [_BANKS], made).withColumn("kind", F.lit("Banka"))
    return p.select(F.explode(directory.html_institutions("html", "kind")).alias("i")).select("i.*")


_NEWS = '<a href="/Duyuru/Detay/1"><span class="gorunenTarih">01.02.2024</span><span class="text">Yeni duyuru 01.02.2024</span></a><a href="/Duyuru/Detay/2">Başlık</a><a href="/x">Yok</a>'


@query("SELECT * FROM (VALUES ('Yeni duyuru', '01.02.2024', 'https://host/Duyuru/Detay/1'), ('Başlık', '', 'https://host/Duyuru/Detay/2')) t(title, date, url) UNION ALL SELECT p_name, '01.02.2024', 'https://host/Duyuru/Detay/' || p_partkey FROM part UNION ALL SELECT p_brand, '', 'https://other.example/Duyuru/Detay/' || p_size FROM part")
def announcement_pages(spark, sf_dir):
    made = "'<a href=\"/Duyuru/Detay/' || p_partkey || '\"><span class=\"gorunenTarih\">01.02.2024</span><span class=\"text\">' || p_name || ' 01.02.2024</span></a><a href=\"https://other.example/Duyuru/Detay/' || p_size || '\">' || p_brand || '</a>'"
    return pages.announcements(_with_pages(spark, sf_dir, [_NEWS], made), "https://host").select("title", "date", "url")


_TABLE = "<table><tr><td>1</td><td>Krediler <a onclick=\"ShowModalGraph('1.0.1')\">g</a></td><td>10</td><td>20</td></tr><tr><td>2</td><td>Yok</td><td>1</td><td>2</td></tr></table>"


@query("SELECT '1' AS row_number, 'Krediler g' AS name, '1.0.1' AS metric_id, '10' AS tp, '20' AS yp UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_name || ' g', '2.' || p_size, CAST(p_size AS VARCHAR), CAST(p_size * 2 AS VARCHAR) FROM part")
def snapshot_page(spark, sf_dir):
    made = "'<table><tr><td>' || p_partkey || '</td><td><b>' || p_name || '</b> <a onclick=\"ShowModalGraph(\\'2.' || p_size || '\\')\">g</a></td><td>' || p_size || '</td><td>' || p_size * 2 || '</td></tr><tr><td>1</td><td>2</td><td>3</td><td>4</td></tr></table>'"
    return pages.snapshot_rows(_with_pages(spark, sf_dir, [_TABLE], made)).select("row_number", "name", "metric_id", "tp", "yp")


@query("SELECT p_name AS name, '1,0' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS tp, p_size || '.50' AS yp, '-' AS total FROM part")
def monthly_json(spark, sf_dir):
    """A payload for every part: one row of cells, and one that is too short."""
    size = F.col("p_size").cast("int")
    cells = F.array(F.lit("g"), F.lit("1"), F.col("p_name"), F.lit("b"), (size + 1000).cast("string"), F.format_string("%d.5", size), F.lit("-"))
    rows = F.array(F.struct(cells.alias("cell")), F.struct(F.array(F.lit("x")).alias("cell")))
    body = F.to_json(F.struct(F.lit(True).alias("success"), F.struct(F.struct(rows.alias("rows")).alias("data")).alias("Json")))
    return pages.monthly_rows(read(spark, sf_dir, "part").select(body.alias("payload"))).select("name", "tp", "yp", "total")


@query("SELECT * FROM (VALUES (-1, '/frame.htm', NULL), (-2, NULL, repeat('x', 120)), (-3, NULL, NULL)) t(id, src, content) UNION ALL SELECT page_id, NULL, NULL FROM pages WHERE NOT contains(html, '<iframe') AND NOT contains(html, 'icerik') UNION ALL SELECT p_partkey + 1000000, CASE WHEN p_partkey % 2 = 0 THEN '/frame' || p_partkey || '.htm' END, CASE WHEN p_partkey % 2 = 1 AND p_size > 20 THEN repeat('x', CAST(80 + p_size AS INT)) END FROM part")
def iframe_layer(spark, sf_dir):
    rows = [(0, '<iframe src="/frame.htm"></iframe>'), (1, f'<div id="icerik">{"x" * 120}</div>'), (2, '<div id="icerik">kısa</div>')]
    made = "IF(p_partkey % 2 = 0, '<iframe src=\"/frame' || p_partkey || '.htm\"></iframe>', '<div id=\"icerik\">' || repeat('x', int(80 + p_size)) || '</div>')"
    return _with_pages(spark, sf_dir, [html for _, html in rows], made).select(F.col("page_id").alias("id"), pages.iframe_or_content(F.col("html")).alias("f")).select("id", "f.*")


@query(
    "SELECT CAST(doc_id AS VARCHAR) AS requested, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'b_' END || doc_id AS document_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS source, CASE WHEN doc_id % 3 = 0 THEN 's' ELSE 'c' END || doc_id AS content "
    "FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0"
)
def document_alias_resolution(spark, sf_dir):
    """Of every document's id, of which some have chunks under a prefix, some a stored text, some both or none."""
    from mizan.operators.search import resolve_aliases

    d = read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("requested"))
    chunks = d.where("doc_id % 2 = 0").select(F.concat(F.lit("b_"), "requested").alias("document_id"), F.concat(F.lit("c"), "requested").alias("content"))
    docs = d.where("doc_id % 3 = 0").select(F.col("requested").alias("document_id"), F.concat(F.lit("s"), "requested").alias("content"))
    return resolve_aliases(d.select("requested"), [chunks, docs], ("a_", "b_"))


_BLANK = "regexp_replace({}, '[\\s\\p{{Z}}]+', '', 'g') = ''"
_IMAGES = "len(regexp_extract_all(body, '!\\[[^\\]]*\\]\\([^)]+\\)'))"


@query(
    f"WITH {DOCS}, p AS (SELECT document_id, markdown_content AS x, unnest(range(CAST(greatest(1, ceil(length(markdown_content) / 5000.0)) AS INT))) AS k FROM docs), b AS (SELECT document_id, substring(x, k * 5000 + 1, 5000) AS body FROM p), "
    f"r AS (SELECT CASE WHEN {_BLANK.format('body')} THEN 'empty' WHEN contains(substring(body, 1, 200), 'Invalid page') THEN 'invalid' ELSE 'passed' END AS class, document_id, count(*) AS pages, sum({_IMAGES}) AS images FROM b GROUP BY 1, 2) "
    "SELECT class, CAST(sum(pages) AS BIGINT) AS pages, count(*) AS documents, CAST(sum(images) AS BIGINT) AS images, count(*) FILTER (WHERE images > 0) AS with_images FROM r GROUP BY 1"
)
def audit_pages(spark, sf_dir):
    return reading.page_audit(documents(spark, sf_dir))


@query(
    f"WITH {DOCS}, a AS (SELECT document_id FROM docs UNION ALL SELECT 'none' || user_id FROM events WHERE event_id < 7), r AS (SELECT CASE WHEN markdown_content IS NULL THEN 'missing' WHEN {_BLANK.format('markdown_content')} THEN 'empty' ELSE 'passed' END AS class, length(markdown_content) AS n FROM a LEFT JOIN docs USING (document_id)), "
    "s AS (SELECT list_sort(list(n) FILTER (WHERE class = 'passed')) AS l, count(*) FILTER (WHERE class = 'passed') AS passed, count(*) FILTER (WHERE class = 'empty') AS empty, count(*) FILTER (WHERE class = 'missing') AS missing FROM r) "
    "SELECT passed, empty, missing, l[1] AS least, l[len(l) // 2 + 1] AS middle, l[len(l)] AS most FROM s"
)
def audit_documents(spark, sf_dir):
    d = documents(spark, sf_dir)
    asked = d.select("document_id").unionByName(read(spark, sf_dir, "events").where("event_id < 7").select(F.concat(F.lit("none"), "user_id").alias("document_id")))
    return reading.document_audit(d, asked)


_SETTINGS = [(-1, """<form><input type="hidden" name="__RequestVerificationToken" value="abc"/></form><script>x = {"tarih": '27.03.2026'}</script>""")]


@query("SELECT page_id, '' AS token, '' AS date FROM pages UNION ALL SELECT -1, 'abc', '27.03.2026' UNION ALL SELECT p_partkey + 1000000, CASE WHEN p_size > 10 THEN 't' || p_partkey ELSE '' END, lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') || '.03.2026' FROM part")
def bulletin_settings(spark, sf_dir):
    made = "'<form><input name=\"' || IF(p_size > 10, '__RequestVerificationToken', 'other') || '\" type=\"hidden\" value=\"t' || p_partkey || '\"/></form><script>x = {\"tarih\": \\'' || lpad(p_size % 28 + 1, 2, '0') || '.03.2026\\'}</script>'"
    p = _with_pages(spark, sf_dir, [html for _, html in _SETTINGS], made)
    return p.select("page_id", pages.bulletin_settings(F.col("html")).alias("s")).select("page_id", "s.*")
