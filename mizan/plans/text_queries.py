"""Text function queries: driver documents and injected rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from mizan.functions import markup, text, urls
from mizan.functions.text import ACCENTS, C1_TO_PRINTABLE, SUFFIXES
from mizan.operators import extraction, reports, search
from mizan.plans.registry import query
from mizan.sources import validation
from mizan.sources.tables import DOCS, documents, read

FOLD = "lower(translate({}, 'İIŞÇÜÖĞ', 'iışçüöğ'))"
STEM = "regexp_replace({}, '^(.{{3,}}?)(" + "|".join(SUFFIXES) + ")$', '\\1')"
WORDS = ["BANKALAR", "ALAR", "İSTANBUL", "IŞIK", "Şirketlerin", "ÇOCUKLARDAN", "ÜLKEDE", "ÖĞRENCİLERİN", "kredinin", "faizde", "ka", "kada", "karda", "mevzuatta", "tebliğler", "yönetmelikten"]


def quoted(values) -> str:
    return ", ".join("(" + "'" + v.replace("'", "''") + "')" for v in values)


@query(
    f"WITH w AS (SELECT DISTINCT unnest(string_split_regex(text, '[^\\p{{L}}]+')) AS word FROM documents UNION SELECT * FROM (VALUES {quoted(WORDS)}) t(word)) "
    f"SELECT word, {FOLD.format('word')} AS folded, {STEM.format(FOLD.format('word'))} AS stem FROM w WHERE word <> ''"
)
def turkish_fold_stem(spark, sf_dir):
    own = read(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[^\p{L}]+")).alias("word"))
    w = own.union(spark.createDataFrame([(x,) for x in WORDS], "word string")).distinct().where("word <> ''")
    folded = text.lower_tr(F.col("word"))
    return w.select("word", folded.alias("folded"), text.stem_tr(folded).alias("stem"))


DATES = ["31.10.2024", "31/10/2024", "1.3.2024", "31.02.2024", "", "belirsiz", "07/1/1999"]


@query(
    f"WITH d AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE 'yok' END AS x FROM orders UNION ALL SELECT -1, x FROM (VALUES {quoted(DATES)}) t(x)) "
    "SELECT o_orderkey, x, CAST(coalesce(try_strptime(x, '%d.%m.%Y'), try_strptime(x, '%d/%m/%Y')) AS DATE) AS parsed FROM d"
)
def date_parse(spark, sf_dir):
    x = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise("yok")
    d = read(spark, sf_dir, "orders").select("o_orderkey", x.alias("x")).union(spark.createDataFrame([(-1, v) for v in DATES], "o_orderkey long, x string"))
    return d.select("o_orderkey", "x", text.parse_date(F.col("x")).alias("parsed"))


@query(
    "WITH d AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE 'yok' END AS x FROM orders), "
    "p AS (SELECT *, CAST(coalesce(try_strptime(x, '%d.%m.%Y'), try_strptime(x, '%d/%m/%Y')) AS DATE) AS parsed FROM d) SELECT o_orderkey, x FROM p WHERE parsed BETWEEN DATE '1998-01-01' AND DATE '1998-03-31'"
)
def date_range(spark, sf_dir):
    x = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise("yok")
    return read(spark, sf_dir, "orders").select("o_orderkey", x.alias("x")).where(search.in_period(F.col("x"), "1.1.1998", "31/03/1998"))


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_type <> 'ECONOMY' AND NOT contains(lower(p_name), 'red')")
def scope_filter(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return p.where(search.in_scope(F.col("p_name"), F.col("p_type"), ("ECONOMY",), ("Red",)))


DIRTY = ["temiz metin", "Đstanbul ve Đzmir", "sayfa\u000csonu", "tire \u0096 ve \u0093alıntı\u0094", "bozuk � harf", "resim <img src=x>", "noktalar ..........", "kelimeBirleşik", "formül var", "$$x$$ formül", "kısa"]
_DIRTY_SQL = "(VALUES " + ", ".join("(" + str(i) + ", '" + v + "')" for i, v in enumerate(DIRTY)) + ") t(i, x)"


def texts_sql(values) -> str:
    """SQL of the relation of _texts, as CTE x."""
    rows = ", ".join("(" + str(-1 - i) + ", '" + v.replace("'", "''") + "')" for i, v in enumerate(values))
    return f"x AS (SELECT doc_id AS id, text AS x FROM documents UNION ALL SELECT * FROM (VALUES {rows}) t(id, x))"


def _texts(spark, sf_dir, values):
    """All documents, and the values under negative ids."""
    own = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("x"))
    return own.union(spark.createDataFrame([(-1 - i, v) for i, v in enumerate(values)], "id long, x string"))


@query(f"WITH {texts_sql(DIRTY)} SELECT id, translate(x, 'Đ' || chr(12), 'İ') AS clean, translate(x, '{''.join(map(chr, C1_TO_PRINTABLE))}', '{''.join(C1_TO_PRINTABLE.values())}') AS remapped FROM x")
def sanitize_text(spark, sf_dir):
    d = _texts(spark, sf_dir, DIRTY)
    return d.select("id", text.sanitize(F.col("x")).alias("clean"), text.remap_c1(F.col("x")).alias("remapped"))


_CORRUPT = f"{DOCS}, x AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'mevzuat_' ELSE '' END || document_id AS document_id, markdown_content, CASE WHEN doc_id % 17 = 0 THEN 'markitdown_degraded' ELSE extraction_method END AS method FROM docs UNION ALL SELECT 'mevzuat_x' || i, x, 'html' FROM {_DIRTY_SQL} UNION ALL SELECT 'y' || i, x, 'html' FROM {_DIRTY_SQL})"
_SIGNATURE = (
    "CASE WHEN contains(markdown_content, 'Đ') THEN 'i_garble' WHEN contains(markdown_content, chr(12)) THEN 'form_feeds' WHEN regexp_matches(markdown_content, '[\\x{80}-\\x{9F}]') THEN 'c1_controls' "
    "WHEN NOT document_id LIKE 'mevzuat_%' THEN NULL WHEN contains(markdown_content, chr(65533)) THEN 'ufffd' WHEN contains(markdown_content, '<img') THEN 'leaked_img' "
    "WHEN length(markdown_content) < 500 THEN 'too_short' WHEN method = 'markitdown_degraded' THEN 'markitdown_degraded' END"
)


def _corrupt(spark, sf_dir):
    d = documents(spark, sf_dir)
    own = d.select(
        F.concat(F.when(F.col("doc_id") % 2 == 0, "mevzuat_").otherwise(""), "document_id").alias("document_id"), "markdown_content", F.when(F.col("doc_id") % 17 == 0, "markitdown_degraded").otherwise(F.col("extraction_method")).alias("method")
    )
    dirty = spark.createDataFrame([(f"{p}{i}", x, "html") for p in ("mevzuat_x", "y") for i, x in enumerate(DIRTY)], own.schema)
    return own.union(dirty)


@query(f"WITH {_CORRUPT}, s AS (SELECT document_id, length(markdown_content) AS len, {_SIGNATURE} AS signature FROM x) SELECT document_id, CAST(len AS INT) AS len, signature FROM s WHERE signature IS NOT NULL")
def corruption_signatures(spark, sf_dir):
    s = _corrupt(spark, sf_dir).select("document_id", F.length("markdown_content").alias("len"), markup.corruption(F.col("document_id"), F.col("markdown_content"), F.col("method")).alias("signature"))
    return s.where("signature IS NOT NULL")


@query(f"WITH {_CORRUPT}, s AS (SELECT {_SIGNATURE} AS signature FROM x) SELECT signature, count(*) AS n FROM s WHERE signature IS NOT NULL GROUP BY 1")
def corruption_counts(spark, sf_dir):
    return corruption_signatures(spark, sf_dir).groupBy("signature").agg(F.count("*").alias("n"))


ANOMALIES = {
    "replacement_char": "contains(markdown_content, chr(65533))",
    "leaked_img_tag": "regexp_matches(markdown_content, '(?i)<img[\\s>]')",
    "leaked_html_block": "regexp_matches(markdown_content, '(?i)<(div|table|tr|td)[\\s>]')",
    "short_content": "length(markdown_content) < 500",
    "long_dot_run": "regexp_matches(markdown_content, '\\.{10,}')",
    "camelcase_concat": "regexp_matches(markdown_content, '[a-zçğıöşü][A-ZÇĞİÖŞÜ]')",
    "formula_ref_without_formula": "regexp_matches(markdown_content, '(?i)formül') AND NOT contains(markdown_content, '$$')",
    "diacritic_outlier": "length(markdown_content) > 1000 AND (length(markdown_content) - length(regexp_replace(markdown_content, '[çğıöşüÇĞİÖŞÜ]', '', 'g'))) / nullif(length(regexp_replace(markdown_content, '[^A-Za-zÇĞİÖŞÜçğıöşü]', '', 'g')), 0) < 0.06",
}


@query(
    f"WITH {_CORRUPT} " + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS docs_flagged, list(document_id ORDER BY document_id)[:5] AS sample_doc_ids FROM x WHERE {p} HAVING count(*) > 0" for n, p in ANOMALIES.items())
)
def anomaly_scan(spark, sf_dir):
    """One pass: each document's anomalies, then counts and the first ids of each."""
    x = _corrupt(spark, sf_dir)
    flags = markup.anomalies(F.col("markdown_content"))
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))
    hits = x.select("document_id", F.explode_outer(names).alias("name")).where("name IS NOT NULL")
    # flagged ids are dealt once, and both branches read them there: texts are scanned once
    hits = hits.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "name", "document_id")
    counts = hits.groupBy("name").agg(F.count("*").alias("docs_flagged"))
    from pyspark.sql import Window

    first = hits.withColumn("rn", F.row_number().over(Window.partitionBy("name").orderBy("document_id"))).where("rn <= 5")
    samples = first.groupBy("name").agg(F.array_sort(F.collect_list("document_id")).alias("sample_doc_ids"))
    return counts.join(samples, "name").select("name", "docs_flagged", "sample_doc_ids")


LATEX = ["$$a$$ ve $b$", "$$a$$ $$", r"\begin{x}\end{y}\begin{x}", "$a", r"\$5 $a$", "düz metin", r"\frac{a}{b} x_{i} y^{2}"]
_LATEX_ROWS = texts_sql(LATEX)
_BEGIN, _END = ("list_sort(regexp_extract_all(x, '\\\\" + w + "\\{([^}]+)\\}', 1))" for w in ("begin", "end"))


def _latex(spark, sf_dir):
    return _texts(spark, sf_dir, LATEX)


@query(
    f"WITH {_LATEX_ROWS}, c AS (SELECT id, len(regexp_extract_all(x, '\\$\\$')) AS blocks, {_BEGIN} = {_END} AS balanced, "
    "len(regexp_extract_all(replace(replace(x, '$$', ''), '\\$', ''), '\\$')) AS inlines FROM x) SELECT id, CAST(blocks % 2 + (inlines % 2) AS INT) AS odd, balanced FROM c"
)
def latex_validate(spark, sf_dir):
    issues = markup.latex_issues(F.col("x"))
    odd = F.size(F.filter(issues, lambda i: i.startswith("odd")))
    return _latex(spark, sf_dir).select("id", odd.alias("odd"), (F.size(issues) == odd).alias("balanced"))


@query(
    f"WITH {_LATEX_ROWS} SELECT id, CAST(len(regexp_extract_all(x, '(?i)<form>\\s*</form>')) AS INT) AS form_drops, CAST(len(regexp_extract_all(x, '" + "|".join(markup.LATEX_MARKERS) + "')) AS INT) AS latex_markers, "
    "CAST(len(regexp_extract_all(x, '!\\[[^\\]]*\\]\\([^)]+\\)')) + len(regexp_extract_all(x, '(?i)<img\\s+[^>]*src=[^>]+>')) AS INT) AS image_refs FROM x"
)
def text_metrics(spark, sf_dir):
    return _latex(spark, sf_dir).select("id", markup.text_metrics(F.col("x")).alias("m")).select("id", "m.*")


def drops_sql(x: str) -> str:
    return f"len(regexp_extract_all(coalesce({x}, ''), '(?i)<form>\\s*</form>'))"


def markers_sql(x: str) -> str:
    return f"len(regexp_extract_all(coalesce({x}, ''), '{'|'.join(markup.LATEX_MARKERS)}'))"


def _references(x: str) -> str:
    return f"(len(regexp_extract_all(coalesce({x}, ''), '!\\[[^\\]]*\\]\\([^)]+\\)')) + len(regexp_extract_all(coalesce({x}, ''), '(?i)<img\\s+[^>]*src=[^>]+>')))"


@query(
    "WITH r AS (SELECT doc_id + 100 AS id, text AS before, replace(text, '_{', '{') AS after, CAST(doc_id % 3 AS INT) AS images FROM documents UNION ALL SELECT * FROM (VALUES (1, 'x', '<form></form>', 0), (2, 'x', '\\frac', 3), (3, '\\sum \\sum', '\\sum', 1), (4, NULL, '![a](b)', 1)) t(id, before, after, images)) "
    f"SELECT id, {drops_sql('after')} > {drops_sql('before')} OR {markers_sql('after')} < {markers_sql('before')} AS regression, images > {_references('after')} + {markers_sql('after')} AS silent_drop FROM r"
)
def regression_compare(spark, sf_dir):
    rows = [(1, "x", "<form></form>", 0), (2, "x", r"\frac", 3), (3, r"\sum \sum", r"\sum", 1), (4, None, "![a](b)", 1)]
    own = read(spark, sf_dir, "documents").select((F.col("doc_id") + 100).alias("id"), F.col("text").alias("before"), F.replace("text", F.lit("_{"), F.lit("{")).alias("after"), (F.col("doc_id") % 3).cast("int").alias("images"))
    d = own.union(spark.createDataFrame(rows, "id long, before string, after string, images int"))
    b, a = markup.text_metrics(F.col("before")), markup.text_metrics(F.col("after"))
    return d.select("id", markup.regressed(b, a).alias("regression"), markup.silent_drop(F.col("images"), a).alias("silent_drop"))


FORMULAS = [
    ("aşağıdaki formül kullanılır.\nFormülde, x", ""),
    ("aşağıdaki formül $$a=b$$ Formülde, x", ""),
    ("Formülde:\n\n- x ifade eder", "manual_latex"),
    ("$$a=b$$\nFormülde,\n- x", ""),
    ("bak _dosyalar/image001.gif ve _dosyalar/image002.png", "html"),
    ("\n      : tanım\nmetin", "html"),
    ("düz", "html"),
]


#: Documents: S2 and S5 need the word that no document without it can have; those with it have no SQL here.
_SIGNALS = (
    "d AS (SELECT doc_id AS id, CASE WHEN contains(lower(text), 'formül') THEN NULL ELSE 0 END AS w, CAST(len(regexp_extract_all(text, '_dosyalar/image[0-9]+\\.(?:gif|png)')) AS INT) AS S3, CAST(len(regexp_extract_all(text, '(?m)^\\s{5,}:\\s+\\S')) AS INT) AS S4 FROM documents), "
    "e AS (SELECT id, CAST(S3 + S4 + w > 0 AS INT) AS S1, w AS S2, S3, S4, w AS S5 FROM d), "
    "f AS (SELECT *, S1 + 3 * S2 + 5 * S3 + S4 + 3 * S5 AS score FROM e UNION ALL SELECT * FROM (VALUES (-1, 1, 1, 0, 0, 0, 4), (-2, 0, 0, 0, 0, 0, 0), (-3, 0, 0, 0, 0, 1, 3), (-4, 0, 0, 0, 0, 0, 0), (-5, 1, 0, 2, 0, 0, 11), (-6, 1, 0, 0, 1, 0, 2), (-7, 0, 0, 0, 0, 0, 0)) t(id, S1, S2, S3, S4, S5, score))"
)


def _formulas(spark, sf_dir):
    own = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("x"), F.col("lang").alias("method"))
    return own.union(spark.createDataFrame([(-1 - i, *r) for i, r in enumerate(FORMULAS)], "id long, x string, method string"))


@query(f"WITH {_SIGNALS} SELECT * FROM f")
def dropped_formulas(spark, sf_dir):
    return _formulas(spark, sf_dir).select("id", markup.formula_signals(F.col("x"), F.col("method")).alias("s")).select("id", "s.*")


@query(f"WITH {_SIGNALS} SELECT CAST(id AS VARCHAR) AS document_id, * EXCLUDE (id) FROM f WHERE score >= 2 ORDER BY score DESC, document_id")
def formula_inventory(spark, sf_dir):
    d = _formulas(spark, sf_dir).select(F.col("id").cast("string").alias("document_id"), F.col("x").alias("markdown_content"), F.col("method").alias("extraction_method"))
    return reports.formula_inventory(d, 2)


ADDRESSES = [
    "https://www.mevzuat.gov.tr/mevzuat?MevzuatNo=5411&MevzuatTur=1&MevzuatTertip=5", "https://www.mevzuat.gov.tr/Metin.Aspx?MevzuatKod=7.5.12345", "https://www.mevzuat.gov.tr/x?MevzuatKod=7.5",
    "https://example.com/?MevzuatNo=1", "", "https://www.mevzuat.gov.tr/x?MevzuatNo=9&MevzuatTur=77",
]


_MADE = "'{}/mevzuat?MevzuatNo=' || p_partkey || '&MevzuatTur=' || CASE WHEN p_partkey % 2 = 0 THEN '1' ELSE '7' END || '&MevzuatTertip=' || p_size"


def _addresses(spark):
    return spark.createDataFrame([(i, a) for i, a in enumerate(ADDRESSES)], "id int, url string")


@query("SELECT * FROM (VALUES (0, 'mevzuat_5411'), (1, 'mevzuat_12345'), (2, NULL), (3, NULL), (4, NULL), (5, 'mevzuat_9')) t(id, document_id) UNION ALL SELECT CAST(page_id + 100 AS INT), CASE WHEN contains(url, 'mevzuat.gov.tr') THEN '?' END FROM pages UNION ALL SELECT CAST(p_partkey + 1000000 AS INT), 'mevzuat_' || p_partkey FROM part")
def url_ids(spark, sf_dir):
    return _all_addresses(spark, sf_dir).select("id", urls.external_id(F.col("url")).alias("document_id"))


def _all_addresses(spark, sf_dir):
    more = read(spark, sf_dir, "pages").select((F.col("page_id") + 100).cast("int").alias("id"), "url")
    made = read(spark, sf_dir, "part").select((F.col("p_partkey") + 1_000_000).cast("int").alias("id"), F.expr(_MADE.format("https://www.mevzuat.gov.tr")).alias("url"))
    return _addresses(spark).union(more).union(made)


@query("SELECT * FROM (VALUES (0, '5411', '1', '5'), (1, '12345', '7', '5'), (2, '', '7', '5'), (3, '1', '7', '5'), (4, '', '7', '5'), (5, '9', '77', '5')) t(id, number, type, part) UNION ALL SELECT CAST(page_id + 100 AS INT), '', '7', '5' FROM pages UNION ALL SELECT CAST(p_partkey + 1000000 AS INT), CAST(p_partkey AS VARCHAR), CASE WHEN p_partkey % 2 = 0 THEN '1' ELSE '7' END, CAST(p_size AS VARCHAR) FROM part")
def url_params(spark, sf_dir):
    return _all_addresses(spark, sf_dir).select("id", urls.parameters(F.col("url")).alias("p")).select("id", "p.*")


_BASE = "https://www.mevzuat.gov.tr"


@query(
    f"SELECT * FROM (VALUES (0, '{_BASE}/MevzuatMetin/kanun/1.5.5411.pdf', '{_BASE}/File/GeneratePdf?mevzuatNo=5411&mevzuatTur=Kanun&mevzuatTertip=5', '{_BASE}/MevzuatMetin/kanun/1.5.5411.doc'), "
    f"(1, '{_BASE}/MevzuatMetin/yonetmelik/7.5.12345.pdf', '{_BASE}/File/GeneratePdf?mevzuatNo=12345&mevzuatTur=Yonetmelik&mevzuatTertip=5', '{_BASE}/MevzuatMetin/yonetmelik/7.5.12345.doc'), "
    f"(5, NULL, NULL, '{_BASE}/MevzuatMetin/yonetmelik/77.5.9.doc')) t(id, pdf, generated, doc) "
    f"UNION ALL SELECT CAST(page_id + 100 AS INT), '{_BASE}/MevzuatMetin/yonetmelik/7.5..pdf', '{_BASE}/File/GeneratePdf?mevzuatNo=&mevzuatTur=Yonetmelik&mevzuatTertip=5', '{_BASE}/MevzuatMetin/yonetmelik/7.5..doc' FROM pages "
    f"UNION ALL SELECT CAST(p_partkey + 1000000 AS INT), '{_BASE}/MevzuatMetin/' || s || '.pdf', '{_BASE}/File/GeneratePdf?mevzuatNo=' || p_partkey || '&mevzuatTur=' || CASE WHEN p_partkey % 2 = 0 THEN 'Kanun' ELSE 'Yonetmelik' END || '&mevzuatTertip=' || p_size, '{_BASE}/MevzuatMetin/' || s || '.doc' "
    "FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'kanun/1.' ELSE 'yonetmelik/7.' END || p_size || '.' || p_partkey AS s FROM part)"
)
def url_builders(spark, sf_dir):
    p = urls.parameters(F.col("url"))
    args = (p["number"], p["type"], p["part"])
    return _all_addresses(spark, sf_dir).where("id IN (0, 1, 5) OR id >= 100").select("id", urls.pdf_url(*args).alias("pdf"), urls.generated_pdf_url(*args).alias("generated"), urls.doc_url(*args).alias("doc"))


@query(f"SELECT * FROM (VALUES ('12', 'https://host/get/12'), ('mevzuat_5411', '{_BASE}/MevzuatMetin/kanun/1.5.5411.pdf'), ('mevzuat_8', '{_BASE}/MevzuatMetin/yonetmelik/7.5.8.pdf')) t(document_id, url) UNION ALL SELECT CASE WHEN page_id % 2 = 0 THEN 'mevzuat_' ELSE '' END || page_id, CASE WHEN page_id % 2 = 0 THEN '{_BASE}/MevzuatMetin/yonetmelik/7.5.' || page_id || '.pdf' ELSE 'https://host/get/' || page_id END FROM pages")
def resolve_urls(spark, sf_dir):
    d = spark.createDataFrame([("12", None), ("mevzuat_5411", ADDRESSES[0]), ("mevzuat_8", None)], "document_id string, source_url string")
    d = d.union(read(spark, sf_dir, "pages").select(F.concat(F.when(F.col("page_id") % 2 == 0, "mevzuat_").otherwise(""), F.col("page_id").cast("string")), "url"))
    return d.select("document_id", urls.resolve(F.col("document_id"), F.col("source_url"), "https://host/get/{}").alias("url"))


_ERRORS = ["<p>404 - Sayfa Bulunamad&#x131;</p>", "Mevzuat T&uuml;r&#252;Kanunlar", "Bankacılık Kanunu", "", "&#52;04 - Sayfa Bulunamadi &amp;"]


@query(f"WITH {texts_sql(_ERRORS)} SELECT id, CASE WHEN id < 0 THEN id IN (-1, -2, -5) ELSE " + " OR ".join(f"contains(x, '{t}')" for t in text.ERROR_PAGE_TEXTS) + " END AS error_page FROM x")
def error_pages(spark, sf_dir):
    return _texts(spark, sf_dir, _ERRORS).select("id", text.is_error_page(F.col("x")).alias("error_page"))


_DUMPS = ["title: x\n---\n  \n gövde", "başlıksız", "a\n---\nson"]


@query(f"WITH {texts_sql(_DUMPS)} SELECT id, CASE WHEN contains(x, chr(10) || '---' || chr(10)) THEN regexp_replace(substring(x, instr(x, chr(10) || '---' || chr(10)) + 5), '^\\s+', '') ELSE x END AS body FROM x")
def dump_header(spark, sf_dir):
    return _texts(spark, sf_dir, _DUMPS).select("id", text.strip_dump_header(F.col("x")).alias("body"))


@query(f"WITH {DOCS} SELECT document_id, lower(extraction_method) IN ('de', 'fr') AS formula_aware, extraction_method <> '' AND NOT lower(extraction_method) IN ('de', 'fr') AS degraded FROM docs")
def method_flags(spark, sf_dir):
    m = F.col("extraction_method")
    return documents(spark, sf_dir).select("document_id", extraction.formula_aware(m, ("de", "fr")).alias("formula_aware"), extraction.degraded(m, ("de", "fr")).alias("degraded"))


@query(f"WITH {DOCS} SELECT document_id, length(markdown_content) >= 200 AND NOT regexp_matches(markdown_content, '(?i)<form>\\s*</form>') AS accepted FROM docs")
def content_gate(spark, sf_dir):
    return documents(spark, sf_dir).select("document_id", extraction.accepted(F.col("markdown_content")).alias("accepted"))


@query(f"WITH x AS (SELECT doc_id, text || ' ÇİZGİ' AS t FROM documents) SELECT doc_id, list_filter(string_split_regex(lower(translate(t, '{ACCENTS[0]}', '{ACCENTS[1]}')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS tokens FROM x")
def fts_tokens(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", text.tokens(F.concat("text", F.lit(" ÇİZGİ"))).alias("tokens"))


_TERMS = ['"kredi" AND faiz*', "sermaye & (yeterlilik)", "or NOT near", "a | b ! c"]


@query(
    "WITH q AS (SELECT conv_id * 100 + turn AS id, text AS q FROM conversations UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-1 - i}, '{t}')" for i, t in enumerate(_TERMS)) + ") t(id, q)) "
    "SELECT id, array_to_string(list_filter(string_split_regex(regexp_replace(q, '[\"*()^+\\-!&|<>:]', ' ', 'g'), '\\s+'), lambda w: w <> '' AND upper(w) NOT IN ('AND', 'OR', 'NOT', 'NEAR')), ' ') AS clean FROM q"
)
def fts_sanitize(spark, sf_dir):
    d = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("q"))
    d = d.union(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(_TERMS)], "id long, q string"))
    return d.select("id", text.clean_query(F.col("q")).alias("clean"))


_EDITED = ["a b c", "b b", "yok"]
_TIMES = "CAST((length(x) - length(replace(x, 'b', ''))) AS INT)"


@query(f"WITH {texts_sql(_EDITED)} SELECT id, CASE WHEN {_TIMES} = 1 THEN replace(x, 'b', 'X') ELSE x END AS text, {_TIMES} = 1 AS changed, {_TIMES} AS matches FROM x")
def anchor_edits(spark, sf_dir):
    return _texts(spark, sf_dir, _EDITED).select("id", markup.replace_once(F.col("x"), F.lit("b"), F.lit("X")).alias("e")).select("id", "e.*")


@query("WITH n AS (SELECT doc_id, list_transform(string_split(text, ' the '), lambda p: length(p)) AS n FROM documents) SELECT doc_id, list_transform(range(1, len(n)), lambda i: CAST(list_sum(n[1:i]) + 5 * (i - 1) AS INT)) AS places FROM n")
def anchor_places(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", reports.places_of(F.col("text"), F.lit(" the ")).alias("places"))


@query("SELECT p_partkey, p_size BETWEEN 1 AND 17 AND p_size % 14 BETWEEN 1 AND 12 AS ok FROM part")
def parameter_validation(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", validation.valid_row(F.lit("1.0.2"), F.col("p_size"), F.col("p_size") % 14, F.lit(2024)).alias("ok"))


@query(
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '## EK-' || p_size || ' Tablo' WHEN 1 THEN '## İKİNCİ BÖLÜM ' || p_name WHEN 2 THEN 'a ' || p_name ELSE 'Ekonomi **' || p_size || '** metin' END AS line FROM part"
)
def markdown_cleanup(spark, sf_dir):
    """Lines made of each part's name and size: annexes, bold section titles, odd white space and bold words."""
    size, name = F.col("p_size").cast("int").cast("string"), F.col("p_name")
    kind = F.col("p_partkey") % 4
    line = F.when(kind == 0, F.concat(F.lit("EK-"), size, F.lit(" Tablo"))).when(kind == 1, F.concat(F.lit("**İKİNCİ BÖLÜM "), name, F.lit("**")))
    line = line.when(kind == 2, F.concat(F.lit("a \u200b   "), name)).otherwise(F.concat(F.lit("Ekonomi **"), size, F.lit("** metin")))
    return read(spark, sf_dir, "part").select("p_partkey", text.promote_heading(text.fix_emphasis(line)).alias("line"))
