"""LaTeX checks, formula signals, quality predicates and edits of markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a LaTeX marker.
LATEX_MARKERS = (r"_\{[^}]+\}", r"\^\{[^}]+\}", r"\\frac", r"\\sum", r"\\Delta", r"\\cdot", r"\\sqrt", r"\\min", r"\\max")

# Phrases that introduce a formula, and weights of the signals of a dropped one.
FORMULA_INTROS = ("aşağıdaki formül", "formül ile hesaplanır", "formülü ile hesaplanır", "aşağıdaki formüle göre", "aşağıdaki formül yoluyla", "aşağıda yer alan korelasyon formülü")
SIGNAL_WEIGHTS = {"S1": 1, "S2": 3, "S3": 5, "S4": 1, "S5": 3}

# Shapes of formulas, broken image references, dangling definitions, the definition word and a bullet after it.
_BLOCK = r"\$\$[^$]{1,600}\$\$"
_INLINE = r"(?<!\$)\$[^$\n]{1,200}\$(?!\$)"
_BROKEN_IMAGE = r"_dosyalar/image\d+\.(?:gif|png)"
_DANGLING = r"(?m)^\s{5,}:\s+\S"
_DEFINITION = r"Formülde[,;:]"
_DEFINED_BULLET = r"Formülde[,:]\s*\n+\s*[-•]\s"
# Empty form blocks and image references.
EMPTY_FORM = r"(?i)<form>\s*</form>"
IMAGE_REFERENCES = (r"!\[[^\]]*\]\([^)]+\)", r"(?i)<img\s+[^>]*src=[^>]+>")


def _count(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern))


def latex_issues(x: Column) -> Column:
    """Unclosed block formulas, unbalanced environments (each, by name) and unclosed inline formulas."""
    blocks = _count(x, r"\$\$")
    begins = F.regexp_extract_all(x, F.lit(r"\\begin\{([^}]+)\}"), F.lit(1))
    ends = F.regexp_extract_all(x, F.lit(r"\\end\{([^}]+)\}"), F.lit(1))
    names = F.array_sort(F.array_distinct(F.concat(begins, ends)))

    def times(all_names: Column, name: Column) -> Column:
        return F.size(F.filter(all_names, lambda y: y == name))

    def wrong(name: Column) -> Column:
        return F.concat(F.lit("environment "), name, F.lit(": "), times(begins, name).cast("string"), F.lit(" begin, "), times(ends, name).cast("string"), F.lit(" end"))

    unbalanced = F.transform(F.filter(names, lambda n: times(begins, n) != times(ends, n)), wrong)
    inline = _count(F.regexp_replace(F.regexp_replace(x, r"\$\$", ""), r"\\\$", ""), r"\$")
    one = F.when(blocks % 2 != 0, F.concat(F.lit("odd block delimiters: "), blocks.cast("string")))
    two = F.when(inline % 2 != 0, F.concat(F.lit("odd inline delimiters: "), inline.cast("string")))
    return F.array_compact(F.concat(F.array(one), unbalanced, F.array(two)))


def text_metrics(x: Column) -> Column:
    """Struct of form_drops, latex_markers and image_refs."""
    x = F.coalesce(x, F.lit(""))
    return F.struct(
        _count(x, EMPTY_FORM).alias("form_drops"),
        _count(x, "|".join(LATEX_MARKERS)).alias("latex_markers"),
        (_count(x, IMAGE_REFERENCES[0]) + _count(x, IMAGE_REFERENCES[1])).alias("image_refs"),
    )


def regressed(before: Column, after: Column) -> Column:
    return (after["form_drops"] > before["form_drops"]) | (after["latex_markers"] < before["latex_markers"])


def silent_drop(pdf_images: Column, metrics: Column) -> Column:
    return pdf_images > metrics["image_refs"] + metrics["latex_markers"]


def formula_signals(x: Column, method: Column) -> Column:
    """Struct of S1 to S5 and the weighted score.

    S2: an introduction, then the definition word within 250 characters and no
    formula between. S3: broken image references. S4: dangling definitions. S5:
    the definition word and a bullet, without a block formula in the 200
    characters before. S1: no manual repair, if any other signal is there.
    """
    # the look-ahead keeps the gap in the match, so that adjacent introductions count each
    intro = rf"(?iu)(?:{'|'.join(FORMULA_INTROS)})(?=([\s\S]{{0,250}}))"
    gaps = F.transform(F.regexp_extract_all(x, F.lit(intro), F.lit(1)), lambda g: F.regexp_extract(g, rf"(?iu)^([\s\S]*?){_DEFINITION}", 0))
    s2 = F.size(F.filter(gaps, lambda g: (g != "") & ~g.rlike(_BLOCK) & ~g.rlike(_INLINE)))
    # text before each marker: pieces of the split, of which the last 200 characters count
    pieces = F.split(x, _DEFINED_BULLET, -1)
    before = F.slice(pieces, 1, F.size(pieces) - 1)
    s5 = F.size(F.filter(before, lambda p: ~F.substring(p, F.greatest(F.length(p) - 199, F.lit(1)), F.lit(200)).rlike(_BLOCK)))
    s3, s4 = _count(x, _BROKEN_IMAGE), _count(x, _DANGLING)
    some = (s2 + s3 + s4 + s5) > 0
    s1 = F.when(some & ~F.contains(F.coalesce(method, F.lit("")), F.lit("manual_latex")), 1).otherwise(0)
    signals = {"S1": s1, "S2": s2, "S3": s3, "S4": s4, "S5": s5}
    score = sum((F.lit(SIGNAL_WEIGHTS[k]) * v for k, v in signals.items()), F.lit(0))
    return F.struct(*[v.cast("int").alias(k) for k, v in signals.items()], score.cast("int").alias("score"))


def anomalies(x: Column) -> dict[str, Column]:
    """Predicates of the quality scan by name."""
    n = F.length(x)
    # deleting characters is several times faster here than replacing by a pattern
    marks, latin = "çğıöşüÇĞİÖŞÜ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    marked, letters = n - F.length(F.translate(x, marks, "")), n - F.length(F.translate(x, marks + latin, ""))
    return {
        "replacement_char": F.contains(x, F.lit("�")),
        "leaked_img_tag": x.rlike(r"(?i)<img[\s>]"),
        "leaked_html_block": x.rlike(r"(?i)<(div|table|tr|td)[\s>]"),
        "short_content": n < 500,
        "long_dot_run": F.contains(x, F.lit("." * 10)),
        "camelcase_concat": x.rlike("[a-zçğıöşü][A-ZÇĞİÖŞÜ]"),
        "formula_ref_without_formula": ~F.contains(x, F.lit("$$")) & F.contains(F.lower(x), F.lit("formül")),
        "diacritic_outlier": (n > 1000) & (F.try_divide(marked, letters) < 0.06),
    }


def corruption(document_id: Column, x: Column, method: Column) -> Column:
    """The first signature that holds: three on any id, four on prefixed ids only; else null."""
    prefixed = document_id.like("mevzuat_%")
    return (
        F.when(F.contains(x, F.lit("Đ")), "i_garble")
        .when(F.contains(x, F.lit("\u000c")), "form_feeds")
        .when(x.rlike("[\\u0080-\\u009F]"), "c1_controls")
        .when(prefixed & F.contains(x, F.lit("�")), "ufffd")
        .when(prefixed & F.contains(x, F.lit("<img")), "leaked_img")
        .when(prefixed & (F.length(x) < 500), "too_short")
        .when(prefixed & (method == "markitdown_degraded"), "markitdown_degraded")
    )


def occurrences(x: Column, anchor: Column) -> Column:
    """How often a text occurs, without overlaps."""
    return ((F.length(x) - F.length(F.replace(x, anchor, F.lit("")))) / F.length(anchor)).cast("int")


def replace_once(x: Column, anchor: Column, new: Column) -> Column:
    """Struct of text, changed and matches: replaced only if the anchor occurs exactly once."""
    n = occurrences(x, anchor)
    return F.struct(F.when(n == 1, F.replace(x, anchor, new)).otherwise(x).alias("text"), (n == 1).alias("changed"), n.alias("matches"))


def insert_once(x: Column, anchor: Column, new: Column, after: bool = True) -> Column:
    return replace_once(x, anchor, F.concat(anchor, new) if after else F.concat(new, anchor))


def facts(x: Column) -> Column:
    """Numbers (each), then dates and percentages that aren't there yet."""
    numbers = F.regexp_extract_all(x, F.lit(r"(\d+[.,\d]*\d+)"), F.lit(1))
    dates = F.regexp_extract_all(x, F.lit(r"(\d{2}\.\d{2}\.\d{4})"), F.lit(1))
    shares = F.transform(F.regexp_extract_all(x, F.lit(r"(%\s*[\d.,]+|[\d.,]+\s*%)"), F.lit(1)), lambda p: F.regexp_extract(p, r"[\d.,]+", 0))
    more = F.array_distinct(F.filter(F.concat(dates, shares), lambda f: f != ""))
    return F.concat(numbers, F.filter(more, lambda f: ~F.array_contains(numbers, f)))


def grounding(source: Column, answer: Column) -> Column:
    """Share of the source's facts that the answer holds; without facts, whether there is an answer."""
    found = facts(F.coalesce(source, F.lit("")))
    hit = F.size(F.filter(found, lambda f: F.contains(answer, f)))
    blank = F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?U)\s+", "") == ""
    return F.when(F.coalesce(answer, F.lit("")) == "", 0.0).when(F.size(found) == 0, F.when(blank, 0.0).otherwise(1.0)).otherwise(hit / F.size(found))
