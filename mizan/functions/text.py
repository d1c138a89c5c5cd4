"""Turkish folding and stemming, full-text tokens, clean-up, hashing, pages and chunks."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes that one stemming step may strip, the first match counts.
SUFFIXES = (
    "ları", "leri", "ların", "lerin", "lara", "lere", "lardan", "lerden", "larla", "lerle", "lar", "ler", "ının", "inin", "unun", "ünün", "ına",
    "ine", "una", "üne", "ında", "inde", "unda", "ünde", "ından", "inden", "undan", "ünden", "ıyla", "iyle", "uyla", "üyle", "nın", "nin", "nun",
    "nün", "dan", "den", "tan", "ten", "ya", "ye", "da", "de", "ta", "te", "ın", "in", "un", "ün", "na", "ne", "dır", "dir", "dur", "dür", "tır",
    "tir", "tur", "tür",
)

# Printable characters of Windows-1252 at the C1 code points.
C1_TO_PRINTABLE = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž",
    0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ",
}

# Texts that only error and navigation pages hold.
ERROR_PAGE_TEXTS = ("Mevzuat TürüKanunlar", "Mevzuat TuruKanunlar", "404 - Sayfa Bulunamadı", "404 - Sayfa Bulunamadi", "Sayfa Bulunamadı")

# Sizes of pages and chunks, in characters.
PAGE_CHARS = 5000
CHUNK_CHARS, CHUNK_OVERLAP = 1000, 200



def _accents() -> tuple[str, str]:
    """Latin letters with marks and their plain letters, by decomposition, and those that have none: ı, ł, ø, đ, ħ, ŧ."""
    letters = {"ı": "i", "ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ħ": "h", "Ħ": "H", "ŧ": "t", "Ŧ": "T"}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = unicodedata.normalize("NFD", chr(code))[0]
        if plain != chr(code) and plain.isascii() and plain.isalpha():
            letters[chr(code)] = plain
    return "".join(letters), "".join(letters.values())


#: Accented letters and what full-text search folds them to, before lower-casing.
ACCENTS = _accents()


def lower_tr(x: Column) -> Column:
    """Lower case by Turkish rules."""
    return F.lower(F.translate(x, "İIŞÇÜÖĞ", "iışçüöğ"))


def stem_tr(word: Column) -> Column:
    """Strip one suffix if three characters stay."""
    return F.regexp_replace(word, f"^(.{{3,}}?)({'|'.join(SUFFIXES)})$", "$1")


def fold_fts(x: Column) -> Column:
    """Accent fold, then lower case, as full-text search compares."""
    return F.lower(F.translate(x, *ACCENTS))


def tokens(x: Column) -> Column:
    """Folded words in order; the index is the position."""
    return F.filter(F.split(fold_fts(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def clean_query(term: Column) -> Column:
    """A search term without operators: special characters, AND, OR, NOT, NEAR."""
    words = F.split(F.regexp_replace(term, r"[\"*()^+\-!&|<>:]", " "), r"\s+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~F.upper(w).isin("AND", "OR", "NOT", "NEAR")), " ")


def parse_date(x: Column) -> Column:
    """d.M.yyyy or d/M/yyyy, else null."""
    return F.coalesce(F.try_to_date(x, "d.M.yyyy"), F.try_to_date(x, "d/M/yyyy"))


def content_hash(x: Column) -> Column:
    return F.sha2(x, 256)


def sanitize(x: Column) -> Column:
    """Drop NUL and form feed, write Đ as İ; other controls stay."""
    return F.translate(x, "Đ\u0000\u000c", "İ")


def remap_c1(x: Column) -> Column:
    return F.translate(x, "".join(map(chr, C1_TO_PRINTABLE)), "".join(C1_TO_PRINTABLE.values()))


def decode_bytes(x: Column) -> Column:
    """Text of HTML bytes: UTF-8 if valid and without U+FFFD, else ISO-8859-9; C1 remapped.

    ISO-8859-9 is ISO-8859-1 but for six letters. It has a letter for every
    byte, so no further encoding and no lossy step can come after it.
    """
    utf8 = F.try_validate_utf8(x.cast("string"))
    return remap_c1(F.when(utf8.isNotNull() & ~F.contains(utf8, F.lit("�")), utf8).otherwise(F.translate(F.decode(x, "ISO-8859-1"), "ÐÝÞðýþ", "ĞİŞğış")))


def strip_dump_header(x: Column) -> Column:
    """What follows the first line that holds --- alone, without leading white space; else the text."""
    at = F.instr(x, "\n---\n")
    return F.when(at > 0, F.regexp_replace(F.substring(x, at + 5, F.length(x)), r"^\s+", "")).otherwise(x)


#: Named entities that are decoded; numeric ones all are.
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "uuml": "ü", "Uuml": "Ü", "ouml": "ö", "Ouml": "Ö", "ccedil": "ç", "Ccedil": "Ç", "imath": "ı", "inodot": "ı", "scedil": "ş", "Scedil": "Ş", "gbreve": "ğ", "Gbreve": "Ğ", "Idot": "İ"}


def unescaped(x: Column) -> Column:
    """Text with its entities decoded, an ampersand's last; a text without any isn't touched."""

    def letter(entity: Column) -> Column:
        code = F.regexp_extract(entity, "(?i)^&#x?([0-9a-f]+);", 1)
        number = F.when(entity.rlike("^&#[xX]"), F.conv(code, 16, 10)).otherwise(code).cast("int")
        whole = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.when(number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF), whole).otherwise("")

    numeric = F.array_distinct(F.regexp_extract_all(x, F.lit("&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"), F.lit(0)))
    out = F.aggregate(numeric, x, lambda text, e: F.replace(text, e, letter(e)))
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.when(F.contains(x, F.lit("&")), F.replace(out, F.lit("&amp;"), F.lit("&"))).otherwise(x)


def is_error_page(x: Column) -> Column:
    """Any error-page text, with numeric and common named entities decoded."""
    decoded, found = unescaped(x), F.lit(False)
    for text in ERROR_PAGE_TEXTS:
        found = found | F.contains(decoded, F.lit(text))
    return found


def collapse_space(x: Column) -> Column:
    """White space, zero-width and no-break spaces become one space; ends trimmed."""
    return F.trim(F.regexp_replace(x, "[ \\t\\r\\n​  ]+", " "))


def fix_emphasis(x: Column) -> Column:
    """Bold runs without white space at their ends, and one for two with nothing but white space between."""
    parts = F.split(collapse_space(x), r"\*\*")  # those at odd places are bold, but for a last one that nothing closes

    def shown(part: Column, i: Column) -> Column:
        edge = lambda pattern: F.when(part.rlike(pattern), " ").otherwise("")
        bold = F.concat(edge("^ "), F.lit("**"), F.trim(part), F.lit("**"), edge(" $"))
        inside, last = i % 2 == 1, i == F.size(parts) - 1
        return F.when(inside & last, F.concat(F.lit("**"), part)).when(inside & (F.trim(part) != ""), bold).otherwise(part)

    joined = F.array_join(F.transform(parts, shown), "")
    for between, instead in (("****", ""), ("** **", " ")):
        joined = F.replace(joined, F.lit(between), F.lit(instead))
    return collapse_space(joined)


# Ordinals of section headings.
ORDINALS = ("BİRİNCİ", "İKİNCİ", "ÜÇÜNCÜ", "DÖRDÜNCÜ", "BEŞİNCİ", "ALTINCI", "YEDİNCİ", "SEKİZİNCİ", "DOKUZUNCU", "ONUNCU")


def promote_heading(x: Column) -> Column:
    """Section and annex titles become second-level headings, without emphasis marks."""
    plain = F.trim(F.regexp_replace(x, "[*_]", ""))
    pattern = rf"(?iu)^(?:(?:{'|'.join(ORDINALS)})\s+BÖLÜM(?!\w)|EK[-–—]?\s*\d+)"
    return F.when(plain.rlike(pattern), F.concat(F.lit("## "), plain)).otherwise(x)


def page_count(x: Column, size: int = PAGE_CHARS) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(x) / size)).cast("int")


def page(x: Column, number: Column | int, size: int = PAGE_CHARS) -> Column:
    """Page of a text, counted from 1; a message beyond the last."""
    n = F.lit(number) if isinstance(number, int) else number
    total = page_count(x, size)
    inside = n.between(1, total)
    return F.when(inside, F.substring(x, (n - 1) * size + 1, F.lit(size))).otherwise(F.format_string("Invalid page %d, document has %d pages", n, total))


def chunks(x: Column, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Overlapping windows; those of white space alone are left out, and the index closes up."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(x) - 1, F.lit(0)), F.lit(size - overlap))
    cut = F.filter(F.transform(starts, lambda s: F.substring(x, s + 1, F.lit(size))), lambda c: F.regexp_replace(c, r"(?U)\s+", "") != "")
    return F.when(F.regexp_replace(x, r"(?U)\s+", "") == "", F.array().cast("array<string>")).when(F.length(x) <= size, F.array(x)).otherwise(cut)


def unchunk(parts: Column, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> Column:
    """The text of chunks in order: each loses what the one before, by list position, covers."""
    step = size - overlap
    indexed = F.transform(parts, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    first = F.struct(F.lit("").alias("text"), F.lit(0).alias("before"))

    def add(acc: Column, x: Column) -> Column:
        cut = F.when(x["i"] == 0, 0).otherwise(F.greatest(F.lit(0), (x["i"] - 1) * step + acc["before"] - x["i"] * step))
        return F.struct(F.concat(acc["text"], F.substring(x["c"], cut + 1, F.length(x["c"]))).alias("text"), F.length(x["c"]).alias("before"))

    return F.aggregate(indexed, first, add, lambda acc: acc["text"])


def format_number(x: Column) -> Column:
    """Thousands separators; two decimals unless the value is whole."""
    return F.when(x == F.floor(x), F.format_number(x, 0)).otherwise(F.format_number(x, 2))
