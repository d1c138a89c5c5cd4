"""Surrogates for personal data (operator 1).

Detected: e-mail addresses, telephone numbers, payment cards (with a valid
check digit), bank accounts (IBAN with valid check digits), US social security
numbers, IPv4 and IPv6 addresses, values assigned to passwords, tokens and keys,
names after a form of address, names that begin with one of the given names
listed here, and, in a document, every further mention of a part of a name that
it holds. A name's word may have hyphens, apostrophes and inner capitals, or be
in capitals. Names of none of these kinds aren't detected.

Each distinct entity gets a surrogate drawn from a keyed hash
of its normal form: of the same type, length, separators, letter case and
script, with a valid check digit for cards, and for names of the gender that
the form of address or the given name tells. The same entity, also written with other separators
or case, gets the same surrogate in all documents; parts of a name are mapped
one by one, so a later mention by surname alone agrees. Surnames with a
feminine form (Петров, Петрова; Kowalski, Kowalska) are one entity, and the
surrogate has both forms too.

A table of distinct entities is checked in Spark: where two entities of a type
(names of all kinds are one type) drew the same surrogate, all but the smallest draw again, and so do those whose
surrogate is an entity of the corpus itself. After every WIDEN draws the format
becomes wider (a longer value; for addresses a larger network, in the end
IPv6), so that a full format can't block. Only entities that still draw are
written in a round. Those that drew more than once are the
exceptions; they go to the tasks if few, else join the documents that hold them.

Defined results: null text stays null without entities; empty text is unchanged;
rows with null doc_id or repeated rows are treated like others; an empty table gives no
rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from ipaddress import IPv6Address

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mizan.llm import common, kernels

#: Draws of a format that are tried before the next wider one.
WIDEN = 6
#: Exceptions are sent to the tasks up to this number (a few MB).
FEW = 50_000

#: Forms of address by gender.
MALE = ("Mr.", "Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr.", "Signor", "Господин", "Κύριος")
FEMALE = ("Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra.", "Signora", "Госпожа", "Κυρία")
NEUTRAL = ("Dr.", "Dr", "Prof.", "Professor")
#: Common given names by gender; two words or more that begin with one are a name.
GIVEN_MALE = (
    "Ahmed Ahmet Alexander Ali Andreas Andrew Anthony Antonio Brian Carlos Charles Christian Christopher Daniel David Edward Emre Eric Felix Francisco "
    "François Frank George Giovanni Giuseppe Hans Hassan Henry Ivan James Jan Jean João Johannes John José Joseph Juan Jürgen Kevin Klaus Luca Luis "
    "Manuel Marco Mark Martin Mateusz Matthew Mehmet Michael Miguel Mohamed Muhammad Mustafa Nicolas Oliver Patrick Paul Pedro Peter Philippe Pierre Piotr "
    "Ravi Richard Robert Ryan Samuel Sergei Stefan Stephen Steven Thomas Timothy Tomasz William Wolfgang Yusuf Александр Алексей Андрей Дмитрий Иван Михаил Николай Сергей "
    "Γιώργος Γιάννης Δημήτρης Κώστας Νίκος"
).split()
GIVEN_FEMALE = (
    "Agnieszka Aisha Alice Amanda Amy Ana Angela Anna Anne Ayşe Barbara Birgit Carla Carmen Caroline Catherine Chiara Christine Claire Claudia Deborah Elena "
    "Elif Elizabeth Emily Emma Fatima Fatma Francesca Giulia Hannah Helen Ingrid Isabel Jane Janet Jennifer Jessica Joana Julia Karen Katarzyna Katharina "
    "Laura Linda Lisa Lucía Małgorzata Margaret Maria María Marie Martina Mary Melissa Michelle Monika Nancy Nicole Olga Patricia Priya Rachel Rebecca "
    "Sabine Sandra Sarah Sofia Sophie Stephanie Susan Ursula Zeynep Анна Анастасия Екатерина Елена Мария Наталья Ольга Светлана Татьяна "
    "Ελένη Κατερίνα Μαρία Σοφία"
).split()
#: Endings of surnames that have a feminine form, by script: masculine and feminine.
GENDERED = {"cyrillic": (("ов", "ова"), ("ев", "ева"), ("ёв", "ёва"), ("ин", "ина"), ("ын", "ына"), ("ский", "ская"), ("цкий", "цкая")), "latin": (("ski", "ska"), ("cki", "cka"), ("dzki", "dzka"))}
#: Letters that names are drawn from, by script: consonants, vowels, endings by gender.
SCRIPTS = {
    "latin": ("bdfghklmnprstvz", "aeiou", {"m": ("n", "r", "s"), "f": ("a", "ia", "e")}),
    "cyrillic": ("бвгдзклмнпрстф", "аеиоу", {"m": ("н", "р", "й"), "f": ("а", "ия", "ина")}),
    "greek": ("βγδθκλμνπρστφ", "αειου", {"m": ("ος", "ης", "ων"), "f": ("α", "η", "ια")}),
}

_UPPER = "".join(chr(c) for c in range(0x2000) if chr(c).isupper() and chr(c).isalpha())
_LETTER = r"[^\W\d_]"
#: One word of a name: hyphens, apostrophes and inner capitals are part of it, a final 's isn't.
_WORD = rf"[{_UPPER}](?:{_LETTER}|[-‐]{_LETTER}|['’](?![sS](?!{_LETTER})){_LETTER})+(?!\w)"
_INITIALS = rf"(?:[{_UPPER}]\. ?)*"
_TITLES = {x: g for g, titles in (("m", MALE), ("f", FEMALE), ("", NEUTRAL)) for x in titles}
_TITLES |= {x.upper(): g for x, g in _TITLES.items()}
_GIVEN = {x: g for g, names in (("m", GIVEN_MALE), ("f", GIVEN_FEMALE)) for x in names}
_GIVEN |= {x.upper(): g for x, g in _GIVEN.items()}


def _any(words) -> str:
    return "|".join(re.escape(x) for x in sorted(words, key=len, reverse=True))


_NAME = re.compile(rf"(?<!\w)({_any(_TITLES)}) (?:(?:{_any(_TITLES)}) )*{_INITIALS}({_WORD}(?: {_INITIALS}{_WORD}){{0,2}})")
_PLAIN_NAME = re.compile(rf"(?<![\w'’-])((?:{_any(_GIVEN)})(?!\w)(?:-{_LETTER}+)?(?: {_INITIALS}{_WORD}){{1,2}})")
_NAME_WORD = re.compile(_WORD)
#: In the syntax of Arrow's expressions: a title or a listed given name, between bytes that aren't letters of A-Z.
_MAY_NAME = f"(^|[^A-Za-z])({_any([*_TITLES, *_GIVEN])})([^a-z]|$)"
_EMAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])")
_IPV4 = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)")
_CARD = re.compile(r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w|\.\d)")
_PHONE = re.compile(
    r"(?<![\w.])(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4}"
    r"|\(?0\d{2,4}\)?(?:[ .-]\d{3}[ .-]\d{2}[ .-]?\d{2}|[ .-]\d{3}[ .-]\d{4}|[ /]\d{6,8}|[ .-]\d{2}[ .-]\d{2}[ .-]\d{2}))(?![\w-]|\.\d)"
)
#: Digits of a number with its country code; a longer run is two numbers side by side.
PHONE_DIGITS = 13
_IPV6 = re.compile(r"(?<![\w:.])(?=[0-9a-fA-F:]*[0-9])(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}(?![\w:])")
_SECRET = re.compile(r"(?i)(?<![a-z])(?:password|passwd|secret|token|api[_-]?key|access[_-]?key)\s?[=:]\s?(\"[^\"\s]{8,}\"|'[^'\s]{8,}'|[^\s\"',;]{8,})")
_SSN = re.compile(r"(?<![\w-])(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_DIGITS = re.compile(r"\D+")


def check_digit(digits: str) -> str:
    """The digit that makes digits + it valid under the mod-10 scheme of payment cards."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return str(-total % 10)


def account_remainder(country: str, check: str, body: str) -> int:
    """The account number modulo 97, letters as 10 to 35; 1 if its check digits are right."""
    return int("".join(str(int(c, 36)) for c in body + country + check)) % 97


def script_of(word: str) -> str:
    c = word[-1].lower()
    return "cyrillic" if "а" <= c <= "ё" else "greek" if "ά" <= c <= "ώ" else "latin"


def masculine(surname: str) -> str:
    """A surname's masculine form, if its ending has one."""
    for own, other in GENDERED.get(script_of(surname), ()):
        if surname.endswith(other) and len(surname) > len(other) + 1:
            return surname[: -len(other)] + own
    return surname


def feminine(surname: str) -> str:
    """A surname's feminine form, if its ending has one; else the surname."""
    return next((surname[: -len(own)] + other for own, other in GENDERED.get(script_of(surname), ()) if surname.endswith(own)), surname)


def phone(found: str) -> str:
    """What is one number: groups beyond PHONE_DIGITS belong to another."""
    while found[0] == "+" and len(_DIGITS.sub("", found)) > PHONE_DIGITS and re.search(r"[ .-]\d+$", found):
        found = re.sub(r"[ .-]\d+$", "", found)
    return found


def names(text: str) -> list[tuple[int, int, str, str]]:
    """Words of names: name-m, name-f or name for given names, surname for the last word; then other mentions of these."""
    found, known = [], {}
    for pattern in (_NAME, _PLAIN_NAME):
        for m in pattern.finditer(text):
            titled = pattern is _NAME
            words = [(m.start(1 + titled) + w.start(), w[0]) for w in _NAME_WORD.finditer(m[1 + titled])]
            gender = (_TITLES[m[1]] if titled else "") or next((_GIVEN[w] for _, w in words if w in _GIVEN), "")
            for i, (at, word) in enumerate(words):
                last = i == len(words) - 1
                kind = "surname" if last else f"name-{gender}" if gender else "name"
                norm = masculine(word.lower()) if last else word.lower()
                found.append((at, at + len(word), kind, norm))
                known.setdefault(word.lower(), (kind, norm))
                if last:
                    known.setdefault(norm, (kind, norm))
                    known.setdefault(feminine(norm), (kind, norm))
    if known:
        for m in _NAME_WORD.finditer(text):
            if m[0].lower() in known:
                found.append((m.start(), m.end(), *known[m[0].lower()]))
    return found


def may_name(texts: pa.Array) -> list[bool]:
    """Which texts hold a title or a listed given name, so that names are searched there only."""
    return pc.match_substring_regex(texts.fill_null(""), _MAY_NAME).to_pylist()


def entities(text: str, named: bool = True) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normal form) of every entity, ascending, without overlaps; names only if named."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in _EMAIL.finditer(text)]
    if "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            quoted = m[1][0] in "\"'"
            found.append((m.start(1) + quoted, m.end(1) - quoted, "secret", m[1].strip("\"'")))
    if re.search("[0-9]", text):
        found += [(m.start(), m.end(), "ipv4", m[0]) for m in _IPV4.finditer(text)]
        for m in _CARD.finditer(text):
            digits = _DIGITS.sub("", m[0])
            if digits[-1] == check_digit(digits[:-1]) and len(set(digits)) > 1:
                found.append((m.start(), m.end(), "card", digits))
        found += [(m.start(), m.end(), "ssn", _DIGITS.sub("", m[0])) for m in _SSN.finditer(text)]
        for m in _IBAN.finditer(text):
            plain = m[0].replace(" ", "")
            if account_remainder(plain[:2], plain[2:4], plain[4:]) == 1:
                found.append((m.start(), m.end(), "iban", plain))
        if text.count(":") > 1:
            found += [(m.start(), m.end(), "ipv6", str(x)) for m in _IPV6.finditer(text) if (x := address(m[0]))]
        at = 0
        while m := _PHONE.search(text, at):
            number = phone(m[0])
            at = m.start() + len(number)
            found.append((m.start(), at, "phone", ("+" if number[0] == "+" else "") + _DIGITS.sub("", number)))
    if named:
        found += names(text)
    order = {"secret": 0, "email": 1, "iban": 2, "ipv4": 3, "card": 4, "ssn": 5, "phone": 6, "ipv6": 7}
    found.sort(key=lambda x: (x[0], order.get(x[2], 8), -x[1]))
    out, end = [], -1
    for x in found:
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return out


class Draw:
    """Integers from a keyed hash of (type, normal form, attempt)."""

    def __init__(self, key: bytes, *parts: str):
        self.seed = hashlib.blake2b("\0".join(parts).encode(), key=key[:64], digest_size=32).digest()
        self.block, self.pool = 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool = hashlib.blake2b(self.seed + self.block.to_bytes(4, "little"), digest_size=64).digest()
            self.block += 1
        x, self.pool = int.from_bytes(self.pool[:8], "little"), self.pool[8:]
        return x % n

    def pick(self, choices: str | tuple) -> str:
        return choices[self.below(len(choices))]

    def like(self, text: str) -> str:
        """Letters for letters, digits for digits, the rest as it is; long hexadecimal numbers stay such."""
        hexadecimal = re.fullmatch(r"(?=.*[0-9])(?=.*[a-fA-F])(?:[0-9a-f]{8,}|[0-9A-F]{8,})", text) is not None
        out = []
        for c in text:
            if hexadecimal:
                out.append(self.pick("0123456789abcdef" if text.lower() == text else "0123456789ABCDEF"))
            elif c.isdigit():
                out.append(self.pick("0123456789"))
            elif c.isalpha():
                x = self.pick("abcdefghijklmnopqrstuvwxyz")
                out.append(x.upper() if c.isupper() else x)
            else:
                out.append(c)
        return "".join(out)


def address(text: str) -> IPv6Address | None:
    try:
        found = IPv6Address(text)
    except ValueError:
        return None
    return found if int(found) > 0xFFFF else None


def _ipv4(draw: Draw, norm: str, wide: int) -> str:
    """Of the same network and digits; then of the network 10, then any, then an IPv6 address of the documentation's network."""
    parts = norm.split(".")
    if wide > 2:
        return _ipv6(draw)
    fixed = 0 if wide > 1 else 1 if wide or parts[0] in ("10", "127") else 2 if norm.startswith("192.168.") else 0
    if wide == 1:
        parts[0] = "10"
    limits = {1: (1, 9), 2: (10, 99), 3: (100, 254)}
    for i in range(fixed, 4):
        low, high = (1, 254) if wide else limits[len(parts[i])]
        parts[i] = str(low + draw.below(high - low + 1))
    return ".".join(parts)


def _ipv6(draw: Draw) -> str:
    return str(IPv6Address((0x20010DB8 << 96) + (draw.below(1 << 48) << 48) + draw.below(1 << 48)))


def _part(draw: Draw, norm: str, wide: int) -> str:
    consonants, vowels, _ = SCRIPTS[script_of(norm)]
    out = ""
    while len(out) < max(3, len(norm) - 1) + 3 * wide:
        out += draw.pick(consonants) + draw.pick(vowels)
    return out


def _name(draw: Draw, norm: str, kind: str, wide: int) -> str:
    """Syllables for each part, hyphens and apostrophes in their places; the ending by gender."""
    parts = re.split("([-‐'’])", norm)
    consonants, _, endings = SCRIPTS[script_of(norm)]
    out = "".join(_part(draw, x, wide * (i == len(parts) - 1)) if i % 2 == 0 else x for i, x in enumerate(parts) if x)
    if kind.startswith("name-"):
        return out + draw.pick(endings[kind[5:]])
    own = next((own for own, _ in GENDERED.get(script_of(norm), ()) if kind == "surname" and norm.endswith(own)), None)
    if own:  # a vowel before an ending that begins with one gives way
        return (out[:-1] if own[0] in "оеёиы" else out) + own
    return out + draw.pick(consonants)


def surrogate(key: bytes, kind: str, norm: str, attempt: int = 0) -> str:
    """The surrogate's normal form."""
    draw, wide = Draw(key, kind, norm, str(attempt)), attempt // WIDEN
    if kind == "email":
        local, _, host = norm.partition("@")
        labels = host.split(".")
        domain = Draw(key, "host", host)  # one host, one surrogate host
        return draw.like(local + "a0" * wide) + "@" + ".".join([domain.like(x) for x in labels[:-1]] + labels[-1:])
    if kind == "ipv4":
        return _ipv4(draw, norm, wide)
    if kind == "ipv6":
        return _ipv6(draw)
    if kind == "card":
        body = norm[0] + "".join(draw.pick("0123456789") for _ in norm[1:-1] + "0" * wide)
        return body + check_digit(body)
    if kind == "iban":
        body = draw.like(norm[4:] + "0" * wide)
        return norm[:2] + f"{98 - account_remainder(norm[:2], '00', body):02d}" + body
    if kind == "ssn":
        return f"{1 + draw.below(665):03d}{1 + draw.below(99):02d}{1 + draw.below(9999):04d}" + "".join(draw.pick("0123456789") for _ in range(wide))
    if kind == "phone":
        kept = min(3, max(1, len(norm) - 11)) + 1 if norm[0] == "+" else int(norm[0] == "0")
        rest = norm[kept:]
        return norm[:kept] + draw.pick("23456789") + "".join(draw.pick("0123456789") for _ in rest[1:] + "0" * wide)
    if kind == "secret":
        return draw.like(norm + "a0" * wide)
    return _name(draw, norm, kind, wide)


def space(kind: str) -> str:
    """Types within which surrogates differ: names of all kinds are one, addresses of both kinds too."""
    return "name" if kind in ("surname", "name", "name-m", "name-f") else "address" if kind in ("ipv4", "ipv6") else kind


def forms(kind: str, value: str) -> list[str]:
    """A value and, for a surname with one, its feminine form."""
    return sorted({value, feminine(value)}) if kind == "surname" else [value]


def render(mention: str, kind: str, norm: str, value: str) -> str:
    """A surrogate's normal form in the mention's separators, case and, for surnames, gender."""
    if kind in ("card", "iban", "phone", "ssn"):
        signs, out = iter(value.lstrip("+")), []
        for c in mention:
            out.append(next(signs, "") if c.isalnum() else c)
        return "".join(out) + "".join(signs)
    if kind == "email" and mention != mention.lower():
        return value.upper() if mention == mention.upper() else "".join(v.upper() if i < len(mention) and mention[i].isupper() else v for i, v in enumerate(value))
    if space(kind) == "name":
        if kind == "surname" and mention.lower() != norm:
            value = feminine(value)
        return value.upper() if len(mention) > 1 and mention == mention.upper() else re.sub("(?:^|(?<=[-‐'’])).", lambda m: m[0].upper(), value)
    return value


def replaced(text: str, key: bytes, retries: dict, named: bool = True) -> tuple[str, list[dict]]:
    """Text with surrogates, and its entities: type, start and end in the source, surrogate."""
    out, at, found = [], 0, []
    for start, end, kind, norm in entities(text, named):
        new = render(text[start:end], kind, norm, surrogate(key, kind, norm, retries.get((kind, norm), 0)))
        out += [text[at:start], new]
        found.append({"type": kind, "start": start, "end": end, "surrogate": new})
        at = end
    return "".join([*out, text[at:]]), found


ENTITY = "doc_id long, text_key long, kind string, norm string"


def mentions(rows: DataFrame) -> DataFrame:
    """One row for each distinct entity of a document."""

    def run(batches):
        for batch in kernels.text_batches(batches):
            out = []
            for name, text_key, text, named in zip(*[c.to_pylist() for c in batch.columns], may_name(batch.column(2)), strict=True):
                out += [(name, text_key, kind, norm) for kind, norm in sorted({x[2:] for x in entities(text or "", named)})]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 4, kinds, strict=True)], names=["doc_id", "text_key", "kind", "norm"])

    return common.mapped(rows.select("doc_id", "text_key", "text"), run, ENTITY)


def resolved(distinct: DataFrame, key: bytes) -> DataFrame:
    """(kind, norm, attempt, value) of every entity: values are distinct and no entity themselves.

    A round draws for the entities that have no value yet and keeps what no
    entity is, none kept before has, and no smaller one drew in this round.
    """
    spark = distinct.sparkSession

    def draw(batches):
        for batch in batches:
            kinds, norms, attempts = (c.to_pylist() for c in batch.columns)
            values = [surrogate(key, *x) for x in zip(kinds, norms, attempts, strict=True)]
            spaces = [space(k) for k in kinds]
            either = [forms(k, v) for k, v in zip(kinds, values, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.string()), pa.array(spaces, pa.string()), pa.array(either, pa.list_(pa.string()))], names=["kind", "norm", "attempt", "value", "space", "forms"])

    schema = "kind string, norm string, attempt int, value string, space string, forms array<string>"
    name = F.col("kind").isin("surname", "name", "name-m", "name-f")
    spaces = F.when(name, "name").when(F.col("kind").isin("ipv4", "ipv6"), "address").otherwise(F.col("kind"))
    real = distinct.select(spaces.alias("space"), F.col("norm").alias("form")).distinct()

    def round_of(pending: DataFrame, taken: list[DataFrame]) -> DataFrame:
        drawn = common.written(common.mapped(pending.select("kind", "norm", "attempt"), draw, schema), "drawn")
        each = drawn.select("kind", "norm", "space", F.explode("forms").alias("form"))
        rank = F.row_number().over(Window.partitionBy("space", "form").orderBy("norm", "kind"))
        bad = [each.withColumn("rank", rank).where("rank > 1").select("kind", "norm")]
        bad += [each.join(t, ["space", "form"], "left_semi").select("kind", "norm") for t in taken]
        again = common.written(reduce(DataFrame.union, bad).distinct().withColumn("again", F.lit(True)), "again")
        return drawn.join(again, ["kind", "norm"], "left").select(*drawn.columns, F.col("again").isNotNull().alias("again"))

    pending, kept, taken = distinct.select("kind", "norm", F.lit(0).alias("attempt")), [], [real]
    while True:
        judged = common.settled(lambda p=pending, t=tuple(taken): round_of(p, list(t)), spark, "judged")
        own = judged.where("NOT again")
        kept.append(own.select("kind", "norm", "attempt", "value"))
        if judged.where("again").isEmpty():
            return reduce(DataFrame.unionByName, kept)
        # one table of all that is taken by then, so that a round makes the same joins as the one before
        forms_of = own.select("space", F.explode("forms").alias("form"))
        taken = [real, forms_of if len(taken) == 1 else taken[1].union(forms_of)]
        pending = judged.where("again").select("kind", "norm", (F.col("attempt") + 1).alias("attempt"))


REPLACED = "doc_id long, text string, n_entities long, entities array<struct<type string, start long, end long, surrogate string>>"


def with_surrogates(docs: DataFrame, key: bytes = b"change this key", few: int = FEW) -> DataFrame:
    """doc_id, text with surrogates, n_entities and entities of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    distinct = common.written(mentions(rows).groupBy("kind", "norm").agg(F.count("*").alias("n")).select("kind", "norm"), "entities")
    again = resolved(distinct, key).where("attempt > 0")
    sent: dict = {}
    if again.count() <= few:
        sent = {(r["kind"], r["norm"]): r["attempt"] for r in again.collect()}
        rows = rows.withColumn("retries", F.lit(None).cast("array<struct<kind string, norm string, attempt int>>"))
    else:
        own = mentions(rows).distinct().join(common.written(again.select("kind", "norm", "attempt"), "retries"), ["kind", "norm"])
        own = own.groupBy(F.col("doc_id").alias("r_id"), F.col("text_key").alias("r_key")).agg(F.collect_list(F.struct("kind", "norm", "attempt")).alias("retries"))
        rows = rows.join(own, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_key") == F.col("r_key")), "left")

    def run(batches):
        kinds = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("surrogate", pa.string())]))
        for batch in kernels.text_batches(batches):
            texts, lists = [], []
            for text, retries, named in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), may_name(batch.column(1)), strict=True):
                own = {(x["kind"], x["norm"]): x["attempt"] for x in retries} if retries else sent
                new, found = replaced(text, key, own, named) if text else (text, [])
                texts.append(new)
                lists.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(x) for x in lists], pa.int64()), pa.array(lists, kinds)], names=["doc_id", "text", "n_entities", "entities"])

    return common.mapped(rows.select("doc_id", "text", "retries"), run, REPLACED)


def op1_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    return with_surrogates(common.read(spark, sf_dir, "documents"))
